"""Signals on streams, and spans fetched as a stream."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from barloom.operators.backtest import SIGNALS, run_backtest
from barloom.operators.config import BacktestConfig
from barloom.plans.strategies import EmaCross, MacdTrend
from barloom.sources.providers import IncompleteError, KlineProvider, TableProvider
from barloom.sources.store import BarStore
from barloom.streaming import fetch as G
from barloom.streaming import signals as Z
from barloom.streaming.bars import stream_trades
from tests.frames import to_spark, walk


def _arrive(df, path, first, last):
    """Bars of these rows, the next file of a folder."""
    at = pd.Timestamp("2025-01-01")
    df.where(F.col("open_time").between(F.lit(at + pd.Timedelta(minutes=first)), F.lit(at + pd.Timedelta(minutes=last - 1)))).coalesce(1).write.mode("append").parquet(path)


def _source(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _plan(strategy):
    return lambda bars: strategy.signals(strategy.prepare(bars))


def _told(df, *columns):
    return df.select("symbol", "open_time", *columns).toPandas().sort_values(["symbol", "open_time"]).reset_index(drop=True)


def test_signals_of_a_stream_are_those_of_the_table(spark, tmp_path):
    """Two symbols, one of which rests for two micro-batches; a stop between; then trades of the followed stream."""
    a, b = walk(400, 5), walk(400, 6).assign(symbol="B")
    df = to_spark(spark, pd.concat([a, b[(b.index < 100) | (b.index >= 300)]], ignore_index=True)).cache()
    into, path, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    strategy = MacdTrend(fast=3, slow=6, signal=4, allow_short_signals=True)
    for k in range(0, 200, 100):
        _arrive(df, into, k, k + 100)
    start = lambda: Z.follow(_source(spark, df, into), _plan(strategy), path, cp, 150, availableNow=True)
    start().awaitTermination(120)
    assert Z.table(spark, path).count() == 300
    for k in range(200, 400, 100):
        _arrive(df, into, k, k + 100)
    start().awaitTermination(120)
    want, got = _told(_plan(strategy)(df), *SIGNALS, "macd"), _told(Z.table(spark, path), *SIGNALS, "macd")
    assert want[list(SIGNALS)].any().all() and got[["symbol", "open_time", *SIGNALS]].equals(want[["symbol", "open_time", *SIGNALS]])
    np.testing.assert_allclose(got["macd"], want["macd"], rtol=1e-9, atol=1e-12)

    cfg = BacktestConfig(fee_bps=2, exit_enabled=True, sl_mode="entry_pct", sl_value=0.3, tp_mode="rr", tp_value=2.0)
    q = stream_trades(Z.read(spark, path, maxFilesPerTrigger=1), cfg).writeStream.format("memory").queryName("followed").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination(180)
    key = lambda d: sorted((x.symbol, x.side, str(x.entry_time)[:19], str(x.exit_time)[:19], round(x.pnl, 6)) for x in d.collect())
    trades = key(run_backtest(_plan(strategy)(df), cfg).trades.where("close_reason <> 'forced_close_end'"))
    assert len(trades) > 10 and key(spark.table("followed")) == trades


def test_a_failed_micro_batch_is_run_again_and_a_finished_one_is_not(spark, tmp_path):
    df = to_spark(spark, walk(60, 8)).cache()
    into, path, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    strategy, broken, runs = EmaCross(ema_period=5), [True], []

    def plan(bars):
        runs.append(1)
        if len(runs) == 2 and broken:
            raise RuntimeError("lost")
        return _plan(strategy)(bars)

    for k in range(0, 60, 20):
        _arrive(df, into, k, k + 20)
    with pytest.raises(StreamingQueryException):
        Z.follow(_source(spark, df, into), plan, path, cp, 60, availableNow=True).awaitTermination(120)
    broken.clear()
    assert Z.table(spark, path).count() == 20
    Z.follow(_source(spark, df, into), plan, path, cp, 60, availableNow=True).awaitTermination(120)
    want = _told(_plan(strategy)(df), *SIGNALS)
    assert _told(Z.table(spark, path), *SIGNALS).equals(want) and len(runs) == 4
    step = Z._step(plan, path, 60)
    step(df, 2)  # as after a crash between the result and Spark's own note of it
    assert _told(Z.table(spark, path), *SIGNALS).equals(want) and len(runs) == 4
    late = df.withColumn("close", F.col("close") * 2).unionByName(df.limit(1).withColumn("open_time", F.lit(None).cast("timestamp_ntz")))
    step(late, 3)
    step(df.limit(0), 4)
    assert _told(Z.table(spark, path), *SIGNALS).equals(want)
    with pytest.raises(ValueError, match="checkpoint"):
        step(df, 9)
    with pytest.raises(ValueError, match="lookback"):
        Z.follow(df, plan, path, cp, 0)


class _Counted:
    """A table's bars, of which what was asked for is noted; a date that fails once."""

    name = "counted"

    def __init__(self, bars, fails):
        self.table, self.asked, self.fails = TableProvider(bars), [], fails

    def fetch(self, spark, symbol, tf, ranges):
        self.asked += [(symbol, a, b) for a, b in ranges]
        got = self.table.fetch(spark, symbol, tf, ranges)
        if self.fails and ranges[0][0] == self.fails[0]:
            self.fails.clear()
            return got.unionByName(got.limit(1).withColumn("open_time", F.lit(None).cast("timestamp_ntz")))  # as a page that fails for good
        return got


def test_a_span_fetched_as_a_stream_asks_for_no_finished_page_again(spark, tmp_path):
    pdf = walk(75 * 24, 2)
    pdf["open_time"] = pd.date_range("2025-01-10", periods=len(pdf), freq="1h")
    df = to_spark(spark, pd.concat([pdf.assign(symbol="AAA"), pdf.assign(symbol="BBB", close=pdf["close"] * 2)], ignore_index=True)).cache()
    store = BarStore(spark, str(tmp_path / "store"))
    path, cp = str(tmp_path / "asked"), str(tmp_path / "cp")
    G.ask(spark, path, ["aaa", "bbb", "AAA"], "1h", "2025-01-12 05:00:00", "2025-03-20 07:00:00")
    provider = _Counted(df, [pd.Timestamp("2025-02-01")])
    with pytest.raises(StreamingQueryException, match=IncompleteError.__name__):
        G.fetch_asked(store, path, cp, provider, availableNow=True).awaitTermination(240)
    before = len(provider.asked)
    assert before == 4  # January and February of two series
    G.fetch_asked(store, path, cp, provider, availableNow=True).awaitTermination(240)
    assert [a.month for _, a, _ in provider.asked[before:]] == [2, 2, 3, 3]
    G.fetch_asked(store, path, cp, provider, availableNow=True).awaitTermination(240)
    assert len(provider.asked) == 8
    got = pd.concat([store.load(s, "1h", source="counted").select("symbol", "open_time", "close").toPandas() for s in ("AAA", "BBB")])
    want = df.where("open_time between '2025-01-12 05:00:00' and '2025-03-20 07:00:00'").select("symbol", "open_time", "close").toPandas()
    sort = lambda d: d.sort_values(["symbol", "open_time"]).reset_index(drop=True)
    assert len(want) == 2 * (67 * 24 + 3) and sort(got).equals(sort(want))


def test_klines_are_fetched_as_a_stream(spark, tmp_path):
    store = BarStore(spark, str(tmp_path / "store"))
    G.ask(spark, str(tmp_path / "asked"), ["X"], "1m", "2025-01-31 22:00:00", "2025-02-01 01:59:00")
    G.fetch_asked(store, str(tmp_path / "asked"), str(tmp_path / "cp"), KlineProvider("barloom.sources.providers:generated_page", 50), files=2, availableNow=True).awaitTermination(240)
    got = store.load("X", "1m")
    assert got.count() == got.select("open_time").distinct().count() == 240
