"""Strategies, attribution, searches, the store, providers, streams and every query against its SQL."""

import json
import random
from datetime import datetime

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import attribution as A
from barloom.operators import search
from barloom.operators.config import BacktestConfig
from barloom.plans import catalogue
from barloom.plans import strategies as Y
from barloom.sources import providers as P
from barloom.sources import store as ST
from tests.frames import series, to_spark, walk

CFG = BacktestConfig(fee_bps=8, slippage_bps=1.5, exit_enabled=True, sl_mode="entry_pct", sl_value=0.6, tp_mode="rr", tp_value=2.0, sizing_mode="risk_pct_equity", sizing_value=1.0)


@pytest.fixture(scope="module")
def gold(spark):
    df = to_spark(spark, walk(3000, 0)).persist()
    yield df
    df.unpersist()


STRATEGIES = [
    Y.EmaRibbon(fast=20, slow=100),
    Y.EmaCross(entry_mode="full_candle", confirm_n=2, exit_mode="below_ema", exit_ema=20),
    Y.EmaCross(use_heikin_ashi=True, exit_mode="ha_flip", htf="5min", htf_ema=5),
    Y.RsiReversal(allow_short_signals=True),
    Y.MacdTrend(),
    Y.HeikinAshiTrend(),
    Y.SupertrendFlip(),
    Y.MtfTrend(fast_1m=20, trend_5m_fast=20, trend_5m_slow=50, mom_15m=20),
    Y.KeyLevelBounce(left=8, right=8, near_pct=0.2),
]


@pytest.mark.parametrize("strategy", STRATEGIES, ids=lambda s: s.name)
def test_strategies_run(gold, strategy):
    result = strategy.backtest(gold, CFG)
    assert result.equity.count() == 3000
    assert result.trades.where("exit_time is null").isEmpty()


def test_registry():
    assert set(Y.REGISTRY) == {"ema_ribbon", "ema_cross", "rsi_reversal", "macd_trend", "heikin_ashi", "supertrend", "mtf_trend", "key_level"}
    with pytest.raises(ValueError):
        Y.EmaCross(entry_mode="x")


def test_time_filter_holds_entries_only(gold):
    plain, held = Y.EmaRibbon(fast=20, slow=100), Y.EmaRibbon(fast=20, slow=100, hours=(8, 12))
    count = lambda s: s.signals(s.prepare(gold)).agg(F.sum(F.col("entry_long").cast("int")), F.sum(F.col("exit_long").cast("int"))).first()
    a, b = count(plain), count(held)
    assert b[0] <= a[0] and b[1] == a[1]


def test_attribution(gold):
    result = Y.HeikinAshiTrend().backtest(gold, CFG)
    trades = result.trades.persist()
    n = trades.count()
    assert A.by_hour(trades).agg(F.sum("n_trades")).first()[0] == n
    assert A.by_session(trades).count() == 4
    assert A.by_regime(trades, gold, 50).agg(F.sum("n_trades")).first()[0] == n
    assert A.hour_weekday(trades, "n_trades").count() == 7
    empty = trades.limit(0)
    assert A.by_session(empty).agg(F.sum("n_trades")).first()[0] == 0
    assert A.by_hour(empty).count() == 0
    trades.unpersist()


def test_grid_gives_the_same_as_single_runs(gold):
    grid = {"fast": [4, 10], "slow": [30], "confirm_n": [1, 2]}
    rows = search.run_grid(gold, Y.EmaRibbon, grid, CFG).toPandas().sort_values("run_id")
    assert len(rows) == 4
    for r in rows.itertuples():
        own = Y.EmaRibbon(fast=r.fast, slow=30, confirm_n=r.confirm_n).backtest(gold, CFG)
        assert own.trades.count() == r.num_trades
        assert own.accounts.first()["final_cash"] == pytest.approx(r.final_cash)
    with pytest.raises(ValueError):
        search.run_grid(gold, Y.EmaRibbon, grid, CFG, valid=lambda p: False)


def test_sweep_does_not_mix_up_parameters(gold):
    grid = {"fast": [3, 8], "slow": [12, 20], "signal": [4]}
    rows = search.run_grid(gold, Y.MacdTrend, grid, CFG).toPandas()
    for r in rows.itertuples():
        assert Y.MacdTrend(fast=r.fast, slow=r.slow, signal=4).backtest(gold, CFG).trades.count() == r.num_trades


def test_experiment_and_search(gold, tmp_path):
    e = search.Experiment("x", Y.EmaRibbon, CFG, strategy_space={"fast": [5], "slow": [20]}, cfg_space={"sl_value": [0.3, 0.6], "tp_value": [0.5, 2.0]}, valid=lambda p: p["tp_value"] > p["sl_value"])
    ranked = e.run(gold)
    assert ranked.count() == 3
    e.write(ranked, str(tmp_path))
    assert json.loads((tmp_path / "best.json").read_text())["fast"] == 5 and (tmp_path / "report.md").exists()
    found = search.random_search(gold, Y.EmaRibbon, {"fast": (3, 6), "slow": [15, 20]}, CFG, n_trials=4, rounds=2, seed=3)
    assert found.select("run_id").distinct().count() == 4


def test_rank_edges(spark):
    rows = spark.createDataFrame([(0, 5.0, float("inf"), 1.0), (1, 9.0, 1.0, None), (2, 1.0, 2.0, 3.0), (3, 8.0, 2.0, 2.0)], "run_id long, num_trades double, profit_factor double, sharpe double")
    assert [r.run_id for r in search.rank(rows, min_trades=5).collect()] == [3, 0]
    assert [r.run_id for r in search.rank(rows, min_trades=50).collect()] == [2, 3, 0]
    assert search.rank(rows).where("run_id = 0").first()["profit_factor"] is None


# ---- store and providers


def test_store(spark, tmp_path):
    store = ST.BarStore(spark, str(tmp_path / "bars"))
    assert store.load("s", "1m").count() == 0
    pdf = walk(3000, 2)
    store.write(to_spark(spark, pdf.iloc[:2000]), "1m")
    store.write(to_spark(spark, pdf.iloc[1500:].assign(close=1.0)), "1m")
    rows = store.load("S", "1m", "2025-01-01 00:10:00", "2025-01-02 20:00:00", ["close"])
    assert rows.count() == (1440 + 20 * 60) - 10 + 1
    assert store.load("s", "1m").where("close = 1").count() == 1500
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(open_time), GreaterThanOrEqual(open_time" in plan and "PartitionFilters" in plan
    assert store.catalog().first()["n_bars"] == 3000
    assert store.covers("s", "1m", "2025-01-01 01:00:00", "2025-01-02") and not store.covers("s", "1m", "2024-12-01", "2025-01-02")


def test_gaps_and_ranges(spark):
    pdf = series(range(30)).drop(index=[10, 11, 12])
    df = to_spark(spark, pdf)
    gap = ST.find_gaps(df, "1m").first()
    assert (gap.gap_start.minute, gap.gap_end.minute) == (10, 12)
    got = [(r["from"], r["to"]) for r in ST.missing_ranges(df, "1m", "2024-12-31 23:58:00", "2025-01-01 00:31:00", "S").collect()]
    at = lambda d, h, m: datetime(2025 if d == 1 else 2024, 1 if d == 1 else 12, d, h, m)
    assert got == [(at(31, 23, 58), at(31, 23, 59)), (at(1, 0, 10), at(1, 0, 12)), (at(1, 0, 30), at(1, 0, 31))]
    assert len(ST.missing_ranges(df, "1m", "2025-01-01", "2025-01-02", "OTHER").collect()) == 1


def test_small_helpers():
    assert [ST.show_last(x) for x in ("2weeks", "5w", "3M", "36h", "10min")] == [1209600, 3024000, 7776000, 129600, 600]
    assert ST.pages_needed(0, 599, 60, 5) == 2 and ST.pages_needed(5, 1, 60, 5) == 0
    assert P.fx_symbol("gold") == "XAU/USD" and P.fx_symbol("eurusd") == "EUR/USD"
    with pytest.raises(ValueError):
        P.get_provider("nowhere")
    assert [P.wait_for(k) for k in (1, 2, 3)] == [1, 2, 4] and P.wait_for(3, retry_after=7) == 7


def fake_page(symbol, tf, start, end, limit):
    first = -(-start // 60_000)
    out = []
    for k in range(first, min(end // 60_000, first + limit - 1) + 1):
        out.append([k * 60_000, "1", "2", "0.5", "1.5", "3", 0, "4", 5, "6", "7", "0"])
    return out


def test_provider_fetches_only_what_lacks(spark, tmp_path):
    store = ST.BarStore(spark, str(tmp_path / "bars"))
    calls = []

    class Seen:
        name = "binance"

        def fetch(self, spark, symbol, tf, ranges):
            calls.append(ranges)
            rows = [r for a, b in ranges for r in P.kline_rows(symbol, tf, P._ms(a), P._ms(b), fake_page, 50)]
            return spark.createDataFrame(rows, P._KLINES)

    rows = P.get_ohlcv(store, "abc", "1m", "2025-01-01 00:00:00", "2025-01-01 03:00:00", Seen(), tz="Europe/Paris")
    assert rows.count() == 181 and rows.agg(F.min("t")).first()[0] == datetime(2025, 1, 1, 1)
    P.get_ohlcv(store, "abc", "1m", "2025-01-01 00:00:00", "2025-01-01 03:00:00", Seen())
    assert len(calls) == 1
    assert P.get_ohlcv(store, "abc", "1m", "2025-01-01 00:00:00", "2025-01-01 04:00:00", Seen()).count() == 241
    assert calls[1] == [(datetime(2025, 1, 1, 3, 1), datetime(2025, 1, 1, 4))]


def breaking_page(symbol, tf, start, end, limit):
    """Pages of a server that has nothing to say about the third hour."""
    if start // 3_600_000 == 482_138:
        raise P.HttpError(404)
    return fake_page(symbol, tf, start, end, limit)


def test_pages_that_fail_lose_their_range_only(spark, tmp_path):
    store = ST.BarStore(spark, str(tmp_path / "bars"))
    ask = lambda page: P.get_ohlcv(store, "abc", "1m", "2025-01-01 00:00:00", "2025-01-01 04:59:00", P.KlineProvider(f"tests.test_library:{page}", limit=60, pages_a_task=1))
    with pytest.raises(P.IncompleteError):
        ask("breaking_page")
    kept = store.load("abc", "1m")
    assert kept.count() == 240 and kept.where("hour(open_time) = 2").isEmpty()
    assert ask("fake_page").count() == 300
    assert P.cut_ranges([[0, 59_999], [60_000, 299_999], [5, 4]], "1m", 2) == [(0, 59_999), (60_000, 179_999), (180_000, 299_999)]


def test_months_are_kept_one_by_one(spark, tmp_path):
    store = ST.BarStore(spark, str(tmp_path / "bars"))
    asked = []

    class Monthly:
        name = "binance"

        def fetch(self, spark, symbol, tf, ranges):
            asked.extend(ranges)
            if len(asked) == 3:
                raise TimeoutError
            rows = [r for a, b in ranges for r in P.kline_rows(symbol, tf, P._ms(a), P._ms(b), daily_page, 500)]
            return spark.createDataFrame(rows, P._KLINES)

    span = datetime(2025, 1, 1), datetime(2025, 4, 10)
    assert not P.fetch_by_month(store, "abc", "1d", *span, Monthly())
    assert store.load("abc", "1d").count() == 60  # two months and the first day of the third
    assert P.fetch_by_month(store, "abc", "1d", *span, Monthly())
    assert store.load("abc", "1d").count() == 100
    assert P.last("2weeks", datetime(2025, 1, 15)) == datetime(2025, 1, 1)


def daily_page(symbol, tf, start, end, limit):
    day = 86_400_000
    return [[k * day, "1", "2", "0.5", "1.5", "3", 0, "4", 5, "6", "7", "0"] for k in range(-(-start // day), end // day + 1)][:limit]


def test_fx_symbols():
    assert [P.fx_symbol(s) for s in ("xau/usd", "XAUUSD", "eurusd", "gold")] == ["XAU/USD", "XAU/USD", "EUR/USD", "XAU/USD"]
    with pytest.raises(ValueError):
        P.fx_symbol("SOMETHING")


def test_settings(tmp_path):
    from barloom.settings import Settings, get_logger

    env = tmp_path / ".env"
    env.write_text("# a comment\nBARLOOM_STORE='/data/bars'\nBARLOOM_LOG_LEVEL=debug\nnonsense\n")
    got = Settings.load(env, {"BARLOOM_LOG_LEVEL": "warning"})
    assert (got.store, got.log_level, got.display_tz) == ("/data/bars", "warning", "UTC")
    assert Settings.load(tmp_path / "none", {}).store == "bars"
    assert get_logger("barloom.test", "error").level == 40 and len(get_logger("barloom.test").handlers) == 1


def test_charts(spark, gold):
    from barloom.plans import charts

    result = Y.EmaRibbon(fast=5, slow=20).backtest(gold, CFG)
    symbol = gold.first()["symbol"]
    chart = charts.Chart(gold, symbol, first_bars=100).add_ema(50).add_trades(result.trades)
    near = chart.show()
    assert near.count('class="candle"') == 100 and "EMA 50" in near
    wide = chart.zoom().show()
    assert 100 < wide.count('class="candle"') <= 1.1 * charts.CANDLES and wide.count('class="entry"') == min(result.trades.count(), charts.MARKS)
    assert len(wide) < 600_000
    assert "polyline" in charts.price_and_trades(gold, result.trades, symbol)
    assert charts.equity_and_drawdown(result.equity, symbol).count("polyline") == 2
    assert 'class="cell"' in charts.monthly_heatmap(result.equity, symbol) + charts.hour_weekday_heatmap(result.trades)
    assert charts.Chart(gold, "none").show().startswith("<svg") and charts.equity_and_drawdown(result.equity, "none").startswith("<svg")
    with pytest.raises(ValueError):
        chart.add_line("no such column")
    runs = spark.createDataFrame([(3, 10, 1.0), (3, 20, -2.0), (5, 10, None)], "fast long, slow long, r double")
    assert charts.sweep_heatmap(runs, "fast", "slow", "r").count('class="cell"') == 2


def test_model_search_learns(gold):
    study = search.model_search(gold, Y.EmaRibbon, {"fast": (3, 12), "slow": (15, 40), "confirm_n": [1, 3]}, CFG, "total_return_pct", n_trials=14, batch=5, startup=5, seed=2, valid=lambda p: p["fast"] < p["slow"])
    assert len(study.trials) == 14 and [t.number for t in study.trials] == list(range(14))
    assert study.best_value == max(t.value for t in study.trials if t.value is not None) and study.best_params == study.best_trial.params
    assert len({json.dumps(t.params) for t in study.trials}) == 14
    good, rest = [{"fast": 4}, {"fast": 5}], [{"fast": 30}, {"fast": 28}, {"fast": 33}]
    r = random.Random(1)
    drawn = [search._propose({"fast": (2, 40)}, good, rest, r)["fast"] for _ in range(40)]
    assert np.mean([v < 15 for v in drawn]) > 0.9


def test_shipped_experiments():
    from barloom.plans.experiments import EXPERIMENTS

    shapes = {n: (e.strategy.name, len(search.expand_grid(e.strategy_space)), len(search.expand_grid(e.cfg_space)), e.metric, e.min_trades) for n, make in EXPERIMENTS.items() for e in [make()]}
    assert shapes == {"ema_mtf": ("mtf_trend", 24, 1, "sharpe", 20), "session_timing": ("ema_ribbon", 5, 1, "total_return_pct", 10), "exit_design": ("ema_ribbon", 1, 20, "sharpe", 20)}
    assert not EXPERIMENTS["exit_design"]().base_cfg.allow_rule_close


def test_retries_and_pages():
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise P.HttpError(429, 0)
        return [1]

    assert P.with_retries(flaky, sleep=lambda s: None) == [1]
    with pytest.raises(P.HttpError):
        P.with_retries(lambda: (_ for _ in ()).throw(P.HttpError(404)), sleep=lambda s: None)
    assert len(list(P.kline_rows("S", "1m", 0, 60_000 * 99, fake_page, 30))) == 100


def test_normalise_and_parse(spark):
    raw = spark.createDataFrame([("2025-01-01 00:00:00", 1.0, 2.0, 0.5, 1.5)], "Timestamp string, Open double, High double, Low double, Close double")
    assert P.normalise(raw, "xauusd").first()["volume"] == 0
    page = spark.createDataFrame([(json.dumps(fake_page("S", "1m", 0, 120_000, 5)),)], "j string")
    assert [(r.close, r.num_trades) for r in P.parse_klines(page, "j", "S").collect()] == [(1.5, 5)] * 3


def test_validate(spark):
    rows = pd.concat([series([1, 2]), series([5, np.nan])])
    got = ST.merge_bars(to_spark(spark, series([1, 2])), to_spark(spark, series([5, np.nan])))
    assert [r.close for r in got.orderBy("open_time").collect()] == [5, None]
    assert ST.validate_ohlcv(to_spark(spark, rows)).count() == 2
    with pytest.raises(ValueError):
        ST.validate_ohlcv(spark.range(1))


# ---- streams


def test_stream_bars_equal_batch(spark, tmp_path):
    from barloom.sources.ticks import bars_from_ticks
    from barloom.streaming.bars import stream_bars

    r = np.random.default_rng(0)
    ticks = pd.DataFrame({"symbol": "S", "ts": pd.date_range("2025-01-01", periods=600, freq="7s"), "price": 100 + r.normal(0, 1, 600).cumsum(), "size": 1.0})
    spark.createDataFrame(ticks).repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("symbol string, ts timestamp, price double, size double").parquet(str(tmp_path / "in"))
    q = stream_bars(source, "5min").writeStream.format("memory").queryName("stream_bars").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = spark.table("stream_bars").toPandas().sort_values("open_time").reset_index(drop=True)
    want = bars_from_ticks(spark.read.parquet(str(tmp_path / "in")), "5min").toPandas().sort_values("open_time").reset_index(drop=True)
    assert 0 < len(got) < len(want)
    np.testing.assert_allclose(got["close"], want["close"][: len(got)])


def test_stream_trades_keep_state(spark, tmp_path):
    from barloom.streaming.bars import stream_trades

    bars = series([10, 11, 12, 13, 14]).assign(entry_long=[T, F_, F_, T, F_], exit_long=[F_, F_, T, F_, T])
    df = to_spark(spark, bars)
    df.where("close <= 11").coalesce(1).write.parquet(str(tmp_path / "in/a"))
    df.where("close > 11").coalesce(1).write.parquet(str(tmp_path / "in/b"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = stream_trades(source, BacktestConfig(initial_cash=1000.0)).writeStream.format("memory").queryName("stream_trades").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(180)
    got = sorted((r.entry_price, r.exit_price) for r in spark.table("stream_trades").collect())
    assert got == [(10.0, 12.0), (13.0, 14.0)]


def test_stream_trades_equal_a_backtest(spark, tmp_path):
    """Stops, targets, shorts and costs on a stream are those of the simulator, whatever the micro-batches."""
    from barloom.operators.backtest import run_backtest
    from barloom.streaming.bars import stream_trades

    r = np.random.default_rng(3)
    close = 100 * np.exp(np.cumsum(r.normal(0, 0.004, 300)))
    flags = lambda: r.random(300) < 0.08
    bars = series(close, high=close * 1.003, low=close * 0.997).assign(entry_long=flags(), exit_long=flags(), entry_short=flags(), exit_short=flags())
    df = to_spark(spark, bars)
    for k in range(3):
        df.where((F.col("open_time") >= F.lit(bars["open_time"][100 * k])) & (F.col("open_time") < F.lit(bars["open_time"][100 * k] + pd.Timedelta(minutes=100)))).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    cfg = BacktestConfig(fee_bps=5, slippage_bps=1, exit_enabled=True, sl_mode="entry_pct", sl_value=0.8, tp_mode="rr", tp_value=2.0, trail_mode="pct", trail_value=0.7, sizing_mode="risk_pct_equity")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = stream_trades(source, cfg).writeStream.format("memory").queryName("stream_all").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(180)
    key = lambda d: sorted((x.side, str(x.entry_time)[:19], str(x.exit_time)[:19], round(x.pnl, 6), x.close_reason) for x in d.collect())
    want = key(run_backtest(df, cfg).trades.where("close_reason <> 'forced_close_end'"))
    assert len(want) > 10 and key(spark.table("stream_all")) == want


T, F_ = True, False

# ---- queries against SQL

TABLES = "events orders".split()
DATA = "/root/testdata/sf0.001"
#: A few of each kind here; the others differ from these in an expression.
CHECKED = ["bars_1h", "resample_week", "incremental_merge", "ema_20", "rsi_14", "macd", "supertrend", "swings", "pivot_points", "align_htf_ema", "asof_general", "build_mtf_two", "sig_crossed_up_within", "tf_local_hour", "strat_ema_ribbon_hours", "strat_key_level", "bt_signal_only", "by_session", "by_regime", "monthly_returns", "stats_core", "max_consecutive", "stats_curve", "bt_trades", "bt_stats", "bt_ladder", "bt_margin", "bt_costs", "bt_pyramid", "grid_sweep_exits", "experiment_rank", "fetch_klines", "store_load", "chart_trades"]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.execute(catalogue.oracle_sql()[name]).df()
    got = catalogue.queries()[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(want.columns)
    tidy = lambda x: x[order].sort_values(order).reset_index(drop=True).astype(object).where(lambda v: v.notna(), None)
    pd.testing.assert_frame_equal(tidy(got), tidy(want), check_dtype=False)


def test_asof_takes_the_last_of_all_ticks(spark):
    ticks = pd.read_parquet(f"{DATA}/events.parquet").sort_values(["event_type", "ts", "event_id"])
    bars = catalogue.queries()["bars_1h"](spark, DATA).select("symbol", "open_time").toPandas()
    got = {(r.symbol, r.open_time): r.before for r in catalogue.queries()["asof_general"](spark, DATA).collect()}
    assert len(got) == len(bars)
    for symbol, own in ticks.groupby("event_type"):
        times, ids = own["ts"].tolist(), own["event_id"].tolist()
        for t in bars.loc[bars["symbol"] == symbol, "open_time"]:
            k = sum(x <= t for x in times) - 1
            assert got[symbol, t.to_pydatetime()] == (ids[k - 1] if k > 0 else None)


def test_regimes_of_a_trade_of_every_bar(spark):
    close = catalogue.queries()["bars_1h"](spark, DATA).toPandas().sort_values(["symbol", "open_time"]).groupby("symbol")["close"]
    got = catalogue.queries()["by_regime"](spark, DATA).toPandas()
    pnl = (close.shift(-3) - close.shift(0)).dropna()
    assert got["n_trades"].sum() == len(pnl)
    assert got["total_pnl"].sum() == pytest.approx(pnl.sum(), abs=0.1)
    sizes = got.groupby(got["regime"].str.split("/").str[1])["n_trades"].sum()
    assert set(sizes.index) == {"lowvol", "midvol", "highvol"} and abs(sizes["midvol"] - sizes["highvol"]) <= 2


def test_sweeps_over_the_whole_grid(spark):
    """Against runs one by one: every combination, each symbol, with stops and targets."""
    bars = catalogue._bars(spark, DATA).persist()
    rows = []
    for k, c in enumerate(search.expand_grid(catalogue._GRID)):
        result = Y.EmaRibbon(**c).backtest(bars, catalogue._RISK)
        trades = result.trades.groupBy("symbol").count().toPandas().set_index("symbol")["count"]
        rows += [{"run_id": k, **c, "symbol": r.symbol, "num_trades": float(trades.get(r.symbol, 0)), "ret": round((r.final_cash / catalogue._RISK.initial_cash - 1) * 100, 4)} for r in result.accounts.collect()]
    bars.unpersist()
    want = pd.DataFrame(rows)
    assert want["run_id"].nunique() == 12
    best = want[want["num_trades"] >= 3].sort_values("ret", ascending=False)["ret"].head(15).tolist()
    got = catalogue.queries()["sweep_topk"](spark, DATA).toPandas()
    assert got["total_return_pct"].tolist() == pytest.approx(best, abs=2e-4) and len(got) == 15
    table = catalogue.queries()["sweep_pivot"](spark, DATA).toPandas().set_index("confirm_n")
    for (n, fast), top in want.groupby(["confirm_n", "fast"])["ret"].max().items():
        assert table.loc[n, str(fast)] == pytest.approx(top, abs=2e-4)


def test_every_sql_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["hour", "n_trades", "win_rate_pct", "total_pnl", "avg_pnl", "profit_factor"]


# ---- reports and command line


def test_report_and_command_line(spark, gold, tmp_path, capsys):
    from barloom import cli
    from barloom.plans.experiments import EXPERIMENTS
    from barloom.plans.report import curve, price_and_trades

    ST.BarStore(spark, str(tmp_path / "bars")).write(gold, "1m")
    common = ["--store", str(tmp_path / "bars"), "--symbol", "s", "--tf", "1m", "--strategy", "heikin_ashi", "--params", '{"n_consec": 2}', "--fee-bps", "2"]
    assert cli.main(["backtest", *common, "--sl", "entry_pct:0.5", "--tp", "rr:2"]) == 0
    assert "best session" in capsys.readouterr().out
    assert cli.main(["report", *common, "--out", str(tmp_path / "r.html")]) == 0
    page = (tmp_path / "r.html").read_text()
    assert "<svg" in page and "regime" in page and "uptrend" in page
    cfg = cli.build_config(cli.parser().parse_args(["backtest", *common, "--sizing", "lots:2"]))
    assert (cfg.sizing_mode, cfg.sizing_value, cfg.exit_enabled, cfg.fee_bps) == ("lots", 2.0, False, 2.0)
    result = Y.HeikinAshiTrend().backtest(gold, CFG)
    assert curve(result, 100).count() <= 100
    candles, marks = price_and_trades(gold, result.trades, "1h")
    assert candles.count() == 50 and marks.count() == 2 * result.trades.count()
    assert set(EXPERIMENTS) == {"ema_mtf", "session_timing", "exit_design"} and all(make().strategy_space for make in EXPERIMENTS.values())
