"""Bars and simulated trading on streams."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barloom.functions.columns import KEY, TIME
from barloom.operators.backtest import SIGNALS, _arrays, _signals
from barloom.operators.config import BacktestConfig
from barloom.operators.simulator import Simulation
from barloom.operators.timeframe import span
from barloom.session import ship


def stream_bars(ticks: DataFrame, rule: str, late: str = "10 minutes", symbol: str = "symbol", time: str = "ts", price: str = "price", size: str = "size", tie: str | None = None) -> DataFrame:
    """Bars of a stream of ticks, each final once the watermark has passed its end.

    Ticks later than `late` are dropped; partial aggregates are all the state there is.
    """
    order = F.struct(time, tie) if tie else F.col(time)
    seen = ticks.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    grouped = seen.groupBy(F.col(symbol).alias(KEY), F.window(time, span(rule)))
    out = grouped.agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum(size).alias("volume"))
    return out.select(KEY, F.col("window.start").cast("timestamp_ntz").alias(TIME), "open", "high", "low", "close", "volume")


_OUT = [("side", "string"), ("entry_time", "timestamp"), ("exit_time", "timestamp"), *[(c, "double") for c in ("entry_price", "exit_price", "stop_price", "qty", "gross_pnl", "fees", "pnl")], ("close_reason", "string")]


class _Follower(StatefulProcessor):
    """The account of a symbol, traded as bars arrive in order; what is open is all its state."""

    def __init__(self, cfg: BacktestConfig) -> None:
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("account", "simulation binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        got = self.state.get()
        run = pickle.loads(got[0]) if got is not None else Simulation(self.cfg)  # noqa: S301 - written below
        bars = pd.concat(list(rows)).sort_values(TIME)
        _, _, ended = run.feed(_arrays(bars, self.cfg, "close"), _signals(bars), bars[TIME].to_numpy())
        self.state.update((pickle.dumps(run),))
        out = [(key[0], "long" if t.side > 0 else "short", t.entry_time, t.exit_time, t.entry_price, t.exit_price, t.stop_price, t.qty, t.gross, t.entry_fee + t.exit_fee, t.pnl, t.reason) for t in ended]
        yield pd.DataFrame(out, columns=[KEY, *[c for c, _ in _OUT]])

    def close(self) -> None:
        pass


def stream_trades(signals: DataFrame, cfg: BacktestConfig) -> DataFrame:
    """Finished trades of a stream of bars with the four signal columns, under any account: costs, stops, ladders,
    trailing, sizing, margin. The account is the state of a symbol.

    Bars of a symbol must arrive in order of time from one micro-batch to the next, as stream_bars gives them.
    Needs the RocksDB state store.
    """
    ship(signals.sparkSession)
    refs = [c for c in (cfg.sl_ref_long_col, cfg.sl_ref_short_col) if c and c in signals.columns]
    rows = signals.select(KEY, F.col(TIME).cast("timestamp").alias(TIME), "close", "high", "low", *[c for c in SIGNALS if c in signals.columns], *dict.fromkeys(refs))
    schema = ", ".join([f"{KEY} string", *[f"{c} {t}" for c, t in _OUT]])
    return rows.groupBy(KEY).transformWithStateInPandas(_Follower(cfg), schema, "append", "none")
