"""Simulated trading of a signal table.

Accounts whose trades do not depend on their cash are traded by DataFrame operations (linked.py); the others by
one ordered fold a (run, symbol), all of them in parallel. The folds stream: a series of any length is traded in
bounded memory.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import KEY, TIME
from barloom.operators.config import BacktestConfig
from barloom.operators.fold import fold_sorted
from barloom.operators.linked import Linked, cash_free, same_series
from barloom.operators.simulator import Simulation, Trade
from barloom.staging import drop, stage

SIGNALS = ("entry_long", "exit_long", "entry_short", "exit_short")
RUN = "run_id"
#: Seconds of a year.
YEAR = 365.25 * 86400

_TRADE = [("side", "string"), ("entry_time", "timestamp_ntz"), ("exit_time", "timestamp_ntz"), ("entry_i", "long"), ("exit_i", "long"), *[(c, "double") for c in ("entry_price", "exit_price", "stop_price", "qty", "gross_pnl", "fees", "pnl", "return_pct")], ("bars_held", "long"), ("close_reason", "string")]
TRADE_COLUMNS = [c for c, _ in _TRADE]
_FAST = ["num_trades", "win_rate_pct", "total_return_pct", "profit_factor", "expectancy_per_trade", "sharpe", "sortino", "max_drawdown_pct", "long_trades", "short_trades", "final_cash"]


def _schema(parts: list[tuple[str, str]]) -> str:
    return ", ".join(f"{c} {t}" for c, t in [(RUN, "long"), (KEY, "string"), *parts])


class SimResult:
    """Tables of a backtest: trades, the equity curve, and one row of final cash a run and symbol.

    The simulation runs when the first of them is asked for, once, and is staged in the shared folder by kind
    of row; all three are read from there.
    """

    def __init__(self, made: DataFrame, cfg: BacktestConfig) -> None:
        self._made, self.cfg = made, cfg

    @classmethod
    def of(cls, equity: DataFrame, cfg: BacktestConfig | None = None) -> SimResult:
        """A result that has an equity curve alone, made elsewhere."""
        made = equity.select(RUN, KEY, F.lit("equity").alias("kind"), F.col("t").alias("entry_time"), "equity", F.col("open_trades").cast("long").alias("open_trades"))
        return cls(made.withColumn("drawdown", F.lit(0.0)), cfg or BacktestConfig())

    @cached_property
    def _rows(self) -> DataFrame:
        return stage(self._made, "backtest", by="kind")

    @property
    def trades(self) -> DataFrame:
        return self._rows.where("kind = 'trade'").select(RUN, KEY, *TRADE_COLUMNS)

    @property
    def equity(self) -> DataFrame:
        return self._rows.where("kind = 'equity'").select(RUN, KEY, F.col("entry_time").alias("t"), "equity", "open_trades", "drawdown")

    @property
    def curve(self) -> DataFrame:
        """equity without the drawdown, for what does not need it."""
        return self.equity.drop("drawdown")

    @property
    def accounts(self) -> DataFrame:
        return self._rows.where("kind = 'account'").select(RUN, KEY, F.col("equity").alias("final_cash"), F.col("open_trades").alias("n_bars"), F.lit(float(self.cfg.initial_cash)).alias("initial_cash"))

    def drop(self) -> None:
        """Delete the staged rows, when nothing will read them any more."""
        if "_rows" in self.__dict__:
            drop(self._rows)


class LinkedResult(SimResult):
    """Tables of a backtest whose trades are linked intervals; series whose account refused an entry for its fee
    alone are folded."""

    def __init__(self, table: DataFrame, fold: Callable[[DataFrame], DataFrame], given: DataFrame, cfg: BacktestConfig) -> None:
        """table: run_id, symbol, open_time, px, signals; fold: what the ordered fold makes of rows of given."""
        super().__init__(given, cfg)
        self._linked, self._fold = Linked(table, cfg), fold

    @cached_property
    def _rows(self) -> DataFrame:
        rest = self._made.alias("t").join(self._linked.refused.alias("x"), same_series("t", "x"), "left_semi")
        return stage(self._fold(rest), "backtest", by="kind")

    def _with_folded(self, own: DataFrame, folded: Callable[[], DataFrame]) -> DataFrame:
        if self._linked.refused is None:
            return own
        return own.unionByName(folded().select(*own.columns))

    @property
    def trades(self) -> DataFrame:
        return self._with_folded(self._linked.trades(TRADE_COLUMNS), lambda: SimResult.trades.fget(self))

    @property
    def equity(self) -> DataFrame:
        return self._with_folded(self._linked.equity(), lambda: SimResult.equity.fget(self))

    @property
    def curve(self) -> DataFrame:
        return self._with_folded(self._linked.curve(), lambda: SimResult.equity.fget(self))

    @property
    def accounts(self) -> DataFrame:
        own = self._linked.accounts().withColumn("initial_cash", F.lit(float(self.cfg.initial_cash)))
        return self._with_folded(own, lambda: SimResult.accounts.fget(self))

    def drop(self) -> None:
        self._linked.drop()
        super().drop()


def _arrays(pdf: pd.DataFrame, cfg: BacktestConfig, price: str) -> dict[str, np.ndarray]:
    bars = {"close": pdf[price].to_numpy(float), "high": pdf["high"].to_numpy(float), "low": pdf["low"].to_numpy(float)}
    for side, column in (("ref_long", cfg.sl_ref_long_col), ("ref_short", cfg.sl_ref_short_col)):
        if column and column in pdf:
            bars[side] = pdf[column].to_numpy(float)
    return bars


def _signals(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    return {c: pdf[c].fillna(False).to_numpy(bool) if c in pdf else np.zeros(len(pdf), bool) for c in SIGNALS}


class _Curve:
    """What statistics need of an equity curve that is seen piece by piece."""

    def __init__(self) -> None:
        self.peak, self.fall, self.before = -math.inf, 0.0, None
        self.all, self.down = [0, 0.0, 0.0], [0, 0.0, 0.0]

    def drawdowns(self, equity: np.ndarray) -> np.ndarray:
        """The share that equity has fallen from its highest so far, 0 unless that was positive."""
        if not len(equity):
            return equity
        peak = np.maximum(np.maximum.accumulate(equity), self.peak)
        self.peak = float(peak[-1])
        fall = np.where(peak > 0, (peak - equity) / np.where(peak > 0, peak, 1.0), 0.0)
        self.fall = max(self.fall, float(fall.max()))
        return fall

    @staticmethod
    def _merge(into: list, x: np.ndarray) -> None:
        """Number, mean and sum of squared deviations, joined with those of x."""
        n = len(x)
        if n:
            mean, square = float(x.mean()), float(((x - x.mean()) ** 2).sum())
            total = into[0] + n
            gap = mean - into[1]
            into[2] += square + gap * gap * into[0] * n / total
            into[1] += gap * n / total
            into[0] = total

    def add(self, equity: np.ndarray) -> None:
        self.drawdowns(equity)
        whole = equity if self.before is None else np.concatenate([[self.before], equity])
        self.before = float(equity[-1])
        with np.errstate(divide="ignore", invalid="ignore"):
            move = np.diff(whole) / whole[:-1]
        move = move[np.isfinite(move)]
        self._merge(self.all, move)
        self._merge(self.down, move[move < 0])

    def ratios(self, per_year: float) -> tuple[float, float]:
        """Sharpe and Sortino."""
        spread = lambda x: math.sqrt(x[2] / (x[0] - 1)) if x[0] > 1 else 0.0
        if self.all[0] < 2 or not per_year > 0:
            return 0.0, 0.0
        scaled = self.all[1] * math.sqrt(per_year)
        return tuple(scaled / s if s > 0 else 0.0 for s in (spread(self.all), spread(self.down)))


class _FastStats:
    """The statistics that sweeps rank by, of one run."""

    def __init__(self, cfg: BacktestConfig) -> None:
        self.run, self.curve, self.cfg = Simulation(cfg), _Curve(), cfg
        self.n = self.wins = self.longs = 0
        self.gain = self.loss = 0.0

    def _count(self, trades: list[Trade]) -> None:
        for t in trades:
            self.n += 1
            self.longs += t.side > 0
            self.wins += t.pnl > 0
            self.gain += max(t.pnl, 0.0)
            self.loss += max(-t.pnl, 0.0)

    def feed(self, bars: dict, signals: dict) -> None:
        equity, _, trades = self.run.feed(bars, signals)
        self.curve.add(equity)
        self._count(trades)

    def row(self, per_year: float) -> dict[str, float]:
        self._count(self.run.finish())
        cash, first, n = self.run.account.cash, self.cfg.initial_cash, self.n
        factor = self.gain / self.loss if self.loss > 0 else (math.inf if self.gain > 0 else 0.0)
        values = [n, self.wins / n * 100 if n else 0.0, (cash / first - 1) * 100 if first > 0 else 0.0, factor, (self.gain - self.loss) / n if n else 0.0, *self.curve.ratios(per_year), self.curve.fall * 100, self.longs, n - self.longs, cash]
        return dict(zip(_FAST, map(float, values), strict=True))


def _trade_rows(trades: list[Trade]) -> pd.DataFrame:
    rows: dict[str, list] = {c: [] for c in TRADE_COLUMNS}
    for t in trades:
        value = t.entry_price * t.qty
        values = ("long" if t.side > 0 else "short", t.entry_time, t.exit_time, t.entry_i, t.exit_i, t.entry_price, t.exit_price, t.stop_price, t.qty, t.gross, t.entry_fee + t.exit_fee, t.pnl, t.pnl / value * 100 if value else math.nan, t.exit_i - t.entry_i, t.reason)
        for c, v in zip(TRADE_COLUMNS, values, strict=True):
            rows[c].append(v)
    return pd.DataFrame(rows)


def _run(cfg: BacktestConfig, price: str):
    columns = [RUN, KEY, "kind", *TRADE_COLUMNS, "equity", "open_trades", "drawdown"]

    def fold(key: tuple, pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, curve = Simulation(cfg), _Curve()
        made: list[pd.DataFrame] = []

        def out() -> pd.DataFrame:
            rows = pd.concat(made, ignore_index=True)
            rows[RUN], rows[KEY] = key
            made.clear()
            rows = rows.reindex(columns=columns)
            times = {c: pd.to_datetime(rows[c]) for c in ("entry_time", "exit_time")}
            return rows.assign(**times, **{c: rows[c].astype(object).where(rows[c].notna(), None) for c in ("side", "close_reason")})

        for pdf in pieces:
            times = pdf[TIME].to_numpy()
            equity, counts, trades = run.feed(_arrays(pdf, cfg, price), _signals(pdf), times)
            made.append(pd.DataFrame({"entry_time": times, "equity": equity, "open_trades": counts, "drawdown": curve.drawdowns(equity), "kind": "equity"}))
            if trades:
                made.append(_trade_rows(trades).assign(kind="trade"))
            yield out()
        if trades := run.finish():
            made.append(_trade_rows(trades).assign(kind="trade"))
        made.append(pd.DataFrame({"equity": [run.account.cash], "kind": ["account"], "open_trades": [run.offset]}))
        yield out()

    return fold


def run_backtest(signals: DataFrame, cfg: BacktestConfig, price: str = "close") -> SimResult:
    """Trade every (run_id, symbol) of a table of bars with boolean columns entry_long, exit_long, ...

    Missing signal columns are false, a missing stop reference column is unknown. Without run_id there is one
    run, 0. Each (run, symbol) is one account, traded in order of time; only the columns it needs are shuffled.
    """
    for c in (TIME, price, "high", "low"):
        if c not in signals.columns:
            raise ValueError(f"the table has no column {c}")
    needed = [c for c in dict.fromkeys((RUN, KEY, TIME, price, "high", "low", *SIGNALS, cfg.sl_ref_long_col, cfg.sl_ref_short_col)) if c in signals.columns]
    table = signals.select(*needed)
    table = table.withColumn(RUN, F.col(RUN).cast("long") if RUN in needed else F.lit(0).cast("long"))
    schema = _schema([("kind", "string"), *_TRADE, ("equity", "double"), ("open_trades", "long"), ("drawdown", "double")])
    fold = lambda rows: fold_sorted(rows, [RUN, KEY], [TIME], _run(cfg, price), schema)
    if not cash_free(cfg):
        return SimResult(fold(table), cfg)
    flags = [F.coalesce(F.col(c).cast("boolean") if c in needed else F.lit(False), F.lit(False)).alias(c) for c in SIGNALS]
    known = F.col(price).cast("double")
    return LinkedResult(table.select(RUN, KEY, TIME, F.when(~F.isnan(known), known).alias("px"), *flags), fold, table, cfg)


def periods_per_year(curve: DataFrame, time: str = "t", keys: tuple[str, ...] = (RUN, KEY)) -> DataFrame:
    """Bars a year at the exact median spacing; 0 for fewer than three bars."""
    step = F.timestamp_diff("MICROSECOND", F.lag(time).over(Window.partitionBy(*keys).orderBy(time)), F.col(time)) / 1e6
    spaced = curve.select(*keys, step.alias("_s"))
    median = F.percentile("_s", 0.5)
    return spaced.groupBy(*keys).agg(year_over(median, F.count("*")).alias("periods_per_year"))


def year_over(median: Column, bars: Column) -> Column:
    return F.when((bars >= 3) & (median > 0), YEAR / median).otherwise(0.0)


def with_drawdown(equity: DataFrame, time: str = "t", block: str = "month") -> DataFrame:
    """An equity curve with its drawdown from the highest so far, by run and symbol: within each block of a calendar
    unit, from the highest of the blocks before."""
    rows = equity.withColumn("_b", F.date_trunc(block, time))
    inside = F.max("equity").over(Window.partitionBy(RUN, KEY, "_b").orderBy(time).rowsBetween(Window.unboundedPreceding, 0))
    tops = rows.groupBy(RUN, KEY, "_b").agg(F.max("equity").alias("_top"))
    tops = tops.withColumn("_top", F.max("_top").over(Window.partitionBy(RUN, KEY).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
    both = rows.withColumn("_peak", inside).alias("t").join(tops.alias("b"), same_series("t", "b", "_b")).withColumn("_peak", F.greatest("_peak", "_top"))
    peak = F.col("_peak")
    return both.select(*[F.col(f"t.{c}") for c in equity.columns if c != "drawdown"], F.when(peak > 0, (peak - F.col("equity")) / peak).otherwise(0.0).alias("drawdown"))


def run_many(signals: DataFrame, runs: dict[int, BacktestConfig], column: str = "flags", price: str = "close", least: int = 8) -> DataFrame:
    """Statistics of many runs a symbol: one row for each (run_id, symbol).

    signals has a string with one hexadecimal digit for each distinct signal variant (bit 0 to 3: the four
    signals). A run is a pair of variant and configuration, coded as variant * 100000 + number of the
    configuration. A task is one job of one symbol, and bars are shuffled once a job: there are no more jobs than
    keep the cluster busy (four tasks a core), of at least `least` runs each.
    """
    refs = sorted({c for cfg in runs.values() for c in (cfg.sl_ref_long_col, cfg.sl_ref_short_col) if c and c in signals.columns})
    codes = sorted(runs)
    symbols = max(1, signals.select(KEY).distinct().count())
    busy = -(-4 * signals.sparkSession.sparkContext.defaultParallelism // symbols)
    most = max(least, -(-len(codes) // busy))
    jobs = [codes[k : k + most] for k in range(0, len(codes), most)]
    spans = [(own[0] // 100_000, own[-1] // 100_000 - own[0] // 100_000 + 1) for own in jobs]  # first variant, how many
    # the median spacing needs all bars at once: Spark finds it
    per_year = periods_per_year(signals.select(KEY, F.col(TIME).alias("t")), keys=(KEY,)).withColumnRenamed("periods_per_year", "_year")
    table = signals.select(KEY, TIME, price, "high", "low", *refs, F.posexplode(F.array(*[F.substring(column, 1 + a, n) for a, n in spans])).alias("_job", "_flags"))
    table = table.join(per_year, KEY, "left")

    def fold(key: tuple, pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [(k, runs[k], _FastStats(runs[k])) for k in jobs[int(key[1])]]
        first, width = spans[int(key[1])]
        year = 0.0
        for pdf in pieces:
            year = float(pdf["_year"].iloc[0])
            digits = np.frombuffer("".join(pdf["_flags"]).encode(), np.uint8).reshape(len(pdf), width)
            flags = digits - np.where(digits < 58, 48, 55).astype(np.uint8)
            for k, cfg, stats in own:
                mine = flags[:, k // 100_000 - first]
                stats.feed(_arrays(pdf, cfg, price), {c: (mine >> bit & 1).astype(bool) for bit, c in enumerate(SIGNALS)})
        yield pd.DataFrame([{RUN: k, KEY: key[0], **stats.row(year)} for k, _, stats in own], columns=[RUN, KEY, *_FAST])

    return fold_sorted(table, [KEY, "_job"], [TIME], fold, _schema([(c, "double") for c in _FAST]))
