"""Backtests without a simulator: trades as linked intervals, in DataFrame operations only.

Where neither entries nor exits depend on the account's cash, a series of signals is an automaton of three
states (flat, long, short), and a bar with a signal is a function from state to state. Bars are cut into
blocks of SIZE; each block's functions are composed, the compositions give the state in which every block
begins, and then each block tells by itself where positions are opened and closed. An opening and the next
closing are a trade. What a trade earns, the account's cash and the equity of each bar follow by running sums
and by the last trade at or before a bar, block by block. So one long series is many tasks' work.

An account that has no cash left, or less than a fee that is always the same, refuses every further entry: its
trades end there. One that refuses an entry for a fee that later ones may be below is left to the ordered fold.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import KEY, TIME
from barloom.operators.config import BacktestConfig
from barloom.staging import drop, stage

RUN = "run_id"
#: Bars of a block, and rows of the table of counts that is broadcast.
SIZE, MOST_COUNTS = 4096, 200_000
_SERIES = (RUN, KEY)
_FLAT, _LONG, _SHORT = 0, 1, 2


def cash_free(cfg: BacktestConfig) -> bool:
    """Whether entries, exits and sizes follow from the bars alone: one position, closed by signals, of fixed cash
    or lots."""
    by_signal = not cfg.exit_enabled or (cfg.allow_rule_close and cfg.sl_mode == "none" and cfg.trail_mode == "none" and not cfg.targets)
    fixed = cfg.sizing_mode == "lots" or not cfg.exit_enabled
    return cfg.max_open_trades == 1 and cfg.trade_cash > 0 and not cfg.margin_enabled and by_signal and fixed


def same_series(a: str, b: str, *more: str) -> Column:
    return F.expr(" and ".join(f"{a}.{c} <=> {b}.{c}" for c in (*_SERIES, *more)))


def _next(state: str, t: str) -> str:
    """The state after a bar with signals: its opening o, and whether it ends longs and shorts."""
    return f"CASE {state} WHEN {_FLAT} THEN {t}.o WHEN {_LONG} THEN if({t}.xl, {t}.o, {_LONG}) ELSE if({t}.xs, {t}.o, {_SHORT}) END"


_ACTION = "struct<i:bigint,time:timestamp_ntz,px:double,opened:int>"


def _actions(events: str, start: str) -> str:
    """Where positions are closed or opened in a block that begins in a state."""
    closed = f"(x.s = {_LONG} and t.xl or x.s = {_SHORT} and t.xs)"
    opened = f"if(x.s = {_FLAT} or {closed}, t.o, 0)"
    step = f"named_struct('s', {_next('x.s', 't')}, 'done', if({closed} or {opened} > 0, concat(x.done, array(named_struct('i', t.i, 'time', t.time, 'px', t.px, 'opened', {opened}))), x.done))"
    return f"aggregate({events}, named_struct('s', {start}, 'done', cast(array() as array<{_ACTION}>)), (x, t) -> {step}, x -> x.done)"


class Linked:
    """Trades, equity curve and final cash of all series in a table of run_id, symbol, open_time, px and signals."""

    def __init__(self, table: DataFrame, cfg: BacktestConfig) -> None:
        self._table, self.cfg = table, cfg

    @cached_property
    def _staged(self) -> DataFrame:
        month = F.date_trunc("month", TIME)
        place = F.row_number().over(Window.partitionBy(*_SERIES, month).orderBy(TIME))
        return stage(self._table.withColumn("_month", month).withColumn("_place", place), "linked")

    @cached_property
    def _months(self) -> DataFrame:
        """Staged, one row a series and month: bars before it, all bars of the series, and its last known bar."""
        known = F.when(F.col("px").isNotNull(), F.col("_place"))
        counts = self._staged.groupBy(*_SERIES, "_month").agg(F.count("*").alias("n"), F.max_by(F.struct("_place", F.col(TIME).alias("time"), "px"), known).alias("last"))
        upto, whole = Window.partitionBy(*_SERIES).orderBy("_month"), Window.partitionBy(*_SERIES)
        rows = counts.withColumn("before", F.sum("n").over(upto) - F.col("n"))
        rows = rows.withColumn("last", F.when(F.col("last").isNotNull(), F.struct((F.col("before") + F.col("last._place") - 1).alias("i"), F.col("last.time").alias("time"), F.col("last.px").alias("px"))))
        return stage(rows.withColumns({"n_bars": F.sum("n").over(whole), "last": F.max("last").over(whole)}), "months")

    @cached_property
    def _bars(self) -> DataFrame:
        """Staged bars with their 0-based number i in their series."""
        before = self._months.select(*_SERIES, "_month", "before")
        small = F.broadcast(before) if before.count() <= MOST_COUNTS else before
        return self._staged.alias("t").join(small.alias("b"), same_series("t", "b", "_month")).select("t.*", (F.expr("b.before + t._place") - 1).alias("i")).drop("_month", "_place")

    @property
    def _ends(self) -> DataFrame:
        """n_bars of each series, and its last bar with a known price."""
        return self._months.where("before = 0").select(*_SERIES, "n_bars", "last")

    def _opened_and_closed(self) -> DataFrame:
        o = F.when(F.col("entry_long"), _LONG).when(F.col("entry_short") & F.lit(self.cfg.allow_short), _SHORT).otherwise(0)
        event = F.struct("i", F.col(TIME).alias("time"), "px", o.cast("int").alias("o"), F.col("exit_long").alias("xl"), F.col("exit_short").alias("xs"))
        rows = self._bars.where("px is not null and (entry_long or entry_short or exit_long or exit_short)")
        blocks = rows.groupBy(*_SERIES, F.expr(f"i div {SIZE}").alias("block")).agg(F.array_sort(F.collect_list(event)).alias("events"))
        ways = F.expr(f"array({', '.join(f'aggregate(events, {s}, (x, t) -> {_next("x", "t")})' for s in (_FLAT, _LONG, _SHORT))})")
        before = Window.partitionBy(*_SERIES).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.withColumn("ways", ways).withColumn("ways", F.collect_list("ways").over(before))
        blocks = blocks.withColumn("start", F.expr(f"aggregate(ways, {_FLAT}, (s, f) -> f[s])"))
        return blocks.select(*_SERIES, F.explode(F.expr(_actions("events", "start"))).alias("a")).select(*_SERIES, "a.*")

    @cached_property
    def _all(self) -> DataFrame:
        """Staged trades of all series, with cash before and after, and whether the account could pay for them."""
        cfg = self.cfg
        slip, fee, half = cfg.slippage_bps / 10_000.0, cfg.fee_bps / 10_000.0, cfg.spread * 0.5
        w = Window.partitionBy(*_SERIES).orderBy("i")
        rows = self._opened_and_closed().withColumn("then", F.lead(F.struct("i", "time", "px")).over(w)).where("opened > 0").alias("t")
        rows = rows.join(self._ends.alias("e"), same_series("t", "e")).select("t.*", "e.last", F.col("then").isNull().alias("forced"))
        rows = rows.withColumn("out", F.coalesce("then", "last")).withColumn("s", F.when(F.col("opened") == _LONG, 1.0).otherwise(-1.0))
        s = F.col("s")
        costs = lambda price: price * F.col("qty") * fee + F.lit(cfg.commission_per_lot) * (F.col("qty") / cfg.lot)
        rows = rows.withColumn("entry_price", F.col("px") * (1.0 + s * slip) + s * half).withColumn("exit_price", F.col("out.px") * (1.0 - s * slip) - s * half)
        rows = rows.withColumn("qty", F.lit(cfg.sizing_value * cfg.lot) if cfg.sizing_mode == "lots" else F.lit(cfg.trade_cash) / F.nullif(F.col("entry_price"), F.lit(0.0)))
        rows = rows.withColumns({"entry_fee": costs(F.col("entry_price")), "gross_pnl": s * (F.col("exit_price") - F.col("entry_price")) * F.col("qty"), "fees": costs(F.col("entry_price")) + costs(F.col("exit_price"))})
        rows = rows.withColumn("pnl", F.col("gross_pnl") - F.col("fees"))
        earned = F.sum("pnl").over(w.rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("cash", F.lit(float(cfg.initial_cash)) + F.coalesce(earned, F.lit(0.0)))
        fits = F.coalesce((F.col("qty") > 0) & (F.col("cash") > 0) & (F.col("entry_fee") <= F.col("cash")), F.lit(False))
        always = cfg.sizing_mode != "lots" and cfg.commission_per_lot == 0  # the same fee at every entry
        rows = rows.withColumn("fits", fits)
        so_far = lambda upto: F.coalesce(F.min("fits").over(w.rowsBetween(Window.unboundedPreceding, upto)), F.lit(True))
        rows = rows.withColumns({"kept": so_far(0), "doubt": so_far(-1) & ~F.col("fits") & (F.col("cash") > 0) & F.lit(not always)}).where("kept or doubt")
        value = F.col("entry_price") * F.col("qty")
        return stage(
            rows.select(
                *_SERIES, F.when(s > 0, "long").otherwise("short").alias("side"), F.col("time").alias("entry_time"), F.col("out.time").alias("exit_time"), F.col("i").alias("entry_i"), F.col("out.i").alias("exit_i"), "entry_price", "exit_price", F.lit(None).cast("double").alias("stop_price"),
                "qty", "gross_pnl", "fees", "pnl", F.when(value != 0, F.col("pnl") / value * 100).alias("return_pct"), F.expr("out.i - i").alias("bars_held"), F.when(F.col("forced"), "forced_close_end").otherwise("signal").alias("close_reason"),
                "s", "forced", "entry_fee", "cash", "kept",
            ),
            "linked-trades",
        )

    @cached_property
    def refused(self) -> DataFrame | None:
        """The series that are left to the fold; None if there are none."""
        bad = self._all.where("not kept").select(*_SERIES).distinct()
        return None if bad.isEmpty() else stage(bad, "refused")

    def _without_refused(self, df: DataFrame) -> DataFrame:
        return df if self.refused is None else df.alias("t").join(self.refused.alias("x"), same_series("t", "x"), "left_anti")

    def trades(self, columns: list[str]) -> DataFrame:
        return self._without_refused(self._all).select(*_SERIES, *columns)

    def accounts(self) -> DataFrame:
        earned = self._all.where("kept").groupBy(*_SERIES).agg(F.sum("pnl").alias("pnl"))
        rows = self._without_refused(self._ends).alias("e").join(earned.alias("p"), same_series("e", "p"), "left")
        return rows.select(*[F.col(f"e.{c}") for c in _SERIES], (F.lit(float(self.cfg.initial_cash)) + F.coalesce("p.pnl", F.lit(0.0))).alias("final_cash"), F.col("e.n_bars").cast("long").alias("n_bars"))

    @cached_property
    def _curve(self) -> DataFrame:
        """Staged equity and open trades of each bar, with its block."""
        w = Window.partitionBy(*_SERIES).orderBy("entry_i")
        own = F.struct("entry_i", "exit_i", "forced", "s", "entry_price", "qty", (F.col("cash") - F.col("entry_fee")).alias("held"), (F.col("cash") + F.col("pnl")).alias("after"))
        trades = self._without_refused(self._all).withColumn("m", own)
        trades = trades.withColumn("p", F.lag("m").over(w)).withColumn("upto", F.lead("entry_i").over(w)).alias("t").join(self._ends.alias("e"), same_series("t", "e"))
        trades = trades.select(*[F.col(f"t.{c}") for c in _SERIES], "entry_i", "m", "p", F.expr(f"coalesce(upto, n_bars - 1) div {SIZE}").alias("end"))
        # a trade stands at its bar, and at the head of every later block up to that of the next
        heads = F.expr(f"filter(sequence(entry_i div {SIZE}, greatest(end, entry_i div {SIZE})), b -> b > entry_i div {SIZE})")
        at = trades.select(*_SERIES, F.expr(f"entry_i div {SIZE}").alias("block"), F.col("entry_i").alias("i"), F.lit(1).alias("rank"), "m", "p")
        at = at.unionByName(trades.select(*_SERIES, F.explode(heads).alias("block"), "m", "p").withColumns({"i": F.expr(f"block * {SIZE}"), "rank": F.lit(0)}))
        bars = self._without_refused(self._bars).select(*_SERIES, F.expr(f"i div {SIZE}").alias("block"), "i", F.lit(2).alias("rank"), F.col(TIME).alias("t"), "px")
        both = bars.unionByName(at, allowMissingColumns=True)
        upto = Window.partitionBy(*_SERIES, "block").orderBy("i", "rank").rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumn("last", F.last(F.when(F.col("rank") < 2, F.struct("m", "p")), ignorenulls=True).over(upto)).where("rank = 2")
        # at the start of a bar a trade that begins there is not yet open; one that ends there still is
        both = both.withColumn("l", F.expr("if(last.m.entry_i < i, last.m, last.p)")).withColumn("m", F.col("last.m"))
        first = F.lit(float(self.cfg.initial_cash))
        open_ = F.expr("l.forced or l.exit_i >= i")
        equity = F.when(F.col("l").isNull(), first).when(open_ & F.col("px").isNull(), F.col("l.held")).when(open_, F.expr("l.held + l.s * (px - l.entry_price) * l.qty")).otherwise(F.col("l.after"))
        count = F.coalesce(F.expr("cast(m.forced or m.exit_i > i as long)"), F.lit(0)).cast("long")
        return stage(both.select(*_SERIES, "block", "i", "t", equity.alias("equity"), count.alias("open_trades")), "linked-curve")

    def curve(self) -> DataFrame:
        return self._curve.select(*_SERIES, "t", "equity", "open_trades")

    def equity(self) -> DataFrame:
        """The curve with its drawdown: block by block, from the highest of the blocks before."""
        tops = self._curve.groupBy(*_SERIES, "block").agg(F.max("equity").alias("top"))
        tops = tops.withColumn("top", F.max("top").over(Window.partitionBy(*_SERIES).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
        inside = F.max("equity").over(Window.partitionBy(*_SERIES, "block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
        rows = self._curve.withColumn("peak", inside).alias("t").join(tops.alias("b"), same_series("t", "b", "block")).withColumn("peak", F.greatest("peak", "top"))
        return rows.select(*[F.col(f"t.{c}") for c in _SERIES], "t", "equity", "open_trades", F.when(F.col("peak") > 0, (F.col("peak") - F.col("equity")) / F.col("peak")).otherwise(0.0).alias("drawdown"))

    def drop(self) -> None:
        for name in ("_curve", "_all", "_months", "refused", "_staged"):
            if self.__dict__.get(name) is not None:
                drop(self.__dict__.pop(name))
