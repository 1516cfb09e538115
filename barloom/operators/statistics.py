"""Statistics of trades and equity curves: grouped aggregations, one row a run and symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import KEY
from barloom.operators.backtest import RUN, year_over
from barloom.staging import stage


def _inf() -> Column:
    return F.lit(float("inf"))


def profit_factor(pnl: Column) -> Column:
    """Gains over losses; infinite without losses, 0 without gains."""
    gain, loss = F.coalesce(F.sum(F.when(pnl > 0, pnl)), F.lit(0.0)), F.coalesce(-F.sum(F.when(pnl < 0, pnl)), F.lit(0.0))
    return F.when(loss > 0, F.try_divide(gain, loss)).when(gain > 0, _inf()).otherwise(0.0)


def trade_stats(pnl: Column) -> list[Column]:
    """The columns that every attribution table has."""
    n = F.count(pnl)
    return [n.alias("n_trades"), F.coalesce(F.avg(F.when(pnl.isNotNull(), (pnl > 0).cast("double"))) * 100, F.lit(0.0)).alias("win_rate_pct"), F.coalesce(F.sum(pnl), F.lit(0.0)).alias("total_pnl"), F.coalesce(F.avg(pnl), F.lit(0.0)).alias("avg_pnl"), profit_factor(pnl).alias("profit_factor")]


def longest_runs(trades: DataFrame, keys: tuple[str, ...] = (RUN, KEY), order: tuple[str, ...] = ("entry_i",)) -> DataFrame:
    """The longest rows of winners and of losers: islands between changes, counted."""
    w = Window.partitionBy(*keys).orderBy(*order)
    kind = F.signum(F.col("pnl"))
    marked = trades.where("pnl is not null").withColumn("_k", kind).withColumn("_new", (F.col("_k") != F.coalesce(F.lag("_k").over(w), F.lit(9.0))).cast("int"))
    island = marked.withColumn("_g", F.sum("_new").over(w)).groupBy(*keys, "_g", "_k").agg(F.count("*").alias("_n"))
    return island.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("_k") > 0, F.col("_n"))), F.lit(0)).alias("max_consecutive_wins"), F.coalesce(F.max(F.when(F.col("_k") < 0, F.col("_n"))), F.lit(0)).alias("max_consecutive_losses"))


def _moments(groups: DataFrame, keys: tuple[str, ...], n: str, mean: str, square: str, spread: str) -> DataFrame:
    """Number, mean and sample deviation of series from those of their parts (square: summed squared deviations)."""
    whole = Window.partitionBy(*keys)
    share = F.coalesce(F.try_divide(F.sum(F.col(n) * F.col(mean)).over(whole), F.sum(n).over(whole)), F.lit(0.0))
    parts = groups.select(*keys, n, mean, square, share.alias("_m"))
    gap = F.coalesce(F.col(n) * (F.col(mean) - F.col("_m")) * (F.col(mean) - F.col("_m")), F.lit(0.0))
    total = F.sum(F.coalesce(square, F.lit(0.0)) + gap)
    return parts.groupBy(*keys).agg(F.sum(n).alias(n), F.max("_m").alias(mean), F.when(F.sum(n) > 1, F.sqrt(total / (F.sum(n) - 1))).alias(spread))


def curve_stats(equity: DataFrame, keys: tuple[str, ...] = (RUN, KEY), time: str = "t", block: str = "month") -> DataFrame:
    """Largest drawdown, the ratios of the returns a bar, and bars a year.

    The curve is read once, and at once: the rows of each block of a calendar unit that are as far from the one
    before are summed up by number, mean and squared deviations, with the block's ends, extremes and fall. These
    parts are staged, and merged with what lies between a block and the next: nothing goes over a whole curve.
    """
    moved = lambda now, before: F.try_divide(now - before, F.nullif(before, F.lit(0.0)))
    apart = lambda a, b: F.timestamp_diff("MICROSECOND", a, b) / 1e6
    fell = lambda peak, e: F.when(peak > 0, (peak - e) / peak).otherwise(0.0)
    w = Window.partitionBy(*keys, "_b").orderBy("_t")
    rows = equity.select(*keys, F.col(time).alias("_t"), F.col("equity").alias("e"), F.date_trunc(block, time).alias("_b"))
    peak = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"r": moved(F.col("e"), F.lag("e").over(w)), "s": apart(F.lag("_t").over(w), F.col("_t")), "fall": fell(peak, F.col("e"))})
    down = F.when(F.col("r") < 0, F.col("r"))
    own = lambda x, n, m, q: [F.count(x).alias(n), F.avg(x).alias(m), (F.var_pop(x) * F.count(x)).alias(q)]
    end = F.struct("_t", "e")
    parts = stage(rows.groupBy(*keys, "_b", "s").agg(F.count("*").alias("bars"), F.max("fall").alias("dd"), *own(F.col("r"), "n", "mean", "q"), *own(down, "dn", "dmean", "dq"), F.min(end).alias("head"), F.max(end).alias("tail"), F.max("e").alias("top"), F.min("e").alias("low")), "curve-parts")
    order = Window.partitionBy(*keys).orderBy("_b")
    blocks = parts.groupBy(*keys, "_b").agg(F.min("head").alias("head"), F.max("tail").alias("tail"), F.max("top").alias("top"), F.min("low").alias("low"))
    seams = blocks.select(*keys, moved(F.col("head.e"), F.lag("tail.e").over(order)).alias("r"), apart(F.lag("tail._t").over(order), F.col("head._t")).alias("s"), fell(F.max("top").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("low")).alias("dd"))
    zero = lambda c: F.when(c, 0.0).alias
    seams = seams.select(*keys, "s", "dd", F.col("r").isNotNull().cast("long").alias("n"), F.col("r").alias("mean"), zero(F.col("r").isNotNull())("q"), F.coalesce(F.col("r") < 0, F.lit(False)).cast("long").alias("dn"), down.alias("dmean"), zero(F.col("r") < 0)("dq"), F.col("s").isNotNull().cast("long").alias("bars"))
    groups = stage(parts.where("s is not null").select(*seams.columns).unionByName(seams).unionByName(parts.where("s is null").select(*[F.lit(0).cast("long").alias(c) if c == "bars" else F.col(c) for c in seams.columns])), "curve-groups")
    sums = groups.groupBy(*keys).agg(F.max("dd").alias("dd"))
    for names in (("n", "mean", "q", "sd"), ("dn", "dmean", "dq", "down")):
        sums = sums.join(_moments(groups, keys, *names), list(keys))
    # the median spacing, from the number of each
    counted = groups.where("bars > 0").groupBy(*keys, "s").agg(F.sum("bars").alias("bars"))
    counted = counted.withColumns({"upto": F.sum("bars").over(Window.partitionBy(*keys).orderBy("s")), "all": F.sum("bars").over(Window.partitionBy(*keys))})
    middle = lambda place: F.min(F.when(F.col("upto") > place, F.col("s")))
    median = counted.groupBy(*keys).agg((middle(F.floor((F.col("all") - 1) / 2)) * 0.5 + middle(F.ceil((F.col("all") - 1) / 2)) * 0.5).alias("median"), F.max("all").alias("steps"))
    both = sums.join(median, list(keys), "left").withColumn("periods_per_year", year_over(F.col("median"), F.col("steps") + 1))
    scale, enough = F.sqrt("periods_per_year"), F.col("n") > 1
    ratio = lambda by: F.when(enough & (F.col(by) > 0), F.try_divide(F.col("mean"), F.col(by)) * scale).otherwise(0.0)
    calmar = F.when(enough & (F.col("dd") > 0), F.try_divide(F.col("mean") * F.col("periods_per_year"), F.col("dd"))).otherwise(0.0)
    return both.select(*keys, (F.coalesce("dd", F.lit(0.0)) * 100).alias("max_drawdown_pct"), ratio("sd").alias("sharpe"), ratio("down").alias("sortino"), calmar.alias("calmar"), "periods_per_year")


def trade_table_stats(trades: DataFrame, keys: tuple[str, ...] = (RUN, KEY)) -> DataFrame:
    """Everything that trades alone tell."""
    pnl, win, loss = F.col("pnl"), F.col("pnl") > 0, F.col("pnl") < 0
    number = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("double"))
    some = lambda f, c, v: F.coalesce(f(F.when(c, v)), F.lit(0.0))
    sides = []
    for side in ("long", "short"):
        own = F.col("side") == side
        sides += [number(own).alias(f"{side}_trades"), some(F.sum, own, pnl).alias(f"{side}_pnl"), F.coalesce(F.avg(F.when(own, win.cast("double"))) * 100, F.lit(0.0)).alias(f"{side}_win_rate_pct")]
    out = trades.where("pnl is not null").groupBy(*keys).agg(
        F.sum(pnl).alias("total_pnl"), F.count("*").cast("double").alias("num_trades"), number(win).alias("num_winners"), number(loss).alias("num_losers"), number(pnl == 0).alias("num_breakeven"),
        (F.avg(win.cast("double")) * 100).alias("win_rate_pct"), (F.avg(loss.cast("double")) * 100).alias("loss_rate_pct"),
        some(F.sum, win, pnl).alias("gross_profit"), some(F.sum, loss, -pnl).alias("gross_loss"), profit_factor(pnl).alias("profit_factor"),
        F.avg(pnl).alias("avg_pnl"), F.percentile(pnl, 0.5).alias("median_pnl"), some(F.avg, win, pnl).alias("avg_winner"), some(F.avg, loss, pnl).alias("avg_loser"), some(F.max, win, pnl).alias("largest_winner"), some(F.min, loss, pnl).alias("largest_loser"),
        F.avg(pnl).alias("expectancy_per_trade"), F.avg(F.nanvl("return_pct", F.lit(None))).alias("avg_return_pct"), F.avg(F.col("bars_held").cast("double")).alias("avg_bars_held"), F.sum("fees").alias("total_fees"), F.avg("fees").alias("avg_fee_per_trade"), *sides,
    )
    return out.join(longest_runs(trades, keys), list(keys), "left")


def compute_stats(result) -> DataFrame:
    """All statistics of a backtest, one row a run and symbol; those of trades are 0 or null without trades."""
    keys = (RUN, KEY)
    out = result.accounts.join(curve_stats(result.curve), list(keys), "left").join(trade_table_stats(result.trades), list(keys), "left")
    out = out.withColumn("total_return_pct", F.when(F.col("initial_cash") > 0, (F.col("final_cash") / F.col("initial_cash") - 1) * 100).otherwise(0.0))
    fall = F.abs(F.col("max_drawdown_pct") / 100 * F.col("initial_cash"))
    recovery = F.when(F.col("max_drawdown_pct") > 0, F.try_divide(F.col("total_pnl"), fall)).when(F.col("total_pnl") > 0, _inf()).otherwise(0.0)
    zero = ["total_pnl", "num_trades", "num_winners", "num_losers", "win_rate_pct", "loss_rate_pct", "profit_factor", "expectancy_per_trade", "total_fees"]
    out = out.withColumn("recovery_factor", F.when(F.col("num_trades").isNotNull(), recovery)).withColumn("expectancy_pct_initial_cash", F.when(F.col("initial_cash") > 0, F.col("avg_pnl") / F.col("initial_cash") * 100).otherwise(0.0))
    return out.fillna(0.0, zero)


def monthly_returns(equity: DataFrame, keys: tuple[str, ...] = (RUN, KEY), time: str = "t") -> DataFrame:
    """year, month, return_pct: each month's last equity against the month's before, the first against the start.

    Months without bars are there, without a return, and so is what follows them.
    """
    month = F.trunc(time, "month")
    rows = equity.where(f"{time} is not null and equity is not null")
    ends = rows.groupBy(*keys, month.alias("m")).agg(F.max_by("equity", time).alias("e"), F.min(F.struct(time, "equity")).alias("s"))
    edge = ends.groupBy(*keys).agg(F.min("m").alias("a"), F.max("m").alias("b"), F.min("s")["equity"].alias("start"))
    spine = edge.select(*keys, "start", "a", F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("m"))
    filled = spine.join(ends.drop("s"), [*keys, "m"], "left")
    before = F.when(F.col("m") == F.col("a"), F.col("start")).otherwise(F.lag("e").over(Window.partitionBy(*keys).orderBy("m")))
    return filled.select(*keys, F.year("m").cast("long").alias("year"), F.month("m").cast("long").alias("month"), (F.try_divide(F.col("e"), before) * 100 - 100).alias("return_pct"))


def monthly_table(equity: DataFrame, keys: tuple[str, ...] = (RUN, KEY), time: str = "t") -> DataFrame:
    """monthly_returns with a column for each month."""
    return monthly_returns(equity, keys, time).groupBy(*keys, "year").pivot("month", list(range(1, 13))).agg(F.first("return_pct"))
