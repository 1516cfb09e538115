"""Where profit comes from: trades grouped by time, session and market regime."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import KEY, bars_window
from barloom.functions.indicators import add_atr, add_ema
from barloom.functions.time_filters import SESSIONS, local_time
from barloom.operators.quantiles import exact_quantiles
from barloom.operators.statistics import trade_stats
from barloom.staging import stage

#: The names of the days.
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def bucket_stats(trades: DataFrame, key: Column, label: str) -> DataFrame:
    """Trade statistics by any expression of a trade."""
    return trades.groupBy(key.alias(label)).agg(*trade_stats(F.col("pnl")))


def by_hour(trades: DataFrame, tz: str | None = None) -> DataFrame:
    return bucket_stats(trades, F.hour(local_time("entry_time", tz)).cast("long"), "hour")


def by_weekday(trades: DataFrame, tz: str | None = None) -> DataFrame:
    """By weekday, 0 for Monday, with its name."""
    name = F.element_at(F.array(*[F.lit(d) for d in DAYS]), (F.col("weekday") + 1).cast("int"))
    return bucket_stats(trades, F.weekday(local_time("entry_time", tz)).cast("long"), "weekday").withColumn("day", name)


def by_month(trades: DataFrame, tz: str | None = None) -> DataFrame:
    """By month of the year."""
    return bucket_stats(trades, F.month(local_time("entry_time", tz)).cast("long"), "month")


def by_session(trades: DataFrame, tz: str | None = None) -> DataFrame:
    """By trading session: a trade counts in each session that its hour is in; all sessions are shown."""
    hour = F.hour(local_time("entry_time", tz))
    inside = [F.when((hour >= a) & (hour < b) if a <= b else (hour >= a) | (hour < b), F.lit(s)) for s, (a, b) in SESSIONS.items()]
    marked = trades.select("pnl", F.explode(F.array_compact(F.array(*inside))).alias("session"))
    found = marked.groupBy("session").agg(*trade_stats(F.col("pnl")))
    names = trades.sparkSession.createDataFrame([(s,) for s in SESSIONS], "session string")
    zero = {"n_trades": 0, "win_rate_pct": 0.0, "total_pnl": 0.0, "avg_pnl": 0.0, "profit_factor": 0.0}
    return names.join(found, "session", "left").fillna(zero)


def by_regime(trades: DataFrame, bars: DataFrame, ema_period: int = 200, atr_period: int = 14, vol_buckets: int = 3) -> DataFrame:
    """By trend (close against its mean) and volatility (quantile of range over price) at entry.

    A trend that is not yet known is a downtrend, an unknown volatility is low; with fewer known volatilities
    than buckets it is n/a. Volatilities are ranked over all trades. Runs at once: the edges are found first.
    """
    names = ("lowvol", "midvol", "highvol")[:vol_buckets]
    if not 1 <= vol_buckets <= 3:
        raise ValueError("vol_buckets must be 1, 2 or 3")
    seen = add_atr(add_ema(bars, ema_period, out="_mean"), atr_period, "_range")
    seen = seen.select(KEY, (F.row_number().over(bars_window()) - 1).alias("entry_i"), (F.coalesce(F.col("close") >= F.col("_mean"), F.lit(False))).alias("_up"), (F.col("_range") / F.col("close")).alias("_vol"))
    at = stage(trades.join(seen, [KEY, "entry_i"], "left").select("pnl", "_up", "_vol"), "regimes")  # read twice below
    edges, known = exact_quantiles(at, F.col("_vol"), [k / vol_buckets for k in range(vol_buckets + 1)])
    # the bucket is the number of distinct edges below
    place = reduce(lambda n, e: n + (F.col("_vol") > e).cast("int"), dict.fromkeys(e for e in edges if e is not None), F.lit(0))
    name = F.element_at(F.array(*[F.lit(x) for x in names]), F.greatest(F.lit(1), F.least(place, F.lit(len(names)))))
    vol = F.lit("n/a") if known < vol_buckets else F.when(F.col("_vol").isNull(), F.lit("lowvol")).otherwise(name)
    return bucket_stats(at, F.concat(F.when(F.coalesce("_up", F.lit(False)), F.lit("uptrend")).otherwise(F.lit("downtrend")), F.lit("/"), vol), "regime")


def hour_weekday(trades: DataFrame, metric: str = "total_pnl", tz: str | None = None) -> DataFrame:
    """Seven rows by weekday with a column for each hour: summed pnl, trades, or percent of winners."""
    value = {"total_pnl": F.sum("pnl"), "n_trades": F.count("pnl").cast("double"), "win_rate_pct": F.avg((F.col("pnl") > 0).cast("double")) * 100}
    if metric not in value:
        raise ValueError(f"metric must be one of {', '.join(value)}")
    t = local_time("entry_time", tz)
    grid = trades.select(F.weekday(t).cast("long").alias("weekday"), F.hour(t).alias("h"), "pnl").groupBy("weekday").pivot("h", list(range(24))).agg(value[metric])
    days = trades.sparkSession.range(7).withColumnRenamed("id", "weekday")
    named = [F.col(str(h)).cast("double").alias(f"h{h:02d}") for h in range(24)]
    return days.join(grid, "weekday", "left").select("weekday", *named)


def close_reasons(trades: DataFrame) -> DataFrame:
    return trades.groupBy("close_reason").agg(F.count("*").alias("n_trades")).orderBy(F.desc("n_trades"), "close_reason")


def best_of(table: DataFrame, label: str, metric: str = "total_pnl") -> DataFrame:
    """The label with the highest metric."""
    return table.agg(F.max_by(label, metric).alias(label), F.max(metric).alias(metric))


