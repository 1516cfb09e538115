"""Linear recurrences y[i] = q * y[i-1] + u[i] and running sums as window expressions.

A series is cut into blocks in which q**-k stays inside the range of doubles. Within a block the recurrence
is a scaled running sum; what a block hands to the next is its last value, and what came before that has
decayed below double precision. Everything is a running window over rows sorted by symbol and time, which
Spark streams and spills: one sort, no array of a symbol's rows, no Python.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import KEY, TIME, bars_window

#: exp(-RANGE) is what is left of a block's first carry after a block.
RANGE = 250.0


def linear_recurrence(df: DataFrame, out: str, q: float, first: Column, later: Column, present: Column, keep_rank: str | None = None) -> DataFrame:
    """df with the recurrence over the rows (by symbol, in time order) where present holds, null elsewhere.

    first and later are u for the first such row and for the others. keep_rank names a column for the
    1-based number of the row among those present.
    """
    rank, part = f"_{out}_n", f"_{out}_p"
    size = max(1, int(RANGE / abs(math.log(q)))) if 0 < q < 1 else 1 << 40
    w = bars_window()
    on = F.coalesce(present, F.lit(False))
    names = [c for c in df.columns if c != out]
    df = df.select(*names, F.when(on, F.sum(on.cast("long")).over(w)).alias(rank), F.when(on, first).alias("_u0"), F.when(on, later).alias("_u1"))
    block, place = F.expr(f"({rank} - 1) div {size}"), (F.col(rank) - 1) % size
    up = F.pow(F.lit(q), place.cast("double")) if 0 < q < 1 else F.lit(1.0)
    u = F.when(F.col(rank) == 1, F.col("_u0")).otherwise(F.col("_u1"))
    local = Window.partitionBy(KEY, block).orderBy(TIME)
    df = df.select(*names, rank, F.when(F.col(rank).isNotNull(), up * F.sum(u / up).over(local)).alias(part))
    last = F.last(F.when(place == size - 1, F.col(part)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    carry = F.coalesce(F.when(block > 0, last), F.lit(0.0))
    kept = [F.col(rank).alias(keep_rank)] if keep_rank else []
    return df.select(*names, (F.col(part) + carry * up * q).alias(out), *kept)


def decayed_mean(df: DataFrame, out: str, source: Column, alpha: float, least: int, adjust: bool = False) -> DataFrame:
    """The exponentially weighted mean of the source's values that are not null, null for the first least - 1.

    Without adjust the mean starts at the first value; with it, values are weighted by their age alone.
    """
    rank = f"_{out}_r"
    on = source.isNotNull()
    names = [c for c in df.columns if c != out]
    if alpha >= 1:
        seen = F.sum(on.cast("long")).over(bars_window())
        return df.select(*names, F.when(seen >= least, source).alias(out))
    q = 1 - alpha
    df = linear_recurrence(df, out, q, source, source if adjust else source * alpha, on, rank)
    weight = (1 - F.pow(F.lit(q), F.col(rank).cast("double"))) / (1 - q) if adjust else F.lit(1.0)
    return df.select(*names, F.when(F.col(rank) >= least, F.col(out) / weight).alias(out))


def running_sum(df: DataFrame, out: str, value: Column, key: str, order: tuple[str, ...], block: Column) -> DataFrame:
    """Running sum by key in the given order, in parallel: block must be monotonic in the order.

    Each block is summed by itself and the blocks' totals, few by comparison, are summed up and joined.
    """
    b, v, p = f"_{out}_b", f"_{out}_v", f"_{out}_p"
    df = df.withColumn(b, block).withColumn(v, value)
    df = df.withColumn(p, F.sum(v).over(Window.partitionBy(key, b).orderBy(*order)))
    totals = df.groupBy(key, b).agg(F.sum(v).alias("_total"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_total").over(Window.partitionBy(key).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return df.join(before.drop("_total"), [key, b]).withColumn(out, F.col(p) + F.col("_before")).drop(b, v, p, "_before")
