"""Long series in chunks: windows over one symbol's bars as work for many tasks.

Functions of this library order bars by symbol, so a symbol that holds a large part of all rows would be one
task's work. in_chunks() numbers the bars without a window over a whole symbol, cuts each series into
chunks of rows, gives every chunk the rows before it that the functions look back on, and lets each chunk
pass for a symbol of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import KEY, TIME


def numbered(bars: DataFrame, bucket: str = "month", out: str = "_i") -> DataFrame:
    """Bars with their 0-based place in their symbol's series, counted by calendar bucket."""
    b = F.date_trunc(bucket, TIME)
    rows = bars.withColumn("_bucket", b)
    counts = rows.groupBy(KEY, "_bucket").agg(F.count("*").alias("_n"))
    before = counts.select(KEY, "_bucket", (F.sum("_n").over(Window.partitionBy(KEY).orderBy("_bucket")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(KEY, "_bucket").orderBy(TIME)) - 1
    rows = rows.withColumn("_in", inside).join(before, [KEY, "_bucket"])
    return rows.withColumn(out, F.col("_in") + F.col("_before")).drop("_bucket", "_in", "_before")


def in_chunks(bars: DataFrame, plan: Callable[[DataFrame], DataFrame], lookback: int, size: int = 1_000_000, bucket: str = "month") -> DataFrame:
    """plan(bars), computed chunk by chunk.

    plan must look back at most lookback rows (an exponential mean of period p needs some 20 * p for double
    precision), not ahead, and keep the columns symbol, open_time and what it was given. Bars of null symbol
    or time are left out.
    """
    if not 0 <= lookback <= size:
        raise ValueError("lookback must be between 0 and the chunk size")
    rows = numbered(bars.where(f"{KEY} is not null and {TIME} is not null"), bucket)
    own = F.expr(f"_i div {size}")
    ahead = F.expr(f"(_i + {lookback}) div {size}")
    rows = rows.withColumn("_own", own).withColumn("_chunk", F.explode(F.sequence(own, ahead)))
    rows = rows.withColumn("_halo", F.col("_chunk") != F.col("_own")).withColumn("_symbol", F.col(KEY))
    rows = rows.withColumn(KEY, F.concat_ws("\x1f", KEY, F.col("_chunk").cast("string"))).drop("_i", "_own", "_chunk")
    done = plan(rows).where("not _halo").withColumn(KEY, F.col("_symbol"))
    return done.drop("_halo", "_symbol")
