"""Indicators and signals on streams of bars.

Spark has no row windows over a stream, but each micro-batch is a table. follow() gives every micro-batch the
last bars of its symbols before it, runs an ordinary plan over both, and keeps what the plan says of the new
bars. So every indicator, signal and strategy of the library runs on a stream as it is, and gives what it gives
on a table. read() is the result as a stream again, as stream_trades takes it.

The last bars are kept as a table a micro-batch next to the result, not in the state store: what a micro-batch
reads and writes depends on its number only, so a batch that is run again after a failure gives the same rows,
and one that was finished is not run again. A result appears whole, by one rename of its folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barloom.functions.columns import KEY, TIME
from barloom.staging import delete, drop, stage


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _exists(spark: SparkSession, path: str) -> bool:
    fs, target = _files(spark, path)
    return fs.exists(target)


def _publish(df: DataFrame, path: str) -> None:
    """Write df, whole or not at all, unless it is there."""
    spark = df.sparkSession
    made = f"{path.rsplit('/', 2)[0]}/_making/{uuid.uuid4().hex}"
    df.write.parquet(made)
    fs, target = _files(spark, path)
    fs.mkdirs(target.getParent())
    if not fs.rename(_files(spark, made)[1], target):
        raise OSError(f"cannot publish {path}")


def _step(plan: Callable[[DataFrame], DataFrame], path: str, lookback: int) -> Callable[[DataFrame, int], None]:
    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows, kept = (lambda n: f"{path}/rows/batch={n}"), (lambda n: f"{path}/last/batch={n}")
        if _exists(spark, rows(number)):
            return
        new = batch.where(f"{KEY} is not null and {TIME} is not null").withColumn("_new", F.lit(True))
        before = None
        if number:
            if not _exists(spark, kept(number - 1)):
                raise ValueError(f"{path} does not have the bars before micro-batch {number}; it belongs to another checkpoint")
            before = spark.read.schema(batch.schema).parquet(kept(number - 1))
            new = stage(new, "arrived")  # read for its symbols, too
            ended = before.groupBy(KEY).agg(F.max(TIME).alias("_ended"))
            fresh = new.join(ended, KEY, "left").where(f"_ended is null or {TIME} > _ended").select(*new.columns)
            both = fresh.unionByName(before.withColumn("_new", F.lit(False)))
        else:
            both = new
        both = stage(both, "followed")
        if not _exists(spark, kept(number)):
            age = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc(TIME)))
            _publish(both.withColumn("_age", age).where(F.col("_age") <= lookback).select(*batch.columns), kept(number))
        seen = both.where("_new").select(KEY).distinct()
        _publish(plan(both.join(seen, KEY, "left_semi")).where("_new").drop("_new"), rows(number))
        if number > 1:
            delete(spark, kept(number - 2))
        for used in (both, new):
            drop(used)

    return step


def follow(bars: DataFrame, plan: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, lookback: int, **trigger) -> StreamingQuery:
    """Start plan(bars) on a stream of bars, written under path; path and checkpoint belong together.

    plan is made of this library's functions: it must look back at most lookback bars, not ahead, and keep the
    columns it was given. An exponential mean of period p needs some 20 * p bars for double precision. Bars of
    a symbol must arrive in order of time from one micro-batch to the next, as stream_bars gives them; bars no
    later than the symbol's last one are late, and left out as by a watermark, as are those of null symbol or
    time. trigger is that of writeStream: availableNow=True, or processingTime.

    A micro-batch reads and writes the last bars of all symbols, and plans over those that have new ones.
    """
    if lookback < 1:
        raise ValueError("lookback must be at least 1")
    writer = bars.writeStream.foreachBatch(_step(plan, path.rstrip("/"), lookback)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def table(spark: SparkSession, path: str) -> DataFrame:
    """What is there so far of a followed stream."""
    return spark.read.parquet(f"{path.rstrip('/')}/rows").drop("batch")


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """A followed stream as a stream: each symbol's bars in order. At least one micro-batch must be finished."""
    schema = spark.read.parquet(f"{path.rstrip('/')}/rows").schema
    return spark.readStream.schema(schema).options(**options).parquet(f"{path.rstrip('/')}/rows").drop("batch")
