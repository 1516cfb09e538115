"""Bars from ticks and from tables that are read as ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.columns import KEY, TIME
from barloom.operators.recurrence import running_sum
from barloom.operators.timeframe import span


def bars_from_ticks(ticks: DataFrame, rule: str, symbol: str = "symbol", time: str = "ts", price: str = "price", size: str | None = "size", tie: str | None = None) -> DataFrame:
    """Bars of a rule's length; ticks of one time are in order of the tie column. Combined before the shuffle."""
    width = span(rule)
    order = F.struct(time, tie) if tie else F.col(time)
    volume = F.sum(size) if size else F.lit(0.0)
    grouped = ticks.groupBy(F.col(symbol).alias(KEY), F.window(time, width).getField("start").alias(TIME))
    out = grouped.agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), volume.cast("double").alias("volume"))
    return out.select(KEY, TIME, "open", "high", "low", "close", "volume")


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as ticks: a random walk by event type, driven by the values in order of time."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("symbol"), "ts", "event_id", "value")
    walk = running_sum(events, "walk", (F.col("value") - 50) / 25000, "symbol", ("ts", "event_id"), F.trunc("ts", "month"))
    return walk.select("symbol", "ts", "event_id", F.round(100 * F.exp("walk"), 6).alias("price"), F.col("value").alias("size"))


def event_bars(spark: SparkSession, sf_dir: str, rule: str = "1h") -> DataFrame:
    return bars_from_ticks(event_ticks(spark, sf_dir), rule, tie="event_id")


def order_bars(spark: SparkSession, sf_dir: str, rule: str = "1D") -> DataFrame:
    """The orders table as daily bars of total prices by priority."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"), "o_orderkey", F.col("o_totalprice").alias("price"), F.lit(1.0).alias("size"))
    return bars_from_ticks(orders, rule, tie="o_orderkey")


def spacing(rule: str) -> Column:
    """A rule's length as an interval."""
    return F.expr(f"interval {span(rule)}")
