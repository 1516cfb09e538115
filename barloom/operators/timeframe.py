"""Bars of other lengths: resampling, and bringing higher timeframes to a base without looking ahead."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import KEY, TIME, bars_window, feature_columns

_UNITS = {"s": "second", "sec": "second", "m": "minute", "min": "minute", "t": "minute", "h": "hour", "d": "day", "w": "week"}


def span(rule: str) -> str:
    """A rule such as 5min, 1h or 1D as an interval of Spark."""
    m = re.fullmatch(r"(\d*)\s*([A-Za-z]+)", rule.strip())
    unit = m and _UNITS.get(m[2].lower())
    if not unit or (m[2] in ("M", "ME", "MS")):
        raise ValueError(f"unknown timeframe {rule!r}")
    return f"{int(m[1] or 1)} {unit}"


def bucket_start(rule: str, time: str = TIME, origin: str | None = None) -> Column:
    """The start of the tumbling bucket that a bar falls into. Weeks start on Monday."""
    width = span(rule)
    if origin is None and width.endswith("week"):
        origin = "4 days"  # the epoch was a Thursday
    return F.window(F.col(time), width, width, origin).getField("start") if origin else F.window(F.col(time), width).getField("start")


def resample(bars: DataFrame, rule: str, origin: str | None = None) -> DataFrame:
    """Bars of the rule's length: first open, highest, lowest, last close, summed volume.

    Buckets are closed and labelled on the left; those without an open are left out; other columns are dropped.
    """
    when = lambda c: F.when(F.col(c).isNotNull(), F.col(TIME))
    grouped = bars.withColumn("_bucket", bucket_start(rule, origin=origin)).groupBy(KEY, "_bucket")
    out = grouped.agg(F.min_by("open", when("open")).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", when("close")).alias("close"), F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"))
    return out.where("open is not null").withColumnRenamed("_bucket", TIME).select(KEY, TIME, "open", "high", "low", "close", "volume")


def asof_join(left: DataFrame, right: DataFrame, features: list[str], time: str = TIME, block: str | None = None) -> DataFrame:
    """Each row of left with the features of the last row of right of its symbol at or before its time.

    One union, one sort by symbol, block and time, and a running last: no row is compared with more than its
    neighbours. block, a calendar unit of date_trunc, makes a symbol as many tasks' work as it has blocks: the
    last row of right before a block stands at its head, for which right, and the times of left, are read once
    more. Without it a symbol is one task's. A matched row's null features stay null.
    """
    names = [c for c in left.columns if c not in features]
    pack = F.struct(*[F.col(c) for c in features])
    kind = right.select(pack.alias("p")).schema["p"].dataType
    part = F.date_trunc(block, "_time") if block else F.lit(None).cast("timestamp_ntz")
    a = left.select(F.struct(*names).alias("_row"), F.col(KEY).alias("_key"), F.col(time).alias("_time"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_match"))
    b = right.select(F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(KEY).alias("_key"), F.col(time).alias("_time"), F.lit(0).alias("_side"), pack.alias("_match"))
    both = a.unionByName(b).withColumn("_block", part)
    if block:
        # one row a symbol and block
        last = b.withColumn("_block", part).groupBy("_key", "_block").agg(F.max_by("_match", "_time").alias("_match"))
        blocks = a.select("_key", part.alias("_block")).distinct().withColumn("_match", F.lit(None).cast(kind)).unionByName(last)
        blocks = blocks.groupBy("_key", "_block").agg(F.first("_match", ignorenulls=True).alias("_match"))
        before = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        heads = blocks.withColumn("_match", F.last("_match", ignorenulls=True).over(before)).where("_match is not null")
        both = both.unionByName(heads.withColumns({"_time": F.col("_block"), "_side": F.lit(-1)}), allowMissingColumns=True)
    w = Window.partitionBy("_key", "_block").orderBy("_time", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_match", F.last("_match", ignorenulls=True).over(w)).where("_side = 1")
    return both.select(*[F.col("_row")[c].alias(c) for c in names], *[F.col("_match")[c].alias(c) for c in features])


def _delayed(frame: DataFrame, label: str, shift_bars: int) -> tuple[DataFrame, list[str]]:
    """A frame's features, shift_bars rows late and named for the timeframe."""
    w = bars_window()
    names = feature_columns(frame)
    moved = [(F.lag(c, shift_bars).over(w) if shift_bars else F.col(c)).alias(f"{label}__{c}") for c in names]
    return frame.select(KEY, TIME, *moved), [f"{label}__{c}" for c in names]


def align_timeframes(base: DataFrame, others: dict[str, DataFrame], shift_bars: int = 1, block: str | None = None) -> DataFrame:
    """base with the features of other timeframes as of each bar, by as-of join, shift_bars of their rows late."""
    for label, frame in others.items():
        late, names = _delayed(frame, label, shift_bars)
        base = asof_join(base, late, names, block=block)
    return base


def build_mtf(base: DataFrame, builders: dict[str, Callable[[DataFrame], DataFrame]], shift_bars: int = 1) -> DataFrame:
    """base with features of timeframes made from base itself.

    Every base bar's bucket exists among the resampled ones, so the as-of join is an equi-join on the bucket.
    """
    for rule, builder in builders.items():
        late, names = _delayed(builder(resample(base, rule)), rule, shift_bars)
        late = late.withColumnRenamed(TIME, "_bucket")
        base = base.drop(*names).withColumn("_bucket", bucket_start(rule)).join(late, [KEY, "_bucket"], "left").drop("_bucket")
    return base


def downsample(bars: DataFrame, most: int) -> DataFrame:
    """Every k-th bar of each symbol, with the least k that leaves at most `most` bars of it."""
    w = bars_window()
    total = F.count(F.lit(1)).over(Window.partitionBy(KEY))
    k = F.greatest(F.lit(1), F.ceil(total / most))
    return bars.withColumn("_n", F.row_number().over(w) - 1).withColumn("_k", k).where("_n % _k = 0").drop("_n", "_k")


def viewport(bars: DataFrame, start: str, end: str, target: int) -> DataFrame:
    """Candles of the closed span, at most about target a symbol: as they are, or in buckets of whole minutes."""
    inside = bars.where(F.col(TIME).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    minutes = bars.sparkSession.sql(f"select (unix_seconds(timestamp '{end}') - unix_seconds(timestamp '{start}')) / 60.0 as m").first()[0]
    width = max(1, int(float(minutes) / max(target, 1)))
    counts = inside.groupBy(KEY).agg(F.count("*").alias("_c"))
    # each bar goes into its bucket, or stays by itself where a symbol has few
    at = F.when(F.col("_c") > target, bucket_start(f"{width}min")).otherwise(F.col(TIME))
    placed = inside.join(counts, KEY).withColumn("_at", at)
    grouped = placed.groupBy(KEY, "_at", "_c").agg(F.min_by("open", F.when(F.col("open").isNotNull(), F.col(TIME))).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", F.when(F.col("close").isNotNull(), F.col(TIME))).alias("close"))
    return grouped.where(f"open is not null or _c <= {target}").select(KEY, F.col("_at").alias(TIME), "open", "high", "low", "close")


def extremes(bars: DataFrame, rule: str, column: str = "close") -> DataFrame:
    """For a zoomed-out line: of each bucket the bars of its lowest and highest value, in order of time."""
    per = bars.withColumn("_bucket", bucket_start(rule)).groupBy(KEY, "_bucket").agg(F.min_by(F.struct(TIME, column), F.struct(column, TIME)).alias("a"), F.max_by(F.struct(TIME, column), F.struct(column, TIME)).alias("b"))
    return per.select(KEY, F.explode(F.array_distinct(F.array("a", "b"))).alias("p")).select(KEY, f"p.{TIME}", f"p.{column}")


def _bind(value: str, name: str, body: str) -> str:
    """body with name bound to value, which is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def shape(bars: DataFrame, rule: str, points: int, column: str = "close") -> DataFrame:
    """For a zoomed-out line: of each symbol at most `points` bars that keep its shape.

    The extremes of each bucket are candidates, found by all tasks; they are parted into equal rows, and of each
    row the candidate stays that makes the largest triangle with the one chosen before and the middle of the
    next row. rule bounds the candidates: two a bucket, held by symbol.
    """
    if points < 3:
        raise ValueError("points must be 3 at least")
    point = F.struct(F.col(TIME).alias("t"), F.unix_micros(F.col(TIME).cast("timestamp")).cast("double").alias("x"), F.col(column).cast("double").alias("v"))
    per = extremes(bars.where(F.col(column).isNotNull()), rule, column).groupBy(KEY).agg(F.array_sort(F.collect_list(point)).alias("p"))
    every = f"((size(p) - 2) / cast({points - 2} as double))"
    edge = lambda i: f"(cast(floor(({i}) * {every}) as int) + 1)"
    row = lambda i: f"slice(p, {edge(i)} + 1, least({edge(f'{i} + 1')}, size(p)) - {edge(i)})"
    middle = _bind(f"if(i = {points - 3}, slice(p, size(p), 1), {row('i + 1')})", "r", "named_struct('x', aggregate(r, 0D, (s, q) -> s + q.x) / size(r), 'v', aggregate(r, 0D, (s, q) -> s + q.v) / size(r))")
    area = "abs((acc.at.x - m.x) * (q.v - acc.at.v) - (acc.at.x - q.x) * (m.v - acc.at.v))"
    best = f"array_max(transform({row('i')}, q -> named_struct('area', {area}, 'early', -q.x, 'q', q))).q"
    step = _bind(middle, "m", _bind(best, "b", "named_struct('at', b, 'out', concat(acc.out, array(b)))"))
    chosen = f"aggregate(sequence(0, {points - 3}), named_struct('at', p[0], 'out', array(p[0])), (acc, i) -> {step}, acc -> concat(acc.out, slice(p, size(p), 1)))"
    kept = per.select(KEY, F.explode(F.expr(f"if(size(p) <= {points}, p, {chosen})")).alias("q"))
    return kept.select(KEY, F.col("q.t").alias(TIME), F.col("q.v").alias(column))
