"""Levels of detail: bars kept at several lengths, so that a wide viewport does not read all of them.

Each level is made of the one below. A viewport reads the longest bars that its candles are made of, and the bars
themselves only where its span cuts into a longer one, and for symbols that have few.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.columns import KEY, TIME
from barloom.operators.timeframe import bucket_start, span, viewport

_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}
_CANDLE = ("open", "high", "low", "close")
#: Symbols that are named in a filter; more are joined.
NAMED = 1000


def seconds(rule: str) -> int:
    """The length of a bar; days at most, as only these begin at whole multiples of it."""
    n, unit = span(rule).split()
    if unit not in _SECONDS:
        raise ValueError(f"no level of {rule!r}: days are the longest unit")
    return int(n) * _SECONDS[unit]


def _merged(rows: DataFrame, rule: str) -> DataFrame:
    """Rows of a level as bars of the rule's length, with n, the number of bars in them; open is null if none has one."""
    known = lambda c: F.when(F.col(c).isNotNull(), F.col(TIME))
    grouped = rows.groupBy(KEY, bucket_start(rule).alias("_at"))
    out = grouped.agg(F.min_by("open", known("open")).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", known("close")).alias("close"), F.sum("n").alias("n"))
    return out.withColumnRenamed("_at", TIME)


def _time(t: datetime) -> Column:
    return F.lit(t).cast("timestamp_ntz")


@dataclass
class Levels:
    """Levels under a path: the bars, and bars of each rule's length, every one a multiple of the one before."""

    spark: SparkSession
    path: str
    rules: tuple[str, ...]

    def __post_init__(self) -> None:
        self.path = self.path.rstrip("/")
        sizes = [seconds(r) for r in self.rules]
        if any(b % a or a == b for a, b in zip(sizes, sizes[1:], strict=False)):
            raise ValueError("every level's bars must be a multiple of those before")

    def _level(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def write(self, bars: DataFrame) -> Levels:
        """Keep bars and make the levels. Rows lie in ranges of symbol and time, so a span reads few files, and a hot
        symbol is many. Bars of null symbol or time are left out."""
        rows = bars.where(f"{KEY} is not null and {TIME} is not null").select(KEY, TIME, *[F.col(c).cast("double").alias(c) for c in _CANDLE], F.lit(1).cast("long").alias("n"))
        for name, rule in [("bars", None), *((f"every-{r}", r) for r in self.rules)]:
            level = rows if rule is None else _merged(rows, rule)
            level.repartitionByRange(KEY, TIME).sortWithinPartitions(KEY, TIME).write.mode("overwrite").parquet(f"{self.path}/{name}")
            rows = self._level(name)
        return self

    def viewport(self, start: str, end: str, target: int) -> DataFrame:
        """The candles of timeframe.viewport(), from the longest bars that fit into them."""
        a, b = (datetime.fromisoformat(t).replace(tzinfo=UTC) for t in (start, end))
        width = max(1, int((b - a).total_seconds() / 60 / max(target, 1)))
        rule = max((r for r in self.rules if width * 60 % seconds(r) == 0), key=seconds, default=None)
        if rule is None:
            return viewport(self._level("bars"), start, end, target)
        step, zero = timedelta(seconds=seconds(rule)), datetime(1970, 1, 1, tzinfo=UTC)
        whole_from, whole_to = zero - (zero - a) // step * step, zero + (b - zero) // step * step
        if whole_from >= whole_to:
            return viewport(self._level("bars"), start, end, target)
        a, b, whole_from, whole_to = (_time(t.replace(tzinfo=None)) for t in (a, b, whole_from, whole_to))
        at, bars = F.col(TIME), self._level("bars")
        edges = bars.where(((at >= a) & (at < whole_from)) | ((at >= whole_to) & (at <= b)))
        rows = self._level(f"every-{rule}").where((at >= whole_from) & (at < whole_to)).unionByName(edges)
        candles = _merged(rows, f"{width}min").withColumn("_all", F.sum("n").over(Window.partitionBy(KEY)))  # about target rows a symbol
        few = candles.where(F.col("_all") <= target).select(KEY).distinct()
        named = [r[KEY] for r in few.limit(NAMED + 1).collect()]
        out = candles.where((F.col("_all") > target) & F.col("open").isNotNull()).select(KEY, TIME, *_CANDLE)
        if not named:
            return out
        inside = bars.where(at.between(a, b))
        own = inside.where(F.col(KEY).isin(named)) if len(named) <= NAMED else inside.join(few, KEY, "left_semi")
        return out.unionByName(own.select(KEY, TIME, *_CANDLE))
