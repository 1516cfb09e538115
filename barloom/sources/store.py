"""The bar store: Parquet by source, market, symbol, timeframe and month, kept free of duplicates."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.columns import BAR_SCHEMA, BASE, KEY, TIME, without_nan
from barloom.sources.commits import CommitLog
from barloom.sources.ticks import spacing

PARTITIONS = ("source", "market", "symbol", "tf", "month")


def validate_ohlcv(bars: DataFrame, keys: tuple[str, ...] = (KEY,), arrival: str | None = None) -> DataFrame:
    """Bars with all base columns, one a symbol and time: the one that arrived last. NaN becomes null.

    Of rows without an arrival column, the one that is greatest in all columns stays, so reruns agree.
    """
    if missing := [c for c in BASE if c not in bars.columns]:
        raise ValueError(f"bars lack {', '.join(missing)}")
    rows = bars.where(F.col(TIME).isNotNull())
    order = [F.desc_nulls_last(arrival)] if arrival else []
    order += [F.desc_nulls_last(c) for c in bars.columns if c not in (*keys, TIME, arrival)]
    w = Window.partitionBy(*keys, TIME).orderBy(*order)
    rows = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return without_nan(rows)


def merge_bars(*frames: DataFrame, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """All frames as one; where they have the same bar, that of the later frame."""
    tagged = [f.withColumn("_arrival", F.lit(k)) for k, f in enumerate(frames)]
    both = tagged[0]
    for f in tagged[1:]:
        both = both.unionByName(f, allowMissingColumns=True)
    return validate_ohlcv(both, keys, "_arrival").drop("_arrival")


def time_slice(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars from start to end, both included. The limits have the column's type, so they reach the scan."""
    if start is not None:
        bars = bars.where(F.col(TIME) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        bars = bars.where(F.col(TIME) <= F.lit(end).cast("timestamp_ntz"))
    return bars


class DamagedError(RuntimeError):
    """Files of the store are not what was written."""


class BarStore:
    """Bars under a root folder of any file system that Spark reads.

    Every write is a commit (see commits.py): readers see all of it or nothing, and of two writers of one month
    the second merges into what the first has put there. Files that are damaged are errors, never holes.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.log = CommitLog(spark, self.root, PARTITIONS)

    def exists(self) -> bool:
        return self.log.version() > 0

    def _empty(self) -> DataFrame:
        extra = [T.StructField(c, T.StringType()) for c in PARTITIONS if c != KEY]
        return self.spark.createDataFrame([], T.StructType([*BAR_SCHEMA.fields, *extra]))

    def _rows(self, live: DataFrame, columns: T.StructType, tolerant: bool = False) -> DataFrame:
        """The rows of live partitions. Their folders are few beside the bars: they prune the scan."""
        return self.log.read(columns, tolerant).join(F.broadcast(live.select("commit", *PARTITIONS)), ["commit", *PARTITIONS], "left_semi")

    def table(self) -> DataFrame:
        """Everything in the store; an empty table before anything was written."""
        version = self.log.version()
        return self._rows(self.log.live(version), self.log.columns(version)).drop("commit") if version else self._empty()

    def _series(self, version: int, symbol: str, tf: str, source: str, market: str) -> DataFrame:
        """The live partitions of a series, one a month."""
        return self.log.live(version).where((F.col("source") == source) & (F.col("market") == market) & (F.col(KEY) == symbol.upper()) & (F.col("tf") == tf))

    def load(self, symbol: str, tf: str, start: str | None = None, end: str | None = None, columns: list[str] | None = None, source: str = "binance", market: str = "spot") -> DataFrame:
        """A series: only its months are read, times are pushed to the scan, columns pruned."""
        version = self.log.version()
        live = self._series(version, symbol, tf, source, market)
        if start is not None:
            live = live.where(F.col("month") >= str(start)[:7])
        if end is not None:
            live = live.where(F.col("month") <= str(end)[:7])
        months = live.select("commit", "month").collect()  # a series has one a month
        if months:
            own = (F.col("source") == source) & (F.col("market") == market) & (F.col(KEY) == symbol.upper()) & (F.col("tf") == tf)
            of = {c: [m.month for m in months if m.commit == c] for c in {m.commit for m in months}}
            rows = self.log.read(self.log.columns(version)).where(own & reduce(lambda x, y: x | y, [(F.col("commit") == c) & F.col("month").isin(ms) for c, ms in of.items()])).drop("commit")
        else:
            rows = self.table().limit(0) if version else self._empty()
        rows = time_slice(rows, start, end)
        return rows if columns is None else rows.select(*dict.fromkeys([*BASE, *columns]))

    def damaged(self, live: DataFrame, version: int, deep: bool = False) -> DataFrame:
        """Those of live partitions whose files are missing, unreadable or hold another number of rows; deep: or
        other rows. Otherwise only the files' footers are read."""
        columns = self.log.columns(version)
        rows = self._rows(live, columns, tolerant=True)
        got = rows.groupBy("commit", *PARTITIONS).agg(F.count("*").alias("_n"), (self.log.check(columns.names) if deep else F.lit(None).cast("string")).alias("_check"))
        bad = (F.coalesce("_n", F.lit(0)) != F.col("rows")) | (F.col("_check") != F.col("check"))
        return live.join(got, ["commit", *PARTITIONS], "left").where(F.coalesce(bad, F.lit(False))).drop("_n", "_check")

    def repair(self, symbol: str, tf: str, source: str = "binance", market: str = "spot", deep: bool = False) -> list[str]:
        """Take damaged months of a series out of the store, so that they are fetched again; which they were."""
        while True:
            version = self.log.version()
            if not version:
                return []
            live = self._series(version, symbol, tf, source, market).collect()  # one row a month
            if not live:
                return []
            bad = self.damaged(self.spark.createDataFrame(live, self.log.state_schema), version, deep).collect()
            if not bad:
                return []
            gone = self.spark.createDataFrame([(r.commit, *(r[p] for p in PARTITIONS)) for r in bad], ", ".join(f"{c} string" for c in ("commit", *PARTITIONS)))
            if self.log.publish(version + 1, self.log.columns(version), gone.limit(0), gone):
                self.incomplete(source, market, symbol.upper(), tf, set_to=True)
                return sorted(r.month for r in bad)

    def write(self, bars: DataFrame, tf: str, source: str = "binance", market: str = "spot") -> None:
        """Put bars in, over what the store has of the same symbol and time. Only touched months are rewritten.

        If another writer commits one of those months meanwhile, they are merged anew. Raises DamagedError if
        a touched month is damaged: repair() the series first.
        """
        new = bars.withColumn(KEY, F.upper(KEY)).withColumns({"source": F.lit(source), "market": F.lit(market), "tf": F.lit(tf), "month": F.date_format(TIME, "yyyy-MM")})
        keys = ("source", "market", KEY, "tf")
        staged = f"{self.root}/_tmp/{uuid.uuid4().hex}"
        validate_ohlcv(new, keys).write.parquet(staged)
        new = self.spark.read.parquet(staged)
        touched = new.select(*PARTITIONS).distinct()
        try:
            while not new.isEmpty() and not self._commit(new, touched, keys):
                pass
        finally:
            self.log.files().delete(self.log.path(staged.removeprefix(f"{self.root}/")), True)

    def _commit(self, new: DataFrame, touched: DataFrame, keys: tuple[str, ...]) -> bool:
        """One try; False if another writer was faster with one of the touched months."""
        version = self.log.version()
        old = self.log.live(version).join(touched, list(PARTITIONS), "left_semi").cache()
        merged = new
        if version:
            if bad := self.damaged(old, version).limit(10).collect():
                raise DamagedError("damaged: " + ", ".join("/".join(r[p] for p in PARTITIONS) for r in bad))
            merged = merge_bars(self._rows(old, self.log.columns(version)).drop("commit"), new, keys=keys)
        columns = T.StructType([f for f in merged.schema.fields if f.name not in PARTITIONS])
        commit = self.log.put(merged, [TIME])
        added = self.log.measured(self.log.read(columns).where(F.col("commit") == commit), columns.names, TIME)
        while not self.log.publish(version + 1, columns, added, old.select("commit", *PARTITIONS)):
            now = self.log.version()
            met = not self.log.changed(version, now).join(touched, list(PARTITIONS), "left_semi").isEmpty()
            if met or self.log.columns(now) != self.log.columns(version):
                self.log.files().delete(self.log.path("data", f"commit={commit}"), True)
                return False
            version = now
        return True

    def incomplete(self, *series: str, set_to: bool | None = None) -> bool:
        """Whether a fetch of the series broke off, so that it may have gaps to fill; set_to changes that."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}__incomplete/{'-'.join(series)}")
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if set_to:
            files.create(path, True).close()
        elif set_to is False:
            files.delete(path, False)
        return bool(files.exists(path))

    def catalog(self) -> DataFrame:
        """Rows and first and last time of each series, as the log has them."""
        return self.log.live().groupBy("source", "market", KEY, "tf").agg(F.sum("rows").alias("n_bars"), F.min("first").alias("first_time"), F.max("last").alias("last_time"))

    def covers(self, symbol: str, tf: str, start: str, end: str | None, now: str | None = None, source: str = "binance", market: str = "spot") -> bool:
        """Whether the series reaches from start to a bar before end; without an end, to two bars before now."""
        got = self._series(self.log.version(), symbol, tf, source, market).agg(F.min("first").alias("a"), F.max("last").alias("b"))
        limit = F.lit(end if end is not None else now).cast("timestamp_ntz") if (end or now) else F.localtimestamp()
        reach = F.col("b") + spacing(tf) * F.lit(1 if end is not None else 2)
        return bool(got.select(F.coalesce((F.col("a") <= F.lit(start).cast("timestamp_ntz")) & (reach >= limit), F.lit(False))).first()[0])


def catalog(bars: DataFrame, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    return bars.groupBy(*keys).agg(F.count("*").alias("n_bars"), F.min(TIME).alias("first_time"), F.max(TIME).alias("last_time"))


def find_gaps(bars: DataFrame, rule: str, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """Missing stretches inside each series: neighbours further apart than one and a half bars."""
    w = Window.partitionBy(*keys).orderBy(TIME)
    step = spacing(rule)
    near = bars.select(*keys, F.lag(TIME).over(w).alias("_a"), F.col(TIME).alias("_b"))
    far = near.where(F.col("_b") - F.col("_a") > step * 1.5)
    return far.select(*keys, (F.col("_a") + step).alias("gap_start"), (F.col("_b") - step).alias("gap_end")).where("gap_start <= gap_end")


def missing_ranges(bars: DataFrame, rule: str, start: str, end: str, symbol: str) -> DataFrame:
    """What has to be fetched of one symbol's series to have it from start to end: before, inside, after."""
    step = spacing(rule)
    a, b = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    own = bars.where(F.col(KEY) == symbol)
    edge = own.agg(F.min(TIME).alias("lo"), F.max(TIME).alias("hi"))
    outer = edge.select(F.explode(F.when(F.col("lo").isNull(), F.array(F.struct(a.alias("from"), b.alias("to")))).otherwise(F.array(F.struct(a.alias("from"), (F.col("lo") - step).alias("to")), F.struct((F.col("hi") + step).alias("from"), b.alias("to"))))).alias("r")).select("r.from", "r.to")
    inner = find_gaps(own, rule).select(F.greatest("gap_start", a).alias("from"), F.least("gap_end", b).alias("to"))
    return outer.unionByName(inner).where("from <= to").orderBy("from")


#: Seconds of the units of show_last().
_SECONDS = {"s": 1, "sec": 1, "m": 60, "min": 60, "minute": 60, "h": 3600, "hour": 3600, "d": 86400, "day": 86400, "w": 604800, "week": 604800, "mo": 2592000, "month": 2592000, "y": 31536000, "year": 31536000}


def show_last(text: str) -> int:
    """Seconds of a span such as 2weeks, 5w, 3M (months of 30 days), 36h."""
    m = re.fullmatch(r"\s*(\d+)\s*([A-Za-z]+)\s*", text)
    if not m:
        raise ValueError(f"cannot read span {text!r}")
    unit = "mo" if m[2] == "M" else m[2].lower()
    unit = unit if unit in _SECONDS else unit.rstrip("s")
    if unit not in _SECONDS:
        raise ValueError(f"cannot read span {text!r}")
    return int(m[1]) * _SECONDS[unit]


def pages_needed(start: int, end: int, step: int, limit: int) -> int:
    """Requests for the bars from start to end (seconds, both included), limit a request."""
    return 0 if end < start else -(-((end - start) // step + 1) // limit)
