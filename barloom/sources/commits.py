"""A log of commits for tables of immutable files: snapshots, atomic publishing, checks of what was written.

A table is a folder data/commit=<id>/<partition folders>, into which every writer puts files under an id of its
own, and a folder _commits of numbered logs, JSON lines that add and remove partitions of a commit. Files that
no log names do not exist for readers, so a half-written commit is never seen and nothing that is being read
is replaced. A log's number can be taken once: whoever comes second looks at what the first has changed.
Every EVERY commits the state is written out as a whole, and older logs need not be read.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVERY = 50
_TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_STATE = "commit string, rows long, check string, first timestamp_ntz, last timestamp_ntz"


class CommitLog:
    """The log of the table under a root folder; parts are its partition columns, all of them text."""

    def __init__(self, spark: SparkSession, root: str, parts: tuple[str, ...]) -> None:
        self.spark, self.root, self.parts = spark, root, parts
        self.state_schema = ", ".join([_STATE, *(f"{p} string" for p in parts)])
        self.schema = f"version long, action string, columns string, {self.state_schema}"

    # ---- files

    def path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def files(self):
        return self.path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def listed(self, *parts: str) -> list:
        """Status of what is in a folder; nothing if there is none."""
        folder = self.path(*parts)
        return list(self.files().listStatus(folder)) if self.files().exists(folder) else []

    def _claim(self, source, target) -> bool:
        """Give a finished file its name, unless that is taken. Atomic wherever the file system's rename is; on
        a local disk it is a hard link, which is atomic there."""
        try:
            if self.files().getScheme() == "file":
                nio = self.spark._jvm.java.nio.file
                place = lambda p: nio.Paths.get(self.spark._jvm.java.net.URI.create("file://" + p.toUri().getRawPath()))
                nio.Files.createLink(place(target), place(source))
            else:
                context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path().toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                context.rename(source, target, self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def _write(self, entries: DataFrame, name: str) -> bool:
        folder = f"_tmp/{uuid.uuid4().hex}"
        entries.select(F.to_json(F.struct(*entries.columns), _TIMES).alias("value")).coalesce(1).write.text(f"{self.root}/{folder}")
        part = next(s.getPath() for s in self.listed(folder) if s.getPath().getName().startswith("part-"))
        self.files().mkdirs(self.path("_commits"))
        done = self._claim(part, self.path("_commits", name))
        self.files().delete(self.path(folder), True)
        return done

    # ---- state

    def version(self) -> int:
        """The number of the last commit, 0 before any."""
        return max([0, *(int(s.getPath().getName().split(".")[0]) for s in self.listed("_commits"))])

    def _log(self, after: int, upto: int) -> DataFrame:
        names = sorted(s.getPath().getName() for s in self.listed("_commits"))
        whole = max([0, *(int(n.split(".")[0]) for n in names if n.endswith(".full"))] if after == 0 else [after])
        whole = whole if whole <= upto else 0
        wanted = [n for n in names if n.endswith(".json") and whole < int(n.split(".")[0]) <= upto]
        if after == 0 and whole:
            wanted.insert(0, f"{whole:012d}.full")
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).options(**_TIMES).json([f"{self.root}/_commits/{n}" for n in wanted])

    def changed(self, after: int, upto: int) -> DataFrame:
        """The partitions that commits after one number and up to another have touched."""
        return self._log(after, upto).where("action <> 'columns'").select(*self.parts).distinct()

    def live(self, version: int | None = None) -> DataFrame:
        """commit, the partition columns, rows, check, first, last of all that is there at a version."""
        version = self.version() if version is None else version
        last = F.max_by(F.struct("action", "rows", "check", "first", "last"), "version").alias("e")
        return self._log(0, version).where("action <> 'columns'").groupBy("commit", *self.parts).agg(last).where("e.action = 'add'").select("commit", "e.rows", "e.check", "e.first", "e.last", *self.parts)

    def columns(self, version: int | None = None) -> T.StructType | None:
        """The table's columns but for those of its folders; None before anything was written."""
        version = self.version() if version is None else version
        row = self._log(0, version).where("action = 'columns'").agg(F.max_by("columns", "version")).first()
        return T.StructType.fromDDL(row[0]) if row[0] else None

    def publish(self, version: int, columns: T.StructType, added: DataFrame, removed: DataFrame) -> bool:
        """Make a commit the one with this number; False if another has the number."""
        head = self.spark.createDataFrame([("columns", columns.toDDL())], "action string, columns string")
        entries = added.withColumn("action", F.lit("add")).unionByName(removed.withColumn("action", F.lit("remove")), allowMissingColumns=True).unionByName(head, allowMissingColumns=True)
        done = self._write(entries.withColumn("version", F.lit(version).cast("long")), f"{version:012d}.json")
        if done and version % EVERY == 0:
            whole = self.live(version).withColumn("action", F.lit("add")).unionByName(head, allowMissingColumns=True)
            self._write(whole.withColumn("version", F.lit(version).cast("long")), f"{version:012d}.full")
        return done

    # ---- data

    def read(self, columns: T.StructType, tolerant: bool = False) -> DataFrame:
        """All files of all commits, published or not: to be cut to what is live. tolerant: without damaged files;
        otherwise reading one is an error, also if only a page of it is damaged."""
        folders = T.StructType([T.StructField(c, T.StringType()) for c in ("commit", *self.parts)])
        reader = self.spark.read.schema(T.StructType([*columns.fields, *folders.fields]))
        reader = reader.option("ignoreCorruptFiles", str(tolerant).lower()).option("ignoreMissingFiles", str(tolerant).lower())
        return reader.option("parquet.page.verify-checksum.enabled", "true").parquet(f"{self.root}/data")

    def put(self, rows: DataFrame, order: list[str]) -> str:
        """Write rows as the files of a new commit, not yet published; its id."""
        commit = uuid.uuid4().hex
        rows.repartition(*self.parts).sortWithinPartitions(*self.parts, *order).write.partitionBy(*self.parts).parquet(f"{self.root}/data/commit={commit}")
        return commit

    @staticmethod
    def check(columns: list[str]):
        """A sum of row hashes: the same whatever the order of rows."""
        return F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string")

    def measured(self, rows: DataFrame, columns: list[str], time: str) -> DataFrame:
        """What a log says of each partition in rows."""
        return rows.groupBy("commit", *self.parts).agg(F.count("*").alias("rows"), self.check(columns).alias("check"), F.min(time).alias("first"), F.max(time).alias("last"))

    def vacuum(self, hours: float = 24.0) -> int:
        """Delete the files of commits that nothing live is in and that are older than so many hours; how many."""
        import time

        used = {r.commit for r in self.live().select("commit").distinct().collect()}  # one row a commit
        gone = 0
        for s in self.listed("data"):
            if s.getPath().getName().partition("=")[2] not in used and s.getModificationTime() / 1000 <= time.time() - hours * 3600:
                self.files().delete(s.getPath(), True)
                gone += 1
        return gone
