"""Intermediate tables in the folder that all executors share.

A staged table cuts the lineage: losing an executor later never recomputes what came before, and one
materialisation serves every later reader. The folder is ``spark.checkpoint.dir``. A local session
without that setting (tests, notebooks) gets a temporary folder of its own; on a cluster, where executors
would not see each other's, the setting is required.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_STAGED: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (the master is {master})")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="barloom-"))
    return _OWN[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder; whatever is put there is deleted when the Python process ends."""
    path = f"{shared_dir(spark)}/barloom/{name}-{uuid.uuid4().hex}"
    _STAGED.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _STAGED:
        with contextlib.suppress(Exception):  # the session may be gone at exit; nothing depends on this
            if spark.sparkContext._jsc is not None:
                delete(spark, path)


def stage_parts(parts: Iterable[DataFrame], name: str, by: str | None = None) -> DataFrame:
    """Write tables of one schema, one after another, as one Parquet table under the shared folder, and read it
    back; by: a column whose values are kept in folders of their own, so that readers of one skip the rest. The
    next part is asked for when the one before is written."""
    path = first = None
    for part in parts:
        if first is None:
            first = part
            path = scratch_path(part.sparkSession, name)
        writer = part.write.mode("append")
        (writer.partitionBy(by) if by else writer).parquet(path)
    if first is None:
        raise ValueError("there is nothing to stage")
    out = first.sparkSession.read.schema(first.schema).parquet(path).select(*first.columns)
    out._barloom_path = path
    return out


def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back."""
    return stage_parts([df], name, by)


def drop(df: DataFrame) -> None:
    """Delete a table from stage() that nothing will read any more."""
    path = getattr(df, "_barloom_path", None)
    if path:
        delete(df.sparkSession, path)
        _STAGED[:] = [x for x in _STAGED if x[1] != path]
