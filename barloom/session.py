"""Sessions, and the shipping of this package to the executors' Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings this library is tested with."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("barloom")
    settings = {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.sql.adaptive.enabled": "true", "spark.ui.showConsoleProgress": "false"}
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Bytes of an Arrow batch between the JVM and Python, where the session has Spark's own 64 MB: texts and
#: binaries are long, and a batch is held several times over on its way.
BATCH_BYTES, _SPARKS_OWN = 4 << 20, ("67108864b", "67108864", "64m", "64mb")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a context: workers import it wherever the driver found it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).lower() in _SPARKS_OWN:
        spark.conf.set(key, str(BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_barloom_shipped", False):
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="barloom-")) / "barloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._barloom_shipped = True
