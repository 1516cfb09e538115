"""Fetching long spans as a stream: what is asked for is a stream of ranges, and its checkpoint knows what is done.

ask() writes the ranges of a span, a file a month (or another calendar unit); fetch_asked() reads them file by
file, fetches them in tasks, and puts each micro-batch of them into the store by one commit. Stopped at any point
and started again, it goes on with the first file whose bars are not in the store; no other page is asked for
again. More can be asked for at any time, for any number of series.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barloom.functions.columns import KEY, TIME
from barloom.sources.providers import IncompleteError, Provider, get_provider
from barloom.sources.store import BarStore
from barloom.staging import drop, stage

_ASKED = f"{KEY} string, tf string, since timestamp_ntz, until timestamp_ntz"


def ask(spark: SparkSession, path: str, symbols: list[str], tf: str, start: str, end: str, unit: str = "month") -> None:
    """Add the bars of these symbols from start to end, both included, to what is asked for under path: one file for
    each calendar unit, the earliest first."""
    named = spark.createDataFrame([(s.upper(),) for s in dict.fromkeys(symbols)], f"{KEY} string").coalesce(1)
    a, b = (f"timestamp_ntz'{t}'" for t in (start, end))
    spans = spark.sql(f"select explode(sequence(date_trunc('{unit}', {a}), {b}, interval 1 {unit})) as at")
    # a bar that begins at the end of a unit is the next one's
    spans = spans.select(F.expr(f"greatest(cast(at as timestamp_ntz), {a})").alias("since"), F.expr(f"least(cast(at + interval 1 {unit} as timestamp_ntz) - interval 1 millisecond, {b})").alias("until"))
    for span in spans.sort("since").collect():  # one row a calendar unit
        named.select(KEY, F.lit(tf).alias("tf"), F.lit(span.since).cast("timestamp_ntz").alias("since"), F.lit(span.until).cast("timestamp_ntz").alias("until")).write.mode("append").parquet(path)


def _step(store: BarStore, provider: Provider, market: str):
    def step(batch: DataFrame, number: int) -> None:
        asked = batch.distinct().collect()  # a file's ranges: one a series
        for tf in sorted({r.tf for r in asked}):
            series: dict[str, list] = {}
            for r in asked:
                if r.tf == tf:
                    series.setdefault(r[KEY], []).append((r.since, r.until))
            got = stage(reduce(DataFrame.unionByName, [provider.fetch(store.spark, s, tf, sorted(ranges)) for s, ranges in sorted(series.items())]), "fetched")
            store.write(got.where(F.col(TIME).isNotNull()), tf, provider.name, market)
            failed = got.where(F.col(TIME).isNull()).count()
            drop(got)
            if failed:  # the stream ends here, and this micro-batch comes first when it is started again
                raise IncompleteError(f"{tf}: {failed} ranges broke off; what was fetched is kept")

    return step


def fetch_asked(store: BarStore, path: str, checkpoint: str, provider: Provider | None = None, market: str = "spot", files: int = 1, **trigger) -> StreamingQuery:
    """Start fetching what is asked for under path into the store, that many files a micro-batch.

    trigger is that of writeStream: availableNow=True ends when all is there; processingTime waits for more.
    A micro-batch is put into the store before it counts as done, and putting it there twice changes nothing.
    """
    asked = store.spark.readStream.schema(_ASKED).option("maxFilesPerTrigger", files).parquet(path)
    writer = asked.writeStream.foreachBatch(_step(store, provider or get_provider("binance"), market)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
