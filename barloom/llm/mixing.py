"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Within a source the documents stand in order of size, then of a hash of their id. Every document expects
rate = target / source size copies; with one random offset u of the source, the document of rank r is
emitted once for each integer in (u + rate * (r - 1), u + rate * r]. Because neighbours are of like size,
the words taken come within about one document of the target.

Ranks need no task that holds a whole source: rows are range-partitioned over (source, size, hash), each
partition numbers its own rows, and the partitions' counts are summed up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.scratch import stage

WEIGHTS = (1, 2, 3)
CAP = 3
WORD = "[^\\x20\\x09-\\x0D]+"


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with a column rank: the 0-based place of each row in the order (nulls last), staged."""
    keys = [F.asc_nulls_last(c) for c in order]
    cut = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    cut = stage(cut, "ranks").withColumn("_part", F.shiftright("_at", 33)).withColumn("_row", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    before = cut.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))
    # one row for each partition: a few thousand at most
    return cut.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn("rank", F.col("_before") + F.col("_row")).drop("_at", "_part", "_row", "_before")


def targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """sizes: source, source_size. Adds weight and target; one row for each source.

    A source's target is min(cap * its size, level * its weight), with the one level at which all targets
    add up to all sizes: that is where repeated sharing of the excess ends.
    """
    ranked = numbered(sizes, "source").withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))).drop("rank")
    ranked = ranked.withColumn("room", F.lit(cap) * F.col("source_size")).withColumn("fills_at", F.col("room") / F.col("weight"))
    ranked = stage(ranked, "sources")
    total, weights = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    # the excess of full sources goes to the others, round after round; each round is one small aggregation
    level, last = total / weights if weights else 0.0, None
    while level != last:
        full = F.col("fills_at") < level
        taken, out = ranked.agg(F.coalesce(F.sum(F.when(full, F.col("room"))), F.lit(0)), F.coalesce(F.sum(F.when(full, F.col("weight"))), F.lit(0.0))).first()
        level, last = (total - taken) / (weights - out) if weights > out else level, level
    return ranked.select("source", "source_size", "weight", F.least(F.col("room").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def _offset(source: Column) -> Column:
    """The source's random offset in [0, 1): 20 bits of an MD5, so that reruns agree."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("offset:"), F.coalesce(source, F.lit("")))), 1, 5), 16, 10).cast("double") / F.lit(float(1 << 20))


def mix(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, copies, taken.

    size is the number of words; null and blank texts have size 0 and, like all documents of their source,
    are taken as often as their rank says (adding no words). Null is a source of its own, the last. Sources
    weigh 1, 2, 3, repeating, in code point order and share all words; a target stops at 3 times its source's
    size. Rows with the same id and size are interchangeable. An empty table gives no rows.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = stage(sized, "sizes")
    rows = stage(numbered(sized.withColumn("_h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "source", "size", "_h", "doc_id").drop("_h"), "mix")
    per = stage(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("rank").alias("first")), "mix-sources")
    goal = targets(per.select("source", "source_size"))
    goal = goal.alias("g").join(per.alias("p"), F.expr("g.source <=> p.source")).select("g.source", "g.source_size", "g.target", "p.first")
    goal = goal.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    r = rows.alias("r").join(goal.alias("g"), F.expr("r.source <=> g.source")).select("r.*", "g.source_size", "g.target", "g.rate", (F.expr("r.rank - g.first")).alias("k"))
    upto = lambda k: F.floor(_offset(F.col("source")) + F.col("rate") * k)
    copies = F.least(F.lit(CAP), upto(F.col("k") + 1) - upto(F.col("k"))).cast("long")
    return r.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
