"""Exact deduplication by two passes over a Bloom filter of repeated hashes, in DataFrame operations only.

Every text is read once, for a narrow digest row (id, length, SHA-256 of the text without white space).

Pass one sets one position of a counting filter for each digest, SPACE positions a row. A task's share of a
filter for all rows is nearly empty, so what travels is its set positions, one number a row at most, with
their counts combined before the shuffle. Positions set twice or more are what may repeat.

Pass two makes a blocked Bloom filter of those positions (BITS bits each, two of them in one 64-bit word)
and tests every digest. A filter is a list of blocks of words; it is cut into shards of SHARD_BLOCKS blocks
(64 MB), and each shard is broadcast in turn to the digests that fall into it, so no filter is too large and
none is joined by a shuffle. Digests that miss pass straight through: nothing equals them. The others, true
copies and few false alarms, are the only rows that are grouped by digest. The largest groups are told their
outcome by broadcast, so a text that a third of all rows share is no single task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.scratch import drop, stage, stage_parts

#: Positions of the counting filter for each row, at least: one row in so many is a false alarm of the first pass.
SPACE = 256
#: Bits of the second filter for each repeated position.
BITS = 16
#: 64-bit words in a block (8 KB), and blocks in a shard.
BLOCK_BITS = 10
BLOCK_WORDS, SHARD_BLOCKS = 1 << BLOCK_BITS, 1 << 13
#: Groups of copies whose outcome is broadcast, at most (about 100 bytes each), and the rows that such a group has at least.
BROADCAST_GROUPS, LEAST_ROWS = 100_000, 16
_BLANKS = (" ", "\t", "\n", "\x0b", "\f", "\r")


def normalised(text: Column) -> Column:
    """The text without any character of [\\x20\\x09-\\x0D]; null counts as empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for blank in _BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, length (code points of the text), text_sha256 and position (its first 60 bits) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).alias("length"), F.sha2(F.encode(normalised(F.col("text")), "UTF-8"), 256).alias("text_sha256"))
    return rows.withColumn("position", F.conv(F.substring("text_sha256", 1, 15), 16, 10).cast("long"))


def repeated(rows: DataFrame, space_bits: int) -> DataFrame:
    """The positions of the counting filter, of 2**space_bits, that two rows or more set."""
    return rows.groupBy(_position(space_bits).alias("p")).agg(F.count("*").alias("n")).where("n > 1").select("p")


def _position(space_bits: int) -> Column:
    return F.shiftright("position", 60 - space_bits)


def _place(words: int) -> tuple[Column, Column, Column]:
    """Of a position p: its block, its word within the block, and the bits that it sets there."""
    h = F.xxhash64("p")
    word = h.bitwiseAND(F.lit(words - 1))  # words: a power of two
    far = F.xxhash64("p", F.lit(1))
    bit = lambda shift: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(far, shift).bitwiseAND(F.lit(63)).cast("int"))
    return F.shiftright(word, BLOCK_BITS), word.bitwiseAND(F.lit(BLOCK_WORDS - 1)).cast("int"), bit(0).bitwiseOR(bit(6))


def filter_blocks(positions: DataFrame, words: int) -> DataFrame:
    """block, words (an array of BLOCK_WORDS longs): the blocked Bloom filter of the positions."""
    block, word, mask = _place(words)
    zero = positions.sparkSession.range(words).select(F.shiftright("id", BLOCK_BITS).alias("block"), F.col("id").bitwiseAND(F.lit(BLOCK_WORDS - 1)).cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    set_ = positions.select(block.alias("block"), word.alias("word"), mask.alias("bits"))
    merged = set_.unionByName(zero).repartition("block").groupBy("block", "word").agg(F.bit_or("bits").alias("bits"))
    return merged.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).getField("bits").alias("words"))


def tag(rows: DataFrame, space_bits: int, blocks: DataFrame, words: int, shard_blocks: int | None = None) -> list[DataFrame]:
    """For each shard of the filter its rows, with a column maybe: whether the filter has the row's position."""
    shard_blocks = shard_blocks or SHARD_BLOCKS
    placed = rows.withColumn("p", _position(space_bits))
    block, word, mask = _place(words)
    placed = placed.select(*rows.columns, block.alias("block"), word.alias("word"), mask.alias("mask"))
    count = -(-words // BLOCK_WORDS)
    out = []
    for first in range(0, count, shard_blocks):
        inside = f"block >= {first} and block < {first + shard_blocks}"
        mine = placed.where(inside) if count > shard_blocks else placed
        hit = mine.join(F.broadcast(blocks.where(inside)), "block", "left")
        got = F.coalesce(F.get("words", F.col("word")), F.lit(0).cast("long"))
        out.append(hit.select(*rows.columns, (got.bitwiseAND(F.col("mask")) == F.col("mask")).alias("maybe")))
    return out


def dedup_exact(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, length.

    Texts are equal when identical without white space; null is the empty text, so all null, empty and
    blank texts are one group. Of equal texts the longest original (code points) stays, then the smallest
    doc_id. Rows that repeat a doc_id count each in group_size and are all kept when their id is. An empty
    table gives an empty result; extra columns are ignored.
    """
    rows = stage(digests(docs), "digests")
    n = rows.count()
    space_bits = min(60, max(20, (SPACE * n).bit_length()))
    positions = stage(repeated(rows, space_bits), "repeated")
    words = 1 << max(10, (BITS * positions.count() // 64).bit_length())
    blocks = stage(filter_blocks(positions, words), "filter")
    tagged = stage_parts(tag(rows, space_bits, blocks, words), "tagged")
    for done in (rows, positions, blocks):
        drop(done)
    alone = tagged.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "length")
    rest = tagged.where("maybe").select("doc_id", "length", "text_sha256")
    best = stage(rest.groupBy("text_sha256").agg(F.min(F.struct((-F.col("length")).alias("a"), F.col("doc_id").alias("b"))).alias("best"), F.count("*").alias("group_size")).select("text_sha256", F.col("best.b").alias("keep_id"), "group_size"), "groups")
    # not more groups can be larger than this than are broadcast
    large = max(LEAST_ROWS, (best.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]) // BROADCAST_GROUPS)
    hot = best.where(F.col("group_size") > large).withColumn("hot", F.lit(True))
    told = rest.join(F.broadcast(hot), "text_sha256", "left")
    cold = told.where("hot is null").select("doc_id", "length", "text_sha256").join(best.where(F.col("group_size") <= large), "text_sha256")
    copies = told.where("hot").drop("hot").unionByName(cold)
    return alone.unionByName(copies.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "length"))
