"""Ranked lexical search: document-sharded postings with integer impacts, scored term at a time.

A shard's row holds its documents' ids and the inverted lists of all their terms; beside each posting stands
its impact, the part of its score that depends on the document: (10^9 tf) div (1000 tf + 20 m), where m is
100 - 50 + (50 n N) div L. A query's score is the sum over its distinct terms of weight * impact, in 64-bit
integers; a term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))).

A search adds a shard's lists up in dense accumulators, one value for each query and document, and keeps the
k best of each query: argpartition finds the k-th score, all above it stay, and of those equal to it the
smallest ids. Tasks hand on k rows for each query, which are merged 64 tasks at a time. Nothing grows with
the corpus but the index. Queries are searched in blocks of about MOST_PAIRS (query, term) pairs, which are
what is broadcast; every block sees every shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm import postings
from barloom.llm.scratch import FAN, drop, stage, stage_parts

#: (query, term) pairs that are searched and broadcast at once; values of the accumulators at once.
MOST_PAIRS, MOST_VALUES = 200_000, 1 << 23
INDEX = "ids array<long>, terms binary, ends binary, docs binary, impacts binary"
FOUND = "query int, doc_id long, score long, task long"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = total = 0
    for b in batches:
        for n in postings.term_counts(b.column("text")):
            docs += int((n > 0).sum())
            total += int(n.sum())
    yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([total], pa.int64())], ["docs", "total"])


def measure(docs: DataFrame) -> tuple[int, int]:
    """N and L: the documents that have a term, and all their terms with repeats."""
    row = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_measure, "docs long, total long").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    return int(row[0]), int(row[1])


def _inverted(n_docs: int, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, hashes, first in postings.shards(b.column("text")):
                n = np.diff(first)
                span = j - i
                terms, ends, docs = postings.invert(hashes, np.repeat(np.arange(span), n), span)
                # repeats of a document within a list become its tf
                new = np.ones(len(docs), bool)
                new[1:] = docs[1:] != docs[:-1]
                new[ends[:-1]] = True
                at = np.flatnonzero(new)
                tf = np.diff(np.append(at, len(docs)))
                docs = docs[at]
                ends = np.searchsorted(at, ends)
                m = 100 - 50 + (50 * n.astype(np.int64) * n_docs) // max(total, 1)
                impacts = (1_000_000_000 * tf) // (1000 * tf + 20 * m[docs])
                row = [b.column("doc_id").slice(i, span).to_pylist()], [terms.tobytes()], [ends.astype(np.int64).tobytes()], [docs.astype(np.uint16).tobytes()], [impacts.astype(np.int32).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.list_(pa.int64()), *[pa.binary()] * 4), strict=True)], ["ids", "terms", "ends", "docs", "impacts"])

    return run


def index(docs: DataFrame) -> tuple[DataFrame, int]:
    """The staged index of doc_id and text, one row a shard, and N. Every document is in it, null texts too."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_docs, total = measure(docs)
    return stage(docs.mapInArrow(_inverted(n_docs, total), INDEX), "lexical"), n_docs


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, hashes, first in postings.shards(b.column("text")):
            query = np.repeat(np.arange(j - i), np.diff(first))
            yield pa.RecordBatch.from_arrays([b.column("item_id").slice(i, j - i).take(pa.array(query)), pa.array(hashes.view(np.int64))], ["item_id", "term"])


def _counts(wanted: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(wanted), np.int64)
        for b in batches:
            for terms, ends in zip(b.column("terms"), b.column("ends"), strict=True):
                a, z = postings.find(np.frombuffer(terms.as_py(), np.uint64), np.frombuffer(ends.as_py(), np.int64), wanted)
                df += z - a
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at], pa.int64())], ["term", "df"])

    return run


def best(scores: np.ndarray, ids: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """Which k are highest; of equal scores the smallest ids, those without an id last. In no order."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = scores[np.argpartition(scores, len(scores) - k)[len(scores) - k]]
    over, even = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
    return np.concatenate([over, even[np.lexsort((ids[even], ~known[even]))[: k - len(over)]]])


class _Top:
    """The k best of a query so far."""

    def __init__(self, k: int) -> None:
        self.k, self.floor, self.size = k, 1, 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        at = np.flatnonzero(scores >= self.floor)
        if len(at):
            keep = at[best(scores[at], ids[at], known[at], self.k)]
            self.parts.append((scores[keep], ids[keep], known[keep]))
            self.size += len(keep)
            if self.size >= 8 * self.k:
                self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        scores, ids, known = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        keep = best(scores, ids, known, self.k)
        self.parts, self.size = [(scores[keep], ids[keep], known[keep])], len(keep)
        if len(keep) == self.k:
            self.floor = int(scores[keep].min())
        return self.parts[0]


def _search(wanted: np.ndarray, weight: np.ndarray, first: np.ndarray, queries: np.ndarray, n_queries: int, k: int):
    """wanted: distinct terms; the queries that have term t are queries[first[t]:first[t + 1]]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = [_Top(k) for _ in range(n_queries)]
        for b in batches:
            for row in range(b.num_rows):
                ids = b.column("ids")[row].values
                known = np.asarray(ids.is_valid())
                ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
                terms, ends, docs, impacts = (np.frombuffer(b.column(c)[row].as_py(), t) for c, t in (("terms", np.uint64), ("ends", np.int64), ("docs", np.uint16), ("impacts", np.int32)))
                start, stop = postings.find(terms, ends, wanted)
                live = np.flatnonzero(stop > start).tolist()
                per = max(1, MOST_VALUES // max(len(ids), 1))
                for low in range(0, n_queries, per):  # accumulators of bounded size
                    total = np.zeros((min(per, n_queries - low), len(ids)), np.int64)
                    for t in live:
                        own = queries[first[t] : first[t + 1]]
                        own = own[(own >= low) & (own < low + per)] - low
                        if len(own):
                            at = docs[start[t] : stop[t]]
                            add = impacts[start[t] : stop[t]].astype(np.int64) * weight[t]
                            for q in own.tolist():
                                total[q, at] += add
                    for q in range(len(total)):
                        tops[low + q].add(total[q], ids, known)
        task = TaskContext.get().partitionId()
        for q, top in enumerate(tops):
            if top.size:
                scores, ids, known = top.cut()
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(ids), pa.int32()), pa.array(ids, pa.int64(), mask=~known), pa.array(scores, pa.int64()), pa.array([task] * len(ids), pa.int64())], ["query", "doc_id", "score", "task"])

    return run


def _ranked(found: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy("query", *by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _merged(found: DataFrame, k: int, fan: int) -> DataFrame:
    """The k best of each query over all tasks, those of fan tasks at a time."""
    found = stage(found, "found")
    top = found.agg(F.coalesce(F.max("task"), F.lit(0))).first()[0] + 1
    while top > fan:
        level = stage(_ranked(found.withColumn("task", F.expr(f"task div {fan}")), k, "task").drop("rank"), "found")
        drop(found)
        found, top = level, -(-top // fan)
    return _ranked(found, k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, fan: int = FAN) -> DataFrame:
    """item_id, rank, doc_id, score of each item's k highest-scoring documents with a score above 0.

    docs: doc_id, text; items: item_id, text; further columns are ignored. A null text has no terms. Equal
    scores stand by ascending doc_id, null last; every row of docs is a document, also where ids repeat. Rows
    of items that share an id are one item with the terms of all; null is an id like any other. Items without
    a term, or whose terms no document has, give no rows, and so does an empty table on either side.
    """
    pairs = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(_terms, "item_id long, term long").distinct()
    pairs = stage(pairs, "query-terms")
    blocks = -(-pairs.count() // MOST_PAIRS)
    shards, n_docs = index(docs)
    parts = []
    for block in range(blocks):
        # about MOST_PAIRS pairs, by a hash of the item's id
        rows = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toArrow()
        if not rows.num_rows:
            continue
        ids = rows.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
        query, hashes = ids.indices.to_numpy(zero_copy_only=False), rows.column("term").to_numpy().view(np.uint64)
        order = np.argsort(hashes, kind="stable")
        wanted, first = np.unique(hashes[order], return_index=True)
        df = np.zeros(len(wanted), np.int64)
        for r in shards.select("terms", "ends").mapInArrow(_counts(wanted), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # one row a query term at most
            df[r.term] = r.df
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        names = ids.dictionary.to_pylist()
        found = shards.mapInArrow(_search(wanted, weight, np.append(first, len(hashes)), query[order], len(names), k), FOUND)
        named = docs.sparkSession.createDataFrame([(q, n) for q, n in enumerate(names)], "query int, item_id long")
        # the block's items: no more than its pairs
        parts.append(_merged(found, k, fan).join(F.broadcast(named), "query").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return stage_parts(parts, "search")
