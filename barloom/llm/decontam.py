"""Benchmark decontamination through a distributed positional inverted index.

Each shard's row holds, for every term of its documents, the ascending positions at which the term stands
(one position is left free between documents, so that no match crosses from one to the next). Test texts are
cut into windows of consecutive terms. For each window the lists of the shard are ordered by length; the
rarest gives candidate starts (its positions less its offset in the window), and every further list, offset
alike, is intersected with what is left. What remains are the exact occurrences. Windows without one of
their terms in a shard cost nothing there, and very frequent words are looked up, never enumerated, unless
a window has no other. Shards need no shuffle; what tasks return is bounded by the documents' own size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import postings
from barloom.llm.scratch import stage, stage_parts

#: Windows that are matched and broadcast at once, and candidates in one intersection.
MOST_WINDOWS, MOST_CANDIDATES = 200_000, 1 << 20
INDEX = "shard long, ids array<long>, sizes array<long>, terms binary, ends binary, places binary"
MATCHES = "shard long, doc int, doc_id long, item_ids array<long>, spans array<struct<a:int,b:int>>"
NEAR = "doc_id long, item_id long, start int, stop int"
WINDOWS = "item_id long, terms array<long>"


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard = TaskContext.get().partitionId() << 32
    for b in batches:
        for i, j, hashes, first in postings.shards(b.column("text")):
            place = np.arange(len(hashes)) + np.repeat(np.arange(j - i), np.diff(first))
            terms, ends, places = postings.invert(hashes, place, len(hashes) + j - i)
            offsets = np.array([0, j - i], np.int32)
            columns = pa.array([shard], pa.int64()), pa.ListArray.from_arrays(offsets, b.column("doc_id").slice(i, j - i)), pa.ListArray.from_arrays(offsets, np.diff(first)), *(pa.array([x.tobytes()], pa.binary()) for x in (terms, ends.astype(np.int64), places.astype(np.uint32)))
            yield pa.RecordBatch.from_arrays(list(columns), ["shard", "ids", "sizes", "terms", "ends", "places"])
            shard += 1


def index(docs: DataFrame) -> DataFrame:
    """The staged positional index of doc_id and text, one row a shard. Every document is in it."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stage(docs.mapInArrow(_inverted, INDEX), "positions")


def _cut(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, hashes, first in postings.shards(b.column("text")):
                signed = hashes.view(np.int64)
                for k, (a, z) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    if z > a:
                        size = min(width, z - a)
                        rows = np.lib.stride_tricks.sliding_window_view(signed[a:z], size)
                        for low in range(0, len(rows), 1 << 16):
                            part = np.ascontiguousarray(rows[low : low + (1 << 16)])
                            lists = pa.ListArray.from_arrays(np.arange(0, part.size + 1, size, dtype=np.int32), part.ravel())
                            yield pa.RecordBatch.from_arrays([b.column("item_id").slice(i + k, 1).take(pa.array(np.zeros(len(part), np.int64))), lists], ["item_id", "terms"])

    return run


def windows(items: DataFrame, width: int) -> DataFrame:
    """item_id, terms: each distinct run of width terms of an item; of an item of fewer, but not none, all."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return items.mapInArrow(_cut(width), WINDOWS).distinct()


class Queries:
    """A block of windows: distinct terms, and each distinct window as places in them."""

    def __init__(self, rows: pa.Table) -> None:
        lists = rows.column("terms").combine_chunks()
        count = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        self.vocabulary, which = np.unique(lists.flatten().to_numpy().view(np.uint64), return_inverse=True)
        wide = np.full((len(count), int(count.max(initial=1))), -1, np.int64)
        wide[np.arange(wide.shape[1]) < count[:, None]] = which
        self.terms, own = np.unique(wide, axis=0, return_inverse=True)
        self.size = (self.terms >= 0).sum(1)
        # the items of a window are items[code] for the codes codes[first[w]:first[w + 1]]
        named = rows.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
        self.items = named.dictionary
        self.codes = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)[np.argsort(own.ravel(), kind="stable")]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(own.ravel(), minlength=len(self.terms)))])

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each window's items: (place in which, code), one after another."""
        size = np.diff(self.first)[which]
        each = np.repeat(np.arange(len(which)), size)
        return each, self.codes[np.arange(len(each)) - np.repeat(np.cumsum(size) - size - self.first[which], size)]


class Shard:
    """One row of the index, ready for intersections."""

    def __init__(self, batch: pa.RecordBatch, row: int, reach: int) -> None:
        """reach: how far beyond a position that is there a look-up may go."""
        self.ids = batch.column("ids")[row].values
        sizes = batch.column("sizes")[row].values.to_numpy()
        self.terms, self.ends, self.places = (np.frombuffer(batch.column(c)[row].as_py(), t) for c, t in (("terms", np.uint64), ("ends", np.int64), ("places", np.uint32)))
        self.places = self.places.astype(np.int64)
        self.span = len(self.places) + len(sizes) + reach + 1
        self.key = np.repeat(np.arange(len(self.terms)), np.diff(self.ends, prepend=0)) * self.span + self.places
        self.begins = np.cumsum(sizes) - sizes + np.arange(len(sizes))  # each document's first position

    def doc(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, place, "right") - 1

    def expand(self, start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(which list, position) of all entries of lists, at most MOST_CANDIDATES at a time beside a list's own."""
        size = stop - start
        upto = np.cumsum(size)
        i = 0
        while i < len(size):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + MOST_CANDIDATES, "right")))
            which = np.repeat(np.arange(i, j), size[i:j])
            yield which, self.places[np.arange(len(which)) - np.repeat(np.cumsum(size[i:j]) - size[i:j] - start[i:j], size[i:j])]
            i = j

    def lists(self, queries: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each query term's list, the windows that have all their terms here, and the
        columns of each such window from its rarest term to its most frequent one, free columns last."""
        start, stop = postings.find(self.terms, self.ends, queries.vocabulary)
        size = np.append(stop - start, np.iinfo(np.int64).max)  # of no term: never the rarest
        per = size[queries.terms]
        live = np.flatnonzero((per > 0).all(1))
        return start, stop, live, np.argsort(per[live], axis=1, kind="stable")

    def phrases(self, queries: Queries) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, position of its first term) of all exact occurrences."""
        start, stop, live, order = self.lists(queries)
        if not len(live):
            return
        terms = queries.terms[live]
        rows = np.arange(len(live))
        rarest = terms[rows, order[:, 0]]
        slot = np.searchsorted(self.terms, queries.vocabulary)  # of terms that are here
        for which, place in self.expand(start[rarest], stop[rarest]):
            at = place - order[which, 0]
            which, at = which[at >= 0], at[at >= 0]
            for step in range(1, terms.shape[1]):
                column = order[which, step]
                term = terms[which, column]
                on = term >= 0
                want = slot[term] * self.span + at + column
                near = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
                keep = ~on | (self.key[near] == want)
                which, at = which[keep], at[keep]
                if not len(which):
                    break
            yield live[which], at

    def near(self, queries: Queries, within: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(window, first, last position) of spans of at most within terms of one document that hold all of a
        window's distinct terms in any order; one for each first position, which is one of the terms."""
        start, stop, live, order = self.lists(queries)
        if not len(live):
            return
        terms = queries.terms[live]
        rarest = terms[np.arange(len(live)), order[:, 0]]
        slot = np.searchsorted(self.terms, queries.vocabulary)
        for which, place in self.expand(start[rarest], stop[rarest]):
            # a span holds an occurrence of the rarest term and begins less than within before it
            found = []
            for back in range(within):
                own, at = which, place - back
                own, at = own[at >= 0], at[at >= 0]
                last, is_term, fits = at.copy(), np.zeros(len(at), bool), np.ones(len(at), bool)
                for column in range(terms.shape[1]):
                    term = terms[own, column]
                    base = slot[term] * self.span
                    place_of = np.minimum(np.searchsorted(self.key, base + at), len(self.key) - 1)
                    then = self.key[place_of] - base  # the term's next position, if it has one
                    on = term >= 0
                    fits &= ~on | ((then >= at) & (then < at + within))
                    is_term |= on & (then == at)
                    last = np.where(on & fits, np.maximum(last, then), last)
                ok = fits & is_term
                ok[ok] = self.doc(at[ok]) == self.doc(last[ok])
                found.append(np.stack([own[ok], at[ok], last[ok]]))
            own, at, last = np.unique(np.concatenate(found, axis=1), axis=1)
            yield live[own], at, last


def _phrases(queries: Queries):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                shard = Shard(b, row, queries.terms.shape[1])
                # what windows cover, as a difference of counts over the positions, and pairs of document and item
                edge = np.zeros(shard.span + 1, np.int64)
                pairs = [np.zeros(0, np.int64)]
                for which, at in shard.phrases(queries):
                    edge += np.bincount(at, minlength=len(edge)) - np.bincount(at + queries.size[which], minlength=len(edge))
                    seen = np.unique(shard.doc(at) * len(queries.terms) + which)
                    each, code = queries.of(seen % len(queries.terms))
                    pairs.append(np.unique(seen[each] // len(queries.terms) * len(queries.items) + code))
                pair = np.unique(np.concatenate(pairs))
                if not len(pair):
                    continue
                docs, first = np.unique(pair // len(queries.items), return_index=True)
                items = pa.ListArray.from_arrays(np.append(first, len(pair)).astype(np.int32), queries.items.take(pa.array(pair % len(queries.items))))
                inside = np.cumsum(edge) > 0
                a = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
                z = np.flatnonzero(inside & ~np.append(inside[1:], False)) + 1
                own = shard.doc(a)
                begin = shard.begins[own]
                spans = pa.ListArray.from_arrays(np.append(np.searchsorted(own, docs), len(own)).astype(np.int32), pa.StructArray.from_arrays([pa.array(a - begin, pa.int32()), pa.array(z - begin, pa.int32())], ["a", "b"]))
                number = b.column("shard")[row].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(docs), pa.int64()), pa.array(docs, pa.int32()), shard.ids.take(pa.array(docs)), items, spans], ["shard", "doc", "doc_id", "item_ids", "spans"])

    return run


def _near(queries: Queries, within: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                shard = Shard(b, row, within)
                for which, at, last in shard.near(queries, within):
                    each, code = queries.of(which)
                    own = shard.doc(at)
                    start = at - shard.begins[own]
                    yield pa.RecordBatch.from_arrays([shard.ids.take(pa.array(own[each])), queries.items.take(pa.array(code)), pa.array(start[each], pa.int32()), pa.array((start + last - at + 1)[each], pa.int32())], ["doc_id", "item_id", "start", "stop"])

    return run


def _in_blocks(items: DataFrame, width: int) -> Iterator[Queries]:
    """All windows, about MOST_WINDOWS at a time, by a hash of their terms."""
    found = stage(windows(items, width), "windows")
    blocks = -(-found.count() // MOST_WINDOWS)
    for block in range(blocks):
        rows = found.where(F.pmod(F.xxhash64("terms"), F.lit(blocks)) == block).toArrow()
        if rows.num_rows:
            yield Queries(rows)


def phrases(shards: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """Where documents hold exact windows of items, one row for each document that does: shard and doc tell it
    apart, doc_id, item_ids (distinct), spans of its terms that lie in an occurrence (from a, before b), ascending.

    Rows of items that share an id are one item with the windows of all, null an id like any other. Null and
    empty texts have no windows. Spans of windows that were matched in several blocks may overlap.
    """
    parts = [shards.mapInArrow(_phrases(q), MATCHES) for q in _in_blocks(items, width)]
    if not parts:
        return shards.sparkSession.createDataFrame([], MATCHES)
    found = stage_parts(parts, "phrases")
    if len(parts) == 1:
        return found
    lists = F.array_distinct(F.flatten(F.collect_list("item_ids"))), F.array_sort(F.flatten(F.collect_list("spans")))
    return found.groupBy("shard", "doc").agg(F.first("doc_id").alias("doc_id"), lists[0].alias("item_ids"), lists[1].alias("spans"))


def proximity(shards: DataFrame, items: DataFrame, width: int = 10, within: int = 20) -> DataFrame:
    """doc_id, item_id, start, stop: spans of at most within terms of a document that hold all distinct terms of
    a window of the item in any order; one for each start at which a term of the window stands."""
    parts = [shards.mapInArrow(_near(q, within), NEAR) for q in _in_blocks(items, width)]
    return stage_parts(parts, "near").distinct() if parts else shards.sparkSession.createDataFrame([], NEAR)


def contamination(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit (words inside an occurrence of a window), item_ids
    (distinct items with a window that occurs, no order), contaminated.

    docs: doc_id, text; items: item_id, text; further columns are ignored. Null, empty and blank texts have no
    words and are never hit. Rows with the same id are told apart. Without items nothing is hit; without docs
    there are no rows.
    """
    shards = index(docs)
    found = phrases(shards, items, width).drop("doc_id")
    every = shards.select("shard", F.posexplode(F.arrays_zip("ids", "sizes")).alias("doc", "d")).select("shard", "doc", F.col("d.ids").alias("doc_id"), F.col("d.sizes").alias("n_words"))
    # spans ascend: each adds what lies beyond all before it
    union = F.expr("aggregate(spans, struct(0L as n, 0 as upto), (x, s) -> struct(x.n + greatest(0, s.b - greatest(x.upto, s.a)) as n, greatest(x.upto, s.b) as upto), x -> x.n)")
    rows = every.join(found, ["shard", "doc"], "left").withColumn("n_hit", F.coalesce(union, F.lit(0)).cast("long"))
    return rows.select("doc_id", "n_words", "n_hit", F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), (F.col("n_hit") > 0).alias("contaminated"))


def digest(rows: DataFrame) -> DataFrame:
    """contamination() with n_items and the SHA-256 of the sorted ids in place of the ids; a null id counts in
    n_items and is left out of the hash."""
    listed = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return rows.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), "contaminated")
