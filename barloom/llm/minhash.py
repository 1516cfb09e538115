"""Near-duplicate documents: MinHash signatures, banding, verification and connected components.

1. One pass over the texts makes each document's shingle hashes, a 128-bit fingerprint of their set, and
   the minima of ROWS * BANDS universal hash functions. Equal sets become one representative.
2. Representatives that share a band's hash meet in a bucket. A bucket never emits all its pairs: every
   member is paired with one pivot, the pairs are verified (sizes, then signatures, then full sets), and
   components are found.
3. Pairs of documents that met someone in a bucket, but lie in different components, are searched exactly:
   prefix and bitmap filters, which lose no pair, leave those that can be similar, and all of them are
   verified. So a large group of copies costs a few pairs a member, and no cap is needed on buckets or
   partners.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.components import connected_components
from barloom.llm.scratch import drop, stage, sum_in_tree
from barloom.llm.text import buffers, mix, pieces, shingles, word_hashes, words

#: A pair at similarity 0.85 shares no band with a probability of (1 - 0.85**5)**30 = 2e-8, at 0.8 of 1e-5.
ROWS, BANDS = 5, 30
#: Estimates this far below the threshold (over 5 standard deviations of 150 minima) need no full sets.
SLACK = 0.17
#: So many ids are broadcast to pick documents from the table (16 MB); more are joined.
BROADCAST_IDS = 1 << 20
#: Counters of shingles among documents that share a bucket, 16 bits each, broadcast: one for four
#: shingles, but at most 64 MB of them (beyond that they tell large groups' common shingles from the rest less
#: sharply, and the search gets slower, not less complete). Those in a group.
FEWEST_COUNTERS, MOST_COUNTERS = 1 << 20, 1 << 25
BLOCK = 1 << 14
#: Pairs of one document that a task joins at most, unless that is less than one part in LEAST_SHARE of all pairs.
LARGE, LEAST_SHARE = 2048, 100_000
#: 64-bit words of a set's parity map.
MAPS = 8

_R = np.random.default_rng(71)
_A = _R.integers(0, 1 << 64, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)
_B = _R.integers(0, 1 << 64, ROWS * BANDS, dtype=np.uint64)


def signatures(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Minima of the multiply-shift hashes a*x+b >> 32 of each (not empty) run of shingle hashes."""
    out = np.empty((len(offs) - 1, ROWS * BANDS), np.uint32)
    top = np.uint64(32)
    for k in range(ROWS * BANDS):
        out[:, k] = np.minimum.reduceat((h * _A[k] + _B[k]) >> top, offs[:-1])
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band with its number."""
    acc = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(sig), BANDS)).copy()
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    for r in range(ROWS):
        acc = mix(acc * np.uint64(0x9FB21C651E98DF25) + parts[:, :, r])
    return acc


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each piece of a batch: its rows i to j, all shingle hashes sorted and distinct by row, offsets."""
    buf, offs = buffers(column)
    for i, j in pieces(offs):
        part, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        starts, ends, first = words(part, o)
        h, so = shingles(word_hashes(part, starts, ends), first, width)
        doc = np.repeat(np.arange(j - i), np.diff(so))
        order = np.lexsort((h, doc)) if j - i > 1 else np.argsort(h)
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
        yield i, j, h, np.searchsorted(doc, np.arange(j - i + 1))


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, offs in shingle_sets(batch.column(1), width):
                n = np.diff(offs)
                full = np.flatnonzero(n > 0)
                marks = np.zeros((j - i, 2), np.uint64)
                hashed = np.zeros((0, BANDS), np.uint64)
                if len(full):
                    cut = np.append(offs[:-1][full], offs[-1])
                    marks[full, 0] = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), cut[:-1])
                    marks[full, 1] = np.bitwise_xor.reduceat(mix(h + np.uint64(0x14057B7EF767814F)), cut[:-1])
                    hashed = bands(signatures(h, cut))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]), pa.int32()), pa.array(hashed.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array([m.tobytes() for m in marks], pa.binary()), lists], ["doc_id", "n_shingles", "mark", "bands"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, offs in shingle_sets(batch.column(1), width):
                n = np.diff(offs)
                full = np.flatnonzero(n > 0)
                if not len(full):
                    continue
                sig = signatures(h, np.append(offs[:-1][full], offs[-1]))
                raw = h.view(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(full)), pa.array(n[full].astype(np.int32)), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array([raw[8 * offs[k] : 8 * offs[k + 1]].tobytes() for k in full], pa.binary())], ["doc_id", "n", "sig", "members"])

    return run


def similar(a: bytes, b: bytes, num: int, den: int) -> bool:
    """den * |intersection| >= num * |union| of two sorted sets of 64-bit hashes."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(x) else 0
    return den * both >= num * (len(x) + len(y) - both)


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar. Columns of sets: doc_id, sig, members."""

    def by_signature(x, y) -> bool:
        return bool((np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32)).mean() >= num / den - SLACK)

    def filtered(test, with_: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b, x, y = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", f"{with_}_a", f"{with_}_b"))
                mask = pa.array([test(x[k].as_buffer(), y[k].as_buffer()) for k in range(batch.num_rows)], pa.bool_())
                yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

        hot = _hot(pairs)
        both = _beside(_beside(pairs, sets, "a", with_, hot), sets, "b", with_, hot)
        return both.mapInArrow(run, "a long, b long")

    # signatures are of one size and small: full sets are sent for the pairs only that these leave
    pairs = stage(filtered(by_signature, "sig"), "alike")
    return filtered(lambda x, y: similar(x, y, num, den), "members").select(F.col("a").alias("u"), F.col("b").alias("v"))


def _hot(pairs: DataFrame) -> DataFrame | None:
    """id, parts: the documents of more than LARGE pairs (the pivot of a large bucket), or of more than one part in
    LEAST_SHARE of all, and in how many parts their pairs are joined. None if there are none."""
    total = pairs.count()
    large = max(LARGE, total // LEAST_SHARE)
    if total <= large:
        return None
    both = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    # at most twice LEAST_SHARE rows, as their counts add up to twice the total
    hot = stage(both.groupBy("id").agg(F.count("*").alias("k")).where(F.col("k") > large).select("id", F.ceil(F.col("k") / large).cast("int").alias("parts")), "hot")
    return None if hot.isEmpty() else hot


def _beside(pairs: DataFrame, sets: DataFrame, side: str, column: str, hot: DataFrame | None) -> DataFrame:
    """pairs with a column of sets for the document of that side, as column_side; hot documents' pairs are dealt
    to several tasks, and their sets go to each of these."""
    own = sets.select(F.col("doc_id").alias(side), F.col(column).alias(f"{column}_{side}"))
    if hot is None:
        return pairs.join(own, side)
    hot = F.broadcast(hot.withColumnRenamed("id", side))
    other = "b" if side == "a" else "a"
    dealt = pairs.join(hot, side, "left").withColumn("part", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    spread = own.join(hot, side, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(spread, [side, "part"]).drop("part")


def _slot(h: np.ndarray, counters: int) -> np.ndarray:
    return (h & np.uint64(counters - 1)).astype(np.int64)


def _count_members(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How often each counter is hit by the sets of a task, by block of counters."""
        hits, counts, waiting, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def settle() -> None:
            nonlocal hits, counts, waiting, size
            slots, n = np.unique(np.concatenate(waiting), return_counts=True) if waiting else (hits[:0], counts[:0])
            both, back = np.unique(np.concatenate([hits, slots]), return_inverse=True)
            hits, counts = both, np.bincount(back, np.concatenate([counts, n]), len(both)).astype(np.int64)
            waiting, size = [], 0

        for batch in batches:
            for x in batch.column(0):
                waiting.append(_slot(np.frombuffer(x.as_buffer(), np.uint64), counters))
                size += len(waiting[-1])
                if size > 1 << 20:
                    settle()
        settle()
        cuts = np.searchsorted(hits, np.arange(0, counters + BLOCK, BLOCK))
        full = np.flatnonzero(np.diff(cuts))
        spans = [slice(cuts[k], cuts[k + 1]) for k in full]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([TaskContext.get().partitionId()] * len(full), pa.int64()), pa.array([(hits[s] % BLOCK).astype(np.uint32).tobytes() for s in spans], pa.binary()), pa.array([counts[s].astype(np.uint32).tobytes() for s in spans], pa.binary())], ["block", "task", "slots", "counts"])

    return run


_COUNTS = "block int, task long, slots binary, counts binary"


def _add_counts(table: pa.Table) -> pa.Table:
    """The sum of partial counts of one block of counters; 65535 stands for more."""
    total = np.zeros(BLOCK, np.int64)
    for p, c in zip(table.column("slots"), table.column("counts"), strict=True):
        total[np.frombuffer(p.as_buffer(), np.uint32)] += np.frombuffer(c.as_buffer(), np.uint32)
    slots = np.flatnonzero(total)
    return pa.table({"block": table.column("block").slice(0, 1), "task": table.column("task").slice(0, 1), "slots": pa.array([slots.astype(np.uint32).tobytes()], pa.binary()), "counts": pa.array([np.minimum(total[slots], 65535).astype(np.uint32).tobytes()], pa.binary())})


def _dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The 16-bit counters of whole blocks."""
    for batch in batches:
        rows = []
        for p, c in zip(batch.column(2), batch.column(3), strict=True):
            block = np.zeros(BLOCK, np.uint16)
            block[np.frombuffer(p.as_buffer(), np.uint32)] = np.frombuffer(c.as_buffer(), np.uint32)
            rows.append(block.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["block", "counts"])


def _prefixes(shared, num: int, den: int):
    """The rarest members of each set: two similar sets share one of them, whatever fixed order says what is rare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            out, places, maps = [], [], []
            for x in batch.column(1):
                h = np.frombuffer(x.as_buffer(), np.uint64)
                seen = often[_slot(h, len(often))]
                first = np.lexsort((h, seen))[: len(h) - -(-num * len(h) // den) + 1]
                at = np.flatnonzero(seen[first] > 1)  # a counter of 1 is a member that no other set has
                out.append(h[first][at])
                places.append(at)
                odd = np.bincount((h >> np.uint64(50)).astype(np.int64) % (64 * MAPS), minlength=64 * MAPS) & 1
                maps.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            size = [len(x) for x in out]
            rows = np.repeat(np.arange(len(out)), size)
            bits = np.array(maps, np.int64).reshape(-1, MAPS)[rows]
            join = lambda x, kind: np.concatenate([*x, np.zeros(0, kind)]).astype(kind, copy=False)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(join(out, np.uint64).view(np.int64)), pa.array(join(places, np.int64), pa.int32()), batch.column(2).take(pa.array(rows)), *[pa.array(bits[:, k]) for k in range(MAPS)]], ["doc_id", "member", "place", "n", *[f"m{k}" for k in range(MAPS)]])

    return run


def _by_prefix(sets: DataFrame, found: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): pairs of documents of sets that lie in different components and can be similar.

    Prefix filtering: in a fixed order of all shingles, similar sets share one early enough in both to leave
    room for the overlap that they need. The order is by count, from a table of counters, so a much
    edited copy shows its own edits first and meets few, however many copies there are. Bitmap filtering: the
    members of only one of two sets are at least as many as the bits in which their parity maps differ.
    Neither loses a similar pair.
    """
    members = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counters = min(MOST_COUNTERS, max(FEWEST_COUNTERS, 1 << (members // 4).bit_length()))
    often = np.ones(counters, np.uint16)
    summed = sum_in_tree(sets.select("members").mapInArrow(_count_members(counters), _COUNTS), ["block"], "task", _add_counts, _COUNTS)
    for r in summed.mapInArrow(_dense, "block int, counts binary").collect():  # two bytes a counter
        often[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.counts, np.uint16)
    shared = sets.sparkSession.sparkContext.broadcast(often)
    rows = sets.select("doc_id", "members", "n").mapInArrow(_prefixes(shared, num, den), "doc_id long, member long, place int, n int, " + ", ".join(f"m{k} long" for k in range(MAPS)))
    rows = rows.join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    rows = stage(rows.withColumn("component", F.coalesce("component", "doc_id")), "prefixes")
    # of a shingle's rows, those of its main component are compared with the others, never among themselves
    main = rows.groupBy("member", "component").agg(F.count("*").alias("c")).groupBy("member").agg(F.max(F.struct("c", "component")).alias("main"), F.count("*").alias("k")).where("k > 1").select("member", F.col("main.component").alias("main"))
    here = rows.join(main, "member")
    x, y = here.where("component <> main").alias("x"), here.alias("y")
    need = f"(({num} * (x.n + y.n) + {num + den - 1}) div {num + den})"
    differ = " + ".join(f"bit_count(x.m{k} ^ y.m{k})" for k in range(MAPS))
    both = x.join(y, F.expr(f"x.member = y.member and x.component <> y.component and (y.component = y.main or x.component < y.component) and x.place + {need} <= x.n and y.place + {need} <= y.n and {differ} <= x.n + y.n - 2 * {need}"))
    return both.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()


def _same_id(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """(u, v): links between the representatives of an id's rows, where an id is repeated with another text."""
    own = signed.where("doc_id is not null").join(classes, ["mark", "n_shingles"]).select("doc_id", "rep")
    least = own.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("top")).where("u <> top").select("doc_id", "u")
    return own.join(least, "doc_id").where("rep <> u").select("u", F.col("rep").alias("v"))


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    Two documents are linked when the Jaccard similarity of their sets of width-word shingles is num/den or
    more, confirmed on the full sets (as 64-bit hashes). A document with fewer words has one shingle, its
    whole sequence; one without words, or null, has none and is linked with nothing. component_id is the
    smallest doc_id reachable; the document with that id is kept. Rows that repeat an id are
    one document, linked by what any of them is linked with; a null id is linked with nothing and kept. Empty tables give no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stage(docs.mapInArrow(_sign(width), "doc_id long, n_shingles long, mark binary, bands array<long>"), "signed")
    classes = stage(signed.where("n_shingles > 0 and doc_id is not null").groupBy("mark", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    reps = stage(signed.join(classes.select("mark", "n_shingles", F.col("rep").alias("doc_id")), ["mark", "n_shingles", "doc_id"]).select("doc_id", F.col("n_shingles").cast("int").alias("n"), F.explode("bands").alias("key")), "bands")

    pivots = reps.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("p"), F.count("*").alias("size")).where("size > 1").select("key", F.col("p.doc_id").alias("pivot"), F.col("p.n").alias("pivot_n"))
    met = stage(reps.join(pivots, "key"), "met")
    fits = lambda x, y: den * F.least(x, y) >= num * F.greatest(x, y)
    pairs = stage(met.where(F.col("doc_id") != F.col("pivot")).where(fits(F.col("n"), F.col("pivot_n"))).select(F.least("pivot", "doc_id").alias("a"), F.greatest("pivot", "doc_id").alias("b")).distinct(), "pairs")

    ids = stage(met.select("doc_id").distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    picked = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    sets = stage(picked.mapInArrow(_sets(width), "doc_id long, n int, sig binary, members binary"), "sets")

    links = _verify(pairs, sets, num, den)
    if not signed.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").isEmpty():
        links = links.unionByName(_same_id(signed, classes))
    links = stage(links, "links")
    found = connected_components(links)
    new = stage(_by_prefix(sets, found, num, den), "pairs")
    more = stage(_verify(new, sets, num, den), "links")
    if not more.isEmpty():
        found = connected_components(links.unionByName(more))
    found = stage(found, "found")
    rows = signed.select("doc_id", "n_shingles", "mark").join(classes, ["mark", "n_shingles"], "left")
    rows = rows.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    rows = rows.withColumn("component_id", F.coalesce("component", "rep", "doc_id"))
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
