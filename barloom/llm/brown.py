"""Language-model scoring by Brown class-based n-grams.

Words are classed by the exchange algorithm; a text's probability is the product over its tokens of the
class transition P(class | class before) and the word emission P(word | class), both smoothed.

Counts of an unbounded vocabulary are never broadcast or joined row by row. A batch of texts carries its
distinct words as one sorted array of 64-bit hashes; slices of it meet in buckets of the hash space, where
all training counts of a bucket's words are added up, and each batch gets its words' counts and classes back
as a slice of the same length.

Every word of the training rows is classed by itself, and the number of classes grows with the vocabulary.
The exchange over the ITEMS most frequent words, with the others in GROUPS groups by their ending and length
(which the hash carries in its low bits), starts the classes. Then each other word's own neighbours are
counted by class, in the word's bucket, and it moves to the class that these make likeliest. Transitions and
emissions are counted again under the final classes. A group's class is that of its unseen words only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.langid import remainder
from barloom.llm.scratch import drop, stage, sum_in_tree
from barloom.llm.text import LOWER, buffers, mix, pieces, word_hashes, words

ITEMS, GROUPS, CLASSES = 1024, 64, 48
ALL = ITEMS + GROUPS
SWEEPS = 8
#: Classes for the cube root of the number of distinct training words, CLASSES at least.
CLASSES_GROW = 2.0
#: Training tokens whose neighbours are counted at a time, and words whose classes are chosen at a time.
CONTEXT_TOKENS, CHOICE_WORDS = 1 << 21, 4096
#: Blocks that the counts of a table of bigrams are dealt to.
BLOCKS = 61
#: Distinct words of all batches that a bucket gets, and the least number of buckets.
BUCKET_WORDS, LEAST_BUCKETS = 400_000, 128
#: Text bytes in a batch.
BATCH = 1 << 20
BASE, EMIT, TRANSIT = 0.1, 0.1, 20.0
END = np.uint64(0)
_LOW = np.uint64(GROUPS - 1)


def token_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's words and one END, and n+1 offsets. The low bits are the word's group, from 1."""
    starts, ends, first = words(buf, offs)
    n = len(offs) - 1
    out = np.full(len(starts) + n, END, np.uint64)
    if len(starts):
        size = ends - starts
        last = LOWER[buf[ends - 1]].astype(np.uint64)
        before = np.where(size > 1, LOWER[buf[np.maximum(ends - 2, 0)]], 0).astype(np.uint64)
        group = mix((last << np.uint64(16)) + (before << np.uint64(8)) + np.minimum(size, 9).astype(np.uint64)) % np.uint64(GROUPS - 1) + np.uint64(1)
        h = (word_hashes(buf, starts, ends) & ~_LOW) | group
        doc = np.repeat(np.arange(n), np.diff(first))
        out[np.arange(len(starts)) + doc] = h
    return out, first + np.arange(n + 1)


def _pack(x: np.ndarray) -> bytes:
    """Non-negative integers in the narrowest type that holds them, compressed; unpack by the known length."""
    top = int(x.max()) if len(x) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + pa.compress(x.astype(f"u{width}").tobytes(), "zstd", asbytes=True)


def _unpack(raw, n: int) -> np.ndarray:
    raw = memoryview(raw.as_buffer() if hasattr(raw, "as_buffer") else raw)
    width = raw[0]
    return np.frombuffer(pa.decompress(raw[1:], n * width, "zstd"), f"u{width}") if n else np.zeros(0, np.uint8)


def _pack_words(u: np.ndarray) -> bytes:
    """Ascending hashes as their differences, compressed."""
    return _pack(np.diff(u, prepend=np.uint64(0)))


def _unpack_words(raw, n: int) -> np.ndarray:
    return np.cumsum(_unpack(raw, n), dtype=np.uint64)


_TOKENS = "batch long, doc_ids array<long>, held array<boolean>, sizes array<int>, n_words int, place binary, words binary, learn binary"


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, serial = TaskContext.get().partitionId(), 0
    for batch in batches:
        buf, offs = buffers(batch.column(1))
        for i, j in pieces(offs, BATCH):
            h, first = token_hashes(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            held = batch.column(2).slice(i, j - i)
            size = np.diff(first)
            taught = np.repeat(~np.asarray(held.to_pylist(), bool), size)
            u, back = np.unique(h, return_inverse=True)
            learn = np.bincount(back[taught], minlength=len(u))
            yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + serial], pa.int64()), pa.array([batch.column(0).slice(i, j - i).to_pylist()], pa.list_(pa.int64())), pa.array([held.to_pylist()], pa.list_(pa.bool_())), pa.array([size.astype(np.int32)], pa.list_(pa.int32())), pa.array([len(u)], pa.int32()), pa.array([_pack(back)], pa.binary()), pa.array([_pack_words(u)], pa.binary()), pa.array([_pack(learn)], pa.binary())], ["batch", "doc_ids", "held", "sizes", "n_words", "place", "words", "learn"])
            serial += 1


def _slices(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        for batch in batches:
            for r in range(batch.num_rows):
                n = batch.column(3)[r].as_py()
                u, learn = _unpack_words(batch.column(1)[r], n), _unpack(batch.column(2)[r], n)
                cuts = np.concatenate([[0], np.searchsorted(u, edges), [len(u)]])
                full = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([batch.column(0)[r].as_py()] * len(full), pa.int64()), pa.array([_pack_words(u[cuts[k] : cuts[k + 1]]) for k in full], pa.binary()), pa.array([_pack(learn[cuts[k] : cuts[k + 1]]) for k in full], pa.binary()), pa.array(np.diff(cuts)[full].astype(np.int32))], ["bucket", "batch", "words", "learn", "size"])

    return run


_MERGED = "kind string, bucket int, batches array<long>, sizes array<int>, size int, words binary, place binary, counts binary, word long, n long, v long"


def _steps(place: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ascending places of each slice as differences, which pack narrowly; _places undoes it."""
    out = np.diff(place, prepend=0)
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    out[first] = place[first]
    return out


def _places(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.cumsum(steps.astype(np.int64))
    return total - np.repeat(np.concatenate([[0], total])[np.cumsum(sizes) - sizes], sizes)


def _merge(table: pa.Table) -> pa.Table:
    """Of one bucket: its words with their counts and their places in every batch's slice, the most frequent words, and sums by group of words."""
    bucket = table.column("bucket")[0].as_py()
    rows = [_unpack_words(x, n) for x, n in zip(table.column("words"), table.column("size").to_pylist(), strict=True)]
    learn = np.concatenate([_unpack(x, len(w)) for x, w in zip(table.column("learn"), rows, strict=True)]).astype(np.float64)
    u, back = np.unique(np.concatenate(rows), return_inverse=True)
    count = np.bincount(back, learn, len(u)).astype(np.int64)
    sizes = np.array([len(w) for w in rows])
    best = np.lexsort((u, -count))[:ITEMS]
    best = best[count[best] > 0]
    group = (u & _LOW).astype(np.int64)
    n = np.bincount(group, count, GROUPS).astype(np.int64)
    v = np.bincount(group[count > 0], minlength=GROUPS)
    m = len(best)
    none = [None] * (m + GROUPS)
    return pa.table({
        "kind": pa.array(["bucket"] + ["word"] * m + ["group"] * GROUPS),
        "bucket": pa.array([bucket] * (1 + m + GROUPS), pa.int32()),
        "batches": pa.array([table.column("batch").to_pylist(), *none], pa.list_(pa.int64())),
        "sizes": pa.array([sizes.tolist(), *none], pa.list_(pa.int32())),
        "size": pa.array([len(u)] + [0] * (m + GROUPS), pa.int32()),
        "words": pa.array([_pack_words(u), *none], pa.binary()),
        "place": pa.array([_pack(_steps(back, sizes)), *none], pa.binary()),
        "counts": pa.array([_pack(count), *none], pa.binary()),
        "word": pa.array([None, *u[best].view(np.int64).tolist(), *range(GROUPS)], pa.int64()),
        "n": pa.array([None, *count[best].tolist(), *n.tolist()], pa.int64()),
        "v": pa.array([None] * (1 + m) + v.tolist(), pa.int64()),
    })


def _items(u: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The frequent words by number, then the groups."""
    item = ITEMS + (u & _LOW).astype(np.int64)
    if len(top):
        at = np.minimum(np.searchsorted(top, u), len(top) - 1)
        item = np.where(top[at] == u, at, item)
    return item


_PAIRS = "block int, task long, size int, pairs binary, counts binary"


def _tokens(row: dict, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word places of all tokens, each token's item, and the item before it (the end's, at a start); items: of the batch's words."""
    size = np.asarray(row["sizes"], np.int64)
    place = _unpack(row["place"], int(size.sum())).astype(np.int64)
    item = items.astype(np.int64)[place]
    before = np.empty_like(item)
    before[1:] = item[:-1]
    starts = np.cumsum(size) - size
    before[starts] = item[np.cumsum(size) - 1]
    return place, item, before


def _bigrams(m: int, items_of):
    """Counts of the pairs of m items that follow each other in training rows; items_of(row): the items of a batch's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(m * m, np.int64)
        held_back: list[np.ndarray] = []
        for batch in batches:
            for row in batch.to_pylist():
                _, item, before = _tokens(row, items_of(row))
                taught = np.repeat(~np.asarray(row["held"], bool), row["sizes"])
                held_back.append((before * m + item)[taught])
                if sum(map(len, held_back)) > 1 << 21:
                    total += np.bincount(np.concatenate(held_back), minlength=m * m)
                    held_back = []
        if held_back:
            total += np.bincount(np.concatenate(held_back), minlength=m * m)
        pair = np.flatnonzero(total)
        yield from _parts(pair, total[pair], TaskContext.get().partitionId())

    return run


def _parts(pair: np.ndarray, count: np.ndarray, task: int) -> Iterator[pa.RecordBatch]:
    """Counts of pairs dealt to BLOCKS blocks, so that frequent pairs are spread; within one they are ascending."""
    order = np.argsort(pair % BLOCKS, kind="stable")
    cuts = np.searchsorted((pair % BLOCKS)[order], np.arange(BLOCKS + 1))
    full = np.flatnonzero(np.diff(cuts))
    own = [order[cuts[b] : cuts[b + 1]] for b in full]
    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([task] * len(full), pa.int64()), pa.array([len(x) for x in own], pa.int32()), pa.array([_pack(np.diff(pair[x], prepend=0)) for x in own], pa.binary()), pa.array([_pack(count[x]) for x in own], pa.binary())], ["block", "task", "size", "pairs", "counts"])


def _add_pairs(table: pa.Table) -> pa.Table:
    """The sum of partial counts of one block."""
    pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for n, p, c in zip(table.column("size").to_pylist(), table.column("pairs"), table.column("counts"), strict=True):
        pairs, back = np.unique(np.concatenate([pairs, np.cumsum(_unpack(p, n), dtype=np.int64)]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([counts, _unpack(c, n)]).astype(float), len(pairs)).astype(np.int64)
    return pa.table({"block": table.column("block").slice(0, 1), "task": table.column("task").slice(0, 1), "size": pa.array([len(pairs)], pa.int32()), "pairs": pa.array([_pack(np.diff(pairs, prepend=0))], pa.binary()), "counts": pa.array([_pack(counts)], pa.binary())})


def _pair_table(rows: DataFrame, m: int, items_of) -> np.ndarray:
    out = np.zeros(m * m)
    parts = rows.mapInArrow(_bigrams(m, items_of), _PAIRS)
    for r in sum_in_tree(parts, ["block"], "task", _add_pairs, _PAIRS).collect():  # BLOCKS rows, m * m counts at most
        out[np.cumsum(_unpack(r.pairs, r.size), dtype=np.int64)] = _unpack(r.counts, r.size)
    return out.reshape(m, m)


_CONTEXTS = "bucket int, n_words int, n_features int, words binary, sizes binary, features binary, counts binary"


def _contexts(seeds, bits: int):
    """How often each class stands before (features 0 to K-1) and after (K to 2K-1) each training word that is not in top, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, cls, k = seeds.value
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        held_back: list[tuple[np.ndarray, np.ndarray]] = []

        def told() -> Iterator[pa.RecordBatch]:
            u, back = np.unique(np.concatenate([w for w, _ in held_back]), return_inverse=True)
            cuts = np.cumsum([0, *[len(w) for w, _ in held_back]])
            key, count = np.unique(np.concatenate([back[a + (x // (2 * k))] * (2 * k) + x % (2 * k) for a, (_, x) in zip(cuts[:-1], held_back, strict=True)]), return_counts=True)
            held_back.clear()
            word, feature = key // (2 * k), (key % (2 * k)).astype(np.uint16)
            at = np.concatenate([[0], np.searchsorted(u, edges), [len(u)]])
            inside = np.searchsorted(word, at)
            size = np.bincount(word, minlength=len(u))
            full = np.flatnonzero(np.diff(inside))
            words_of, features_of = [slice(at[b], at[b + 1]) for b in full], [slice(inside[b], inside[b + 1]) for b in full]
            yield pa.RecordBatch.from_arrays([
                pa.array(full, pa.int32()), pa.array(np.diff(at)[full].astype(np.int32)), pa.array(np.diff(inside)[full].astype(np.int32)),
                pa.array([_pack_words(u[x]) for x in words_of], pa.binary()), pa.array([_pack(size[x]) for x in words_of], pa.binary()), pa.array([_pack(feature[x]) for x in features_of], pa.binary()), pa.array([_pack(count[x]) for x in features_of], pa.binary()),
            ], ["bucket", "n_words", "n_features", "words", "sizes", "features", "counts"])

        for batch in batches:
            for row in batch.to_pylist():
                u = _unpack_words(row["words"], row["n_words"])
                item = _items(u, top)
                place, now, before = _tokens(row, cls[item])
                taught = np.repeat(~np.asarray(row["held"], bool), row["sizes"])
                last = np.cumsum(row["sizes"]) - 1
                after = np.empty_like(now)
                after[:-1] = now[1:]
                after[last] = now[last - np.asarray(row["sizes"]) + 1]  # the end is before the text's first word
                mine = taught & (item >= ITEMS)[place]
                if mine.any():
                    w, x = np.unique(place[mine], return_inverse=True)
                    held_back.append((u[w], np.concatenate([x * (2 * k) + before[mine], x * (2 * k) + k + after[mine]])))
                if sum(len(x) for _, x in held_back) > 2 * CONTEXT_TOKENS:
                    yield from told()
        if held_back:
            yield from told()

    return run


_CLASSED = "kind string, bucket int, batch long, counts binary, classes binary, word long, n long, v long"


def _choose(seeds, affinity):
    """Of one bucket: each word's class, every batch's slice of counts and classes, and sums by class."""

    def run(bucket: pa.Table, contexts: pa.Table) -> pa.Table:
        top, seed, k = seeds.value
        likes: np.ndarray = affinity.value
        row = bucket.to_pylist()[0]
        u = _unpack_words(row["words"], row["size"])
        count = _unpack(row["counts"], len(u)).astype(np.int64)
        cls = seed[_items(u, top)].astype(np.uint16)
        word, feature, times = [np.zeros(0, np.int32)], [np.zeros(0, np.uint16)], [np.zeros(0, np.uint32)]
        for r in contexts.to_pylist():
            w = _unpack_words(r["words"], r["n_words"])
            word.append(np.repeat(np.searchsorted(u, w), _unpack(r["sizes"], len(w))).astype(np.int32))
            feature.append(_unpack(r["features"], r["n_features"]).astype(np.uint16))
            times.append(_unpack(r["counts"], r["n_features"]).astype(np.uint32))
        word, feature, times = np.concatenate(word), np.concatenate(feature), np.concatenate(times)
        order = np.argsort(word, kind="stable")
        word, feature, times = word[order], feature[order], times[order]
        own = np.unique(word)
        for a in range(0, len(own), CHOICE_WORDS):
            some = own[a : a + CHOICE_WORDS]
            i, j = np.searchsorted(word, some[0]), np.searchsorted(word, some[-1], "right")
            seen = np.bincount(np.searchsorted(some, word[i:j]) * (2 * k) + feature[i:j], times[i:j], len(some) * 2 * k).reshape(len(some), 2 * k)
            cls[some] = (seen @ likes).argmax(axis=1)
        sizes = np.array(row["sizes"])
        back = _places(_unpack(row["place"], int(sizes.sum())), sizes)
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        at = [back[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        m = len(at)
        return pa.table({
            "kind": pa.array(["slice"] * m + ["class"] * k),
            "bucket": pa.array([row["bucket"]] * (m + k), pa.int32()),
            "batch": pa.array(row["batches"] + [None] * k, pa.int64()),
            "counts": pa.array([int(len(x)).to_bytes(4, "little") + _pack(count[x]) for x in at] + [None] * k, pa.binary()),
            "classes": pa.array([_pack(cls[x]) for x in at] + [None] * k, pa.binary()),
            "word": pa.array([None] * m + list(range(k)), pa.int64()),
            "n": pa.array([None] * m + np.bincount(cls, count, k).astype(np.int64).tolist(), pa.int64()),
            "v": pa.array([None] * m + np.bincount(cls[count > 0], minlength=k).tolist(), pa.int64()),
        })

    return run


_WHOLE = "doc_ids array<long>, held array<boolean>, sizes array<int>, place binary, counts binary, classes binary, n_words int"


def _join_slices(tokens: pa.Table, slices: pa.Table) -> pa.Table:
    """Each batch with the counts and classes of its words."""
    parts = sorted(zip(slices.column("bucket").to_pylist(), slices.column("counts").to_pylist(), slices.column("classes").to_pylist(), strict=True))
    sizes = [int.from_bytes(c[:4], "little") for _, c, _ in parts]
    counts = [_unpack(c[4:], n) for n, (_, c, _) in zip(sizes, parts, strict=True)]
    classes = [_unpack(c, n) for n, (_, _, c) in zip(sizes, parts, strict=True)]
    assert tokens.num_rows == 1 and sum(sizes) == tokens.column("n_words")[0].as_py()
    keep = {c: tokens.column(c) for c in ("doc_ids", "held", "sizes", "place")}
    return pa.table(keep | {"counts": pa.array([_pack(np.concatenate(counts))], pa.binary()), "classes": pa.array([_pack(np.concatenate(classes))], pa.binary()), "n_words": tokens.column("n_words")})


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """A class of each item: every item in turn moves to the class that makes the class bigrams likeliest."""
    m = len(bigrams)
    n = bigrams.astype(np.float64)
    left, right = n.sum(axis=1), n.sum(axis=0)
    order = np.argsort(-(left + right), kind="stable")
    cls = np.empty(m, np.int64)
    cls[order] = np.arange(m) % classes
    member = np.zeros((m, classes))
    member[np.arange(m), cls] = 1
    out, into = n @ member, n.T @ member  # to and from each class, by item
    table = member.T @ out
    rows, cols = table.sum(axis=1), table.sum(axis=0)
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not left[w] + right[w]:
                continue
            old, own = cls[w], n[w, w]
            o, i = out[w].copy(), into[w].copy()
            o[old] -= own  # what w has with itself moves along
            i[old] -= own
            table[old] -= o
            table[:, old] -= i
            table[old, old] -= own
            rows[old] -= left[w]
            cols[old] -= right[w]
            now = _xlogx(table)
            gain = (_xlogx(table + o[None, :]) - now).sum(axis=1) + (_xlogx(table + i[:, None]) - now).sum(axis=0)
            d = np.diagonal(table)
            gain += _xlogx(d + o + i + own) - _xlogx(d + o) - _xlogx(d + i) + _xlogx(d)
            gain -= _xlogx(rows + left[w]) - _xlogx(rows) + _xlogx(cols + right[w]) - _xlogx(cols)
            new = int(gain.argmax()) if gain.max() > gain[old] + 1e-9 else old
            table[new] += o
            table[:, new] += i
            table[new, new] += own
            rows[new] += left[w]
            cols[new] += right[w]
            if new != old:
                moved += 1
                cls[w] = new
                out[:, old] -= n[:, w]
                out[:, new] += n[:, w]
                into[:, old] -= n[w]
                into[:, new] += n[w]
        if not moved:
            break
    return cls


@dataclass
class Model:
    top: np.ndarray
    classes: np.ndarray
    #: log10 of the class transitions, and what a word's count is divided by in each class
    transit: np.ndarray
    emit: np.ndarray
    tokens: int
    distinct: int


def n_classes(distinct: int) -> int:
    """The number of classes for so many distinct training words."""
    return max(CLASSES, round(CLASSES_GROW * distinct ** (1 / 3)))


def _transit(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed transitions between classes, and their frequencies alone."""
    alone = (table.sum(axis=0) + 1) / (table.sum() + len(table))
    return (table + TRANSIT * alone[None, :]) / (table.sum(axis=1, keepdims=True) + TRANSIT), alone


def _model(top: np.ndarray, top_n: np.ndarray, group_n: np.ndarray, group_v: np.ndarray, bigrams: np.ndarray) -> Model:
    """The classes of the frequent words and of the groups, with which the other words' classes start."""
    n = np.zeros(ALL)
    v = np.zeros(ALL)
    n[: len(top)], v[: len(top)] = top_n, 1
    g = (top & _LOW).astype(np.int64)
    n[ITEMS:] = group_n - np.bincount(g, top_n, GROUPS)
    v[ITEMS:] = group_v - np.bincount(g, minlength=GROUPS)
    k = n_classes(int(group_v.sum()))
    cls = exchange(bigrams, k)
    member = np.zeros((ALL, k))
    member[np.arange(ALL), cls] = 1
    transit, _ = _transit(member.T @ bigrams.astype(np.float64) @ member)
    return Model(top, cls, np.log10(transit), member.T @ n + EMIT * (member.T @ v + 1), int(group_n.sum()), int(group_v.sum()))


def _affinity(table: np.ndarray) -> np.ndarray:
    """What one neighbour of each class, before and then after, says for each class of a word."""
    transit, alone = _transit(table)
    likes = np.log(transit / alone[None, :])
    return np.concatenate([likes, likes.T])


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            for row in batch.to_pylist():
                classes = _unpack(row["classes"], row["n_words"])
                place, now, before = _tokens(row, classes)
                c = _unpack(row["counts"], row["n_words"]).astype(np.float64)
                base = np.log10((c + BASE) / (m.tokens + BASE * (m.distinct + 1)))
                emit = np.log10((c + EMIT) / m.emit[classes])
                starts = np.cumsum(row["sizes"]) - row["sizes"]
                total = lambda x: np.add.reduceat(x, starts)  # noqa: E731, B023
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": pa.array(row["sizes"], pa.int64()),
                    "n_known": pa.array(total((c > 0)[place].astype(np.int64)), pa.int64()), "train_tokens": pa.array([m.tokens] * len(starts), pa.int64()),
                    "base_score": pa.array(total(base[place])), "score": pa.array(total(m.transit[before, now] + emit[place])),
                })

    return run


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(docs: DataFrame, mod: int = 10, held: int = 0) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose crc32(doc_id as text) mod mod is not held. Tokens are a text's words with A-Z
    lower-cased, then one end; null and empty texts have the end alone. base_score is the additively smoothed
    unigram log10 probability, score that of the class model. Without rows to learn from, every count is 0.
    An empty table gives no rows; rows that repeat are scored each.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (remainder(mod) == held).alias("held_out"))
    tokens = stage(rows.mapInArrow(_tokenise, _TOKENS), "tokens")
    entries = tokens.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    bits = (max(LEAST_BUCKETS, -(-entries // BUCKET_WORDS)) - 1).bit_length()
    merged = stage(tokens.select("batch", "words", "learn", "n_words").mapInArrow(_slices(bits), "bucket int, batch long, words binary, learn binary, size int").groupBy("bucket").applyInArrow(_merge, _MERGED), "counts")
    best = merged.where("kind = 'word'").select("word", "n").orderBy(F.desc("n"), "word").limit(ITEMS).collect()
    pairs = sorted((r.word & (1 << 64) - 1, r.n) for r in best)
    top, top_n = np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.float64)
    group_n, group_v = np.zeros(GROUPS), np.zeros(GROUPS)
    for r in merged.where("kind = 'group'").groupBy("word").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        group_n[r.word], group_v[r.word] = r.n, r.v
    bigrams = _pair_table(tokens, ALL, lambda row: _items(_unpack_words(row["words"], row["n_words"]), top))
    first = _model(top, top_n, group_n, group_v, bigrams)
    k = len(first.transit)
    member = np.eye(k)[first.classes]
    seeds = spark.sparkContext.broadcast((top, first.classes, k))
    likes = spark.sparkContext.broadcast(_affinity(member.T @ bigrams @ member))
    contexts = tokens.mapInArrow(_contexts(seeds, bits), _CONTEXTS)
    buckets = merged.where("kind = 'bucket'").select("bucket", "batches", "sizes", "size", "words", "place", "counts")
    classed = stage(buckets.groupBy("bucket").cogroup(contexts.groupBy("bucket")).applyInArrow(_choose(seeds, likes), _CLASSED), "classes")
    drop(merged)
    n, v = np.zeros(k), np.zeros(k)
    for r in classed.where("kind = 'class'").groupBy("word").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        n[r.word], v[r.word] = r.n, r.v
    slices = classed.where("kind = 'slice'").select("batch", "bucket", "counts", "classes")
    whole = stage(tokens.drop("words", "learn").groupBy("batch").cogroup(slices.groupBy("batch")).applyInArrow(_join_slices, _WHOLE), "classed")
    drop(tokens)
    drop(classed)
    transit, _ = _transit(_pair_table(whole, k, lambda row: _unpack(row["classes"], row["n_words"])))
    model = spark.sparkContext.broadcast(Model(top, first.classes, np.log10(transit), n + EMIT * (v + 1), first.tokens, first.distinct))
    return whole.mapInArrow(_score(model), _SCORED)
