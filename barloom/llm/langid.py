"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training sums, for every language, how often each of BUCKETS hashed n-grams occurs; a task keeps one count
vector a language whatever it reads, and the vectors are summed in shards. The matrix of log
probabilities, BUCKETS * languages * 4 bytes, is broadcast; scoring adds up the rows of a text's distinct
n-grams times their counts, for whole batches of texts in numpy. Long texts are worked through in overlapping
parts. The predicted language is that of the largest posterior, whole; only the reported score is taken from
the posterior scaled to EVIDENCE n-grams, so that scores of short and long texts can be compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.scratch import sum_in_tree

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
SHARDS = 32
#: n-grams that a text's evidence counts as at most, so that scores of long texts stay comparable.
EVIDENCE = 60
#: Languages that the broadcast matrix may have (256 KB each).
MOST_LANGUAGES = 1000
NONE = "und"
#: Code points of a part of a text, and numbers of weights that are gathered at a time.
PART, CELLS = 1 << 18, 1 << 22

_MULTIPLY = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


def _letters() -> np.ndarray:
    """Code point to lower-case letter; anything that is no letter becomes a space."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x20000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low[0])
    rest = np.arange(0x20000, 0x323B0, dtype=np.uint32)
    table[0x20000:0x323B0] = rest
    return table


_TABLE: list[np.ndarray] = []


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts one after another, and n+1 offsets."""
    if not _TABLE:
        _TABLE.append(_letters())
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[0][np.minimum(raw, 0x10FFFF)], offs


def grams(codes: np.ndarray, offs: np.ndarray, own: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """For each order the bucket of the n-gram that starts at each place; BUCKETS where it would leave the text,
    starts beyond the text's own first places, or where there is nothing but spaces."""
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    blank = codes == 32
    beyond = np.zeros(len(codes), bool)
    if own is not None:
        length = np.diff(offs)
        beyond = np.arange(len(codes)) - np.repeat(offs[:-1], length) >= np.repeat(own, length)
    for n in ORDERS:
        m = max(0, len(codes) - n + 1)
        h = np.full(m, np.uint32(n * 0x27D4EB2F & 0xFFFFFFFF))
        void = beyond[:m].copy()
        nothing = np.ones(m, bool)
        for k in range(n):
            h ^= codes[k : k + m] * _MULTIPLY[k]
            h = (h << np.uint32(13) | h >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64)
            nothing &= blank[k : k + m]
        out = np.full(len(codes), BUCKETS, np.int64)
        out[:m] = (h * np.uint32(0x2C1B3C6D)) >> shift
        out[:m][void | nothing] = BUCKETS
        ends = offs[1:][np.diff(offs) > 0]
        for k in range(1, n):  # would cross into the next text
            out[np.maximum(ends - k, 0)] = BUCKETS
        yield out


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[str], np.ndarray]]:
    """Texts between spaces, cut into overlapping parts of PART code points, in groups of some PART together:
    each part's text by number, the part with what its last n-grams need, and its own first places."""
    numbers: list[int] = []
    parts: list[str] = []
    own: list[int] = []
    size = 0
    for k, t in enumerate(texts):
        whole = f" {t or ''} "
        for a in range(0, len(whole), PART):
            part = whole[a : a + PART + max(ORDERS) - 1]
            if size and size + len(part) > PART + max(ORDERS):
                yield np.array(numbers), parts, np.array(own)
                numbers, parts, own, size = [], [], [], 0
            numbers.append(k)
            parts.append(part)
            own.append(min(PART, len(whole) - a))
            size += len(part)
    if parts:
        yield np.array(numbers), parts, np.array(own)


@dataclass
class Model:
    langs: list[str]
    #: (BUCKETS + 1) x languages; the last row is zero
    weights: np.ndarray
    prior: np.ndarray

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text by the whole posterior, and its probability with that posterior scaled to EVIDENCE n-grams."""
        if not self.langs or not texts:
            return [NONE] * len(texts), np.zeros(len(texts))
        sums, seen, found = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts)), np.zeros(len(texts), bool)
        rows = max(1, CELLS // len(self.langs))
        for number, parts, own in _pieces(texts):
            codes, offs = _codes(parts)
            length = np.diff(offs)
            found[np.unique(np.repeat(number, length)[codes > 32])] = True
            place = np.repeat(number - number[0], length) * (BUCKETS + 1)
            for g in grams(codes, offs, own):
                # each text's distinct buckets once, with their counts
                key, n = np.unique((place + g)[g < BUCKETS], return_counts=True)
                text, bucket = key // (BUCKETS + 1) + number[0], key % (BUCKETS + 1)
                for a in range(0, len(key), rows):
                    t, first = np.unique(text[a : a + rows], return_index=True)
                    sums[t] += np.add.reduceat(self.weights[bucket[a : a + rows]] * n[a : a + rows, None], first, axis=0, dtype=np.float64)
                seen += np.bincount(text, n, len(texts))
        logit = self.prior + sums
        logit -= logit.max(axis=1, keepdims=True)
        logit *= np.minimum(1.0, EVIDENCE / np.maximum(seen, 1))[:, None]  # prior and evidence alike: the order stays
        p = np.exp(logit)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return [self.langs[b] if f else NONE for b, f in zip(best, found, strict=True)], np.where(found, p[np.arange(len(best)), best], 0.0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        texts = batch.column(0).to_pylist()
        for lang in dict.fromkeys(langs):
            own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
            docs[lang] = docs.get(lang, 0) + len(own)
            total = counts.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
            for _, parts, first in _pieces(own):
                for g in grams(*_codes(parts), first):
                    total += np.bincount(g, minlength=BUCKETS + 1)
    step = BUCKETS // SHARDS
    for lang, c in counts.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * SHARDS), pa.array(range(SHARDS), pa.int32()), pa.array([task] * SHARDS, pa.int64()), pa.array([docs[lang]] * SHARDS, pa.int64()), pa.array([c[k * step : (k + 1) * step].tobytes() for k in range(SHARDS)], pa.binary())], ["lang", "shard", "task", "docs", "counts"])


def _sum(table: pa.Table) -> pa.Table:
    total = np.zeros(BUCKETS // SHARDS, np.int64)
    for x in table.column("counts"):
        total += np.frombuffer(x.as_buffer(), np.int64)
    return pa.table({"lang": table.column("lang").slice(0, 1), "shard": table.column("shard").slice(0, 1), "task": table.column("task").slice(0, 1), "docs": pa.array([sum(table.column("docs").to_pylist())], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})


_COUNTS = "lang string, shard int, task long, docs long, counts binary"


def train(labelled: DataFrame) -> Model:
    """A model from the text and lang of all rows; rows without a lang teach nothing."""
    rows = labelled.where("lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    summed = sum_in_tree(rows.mapInArrow(_count, _COUNTS), ["lang", "shard"], "task", _sum, _COUNTS)
    parts = summed.limit(MOST_LANGUAGES * SHARDS + 1).collect()
    if len(parts) > MOST_LANGUAGES * SHARDS:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: the matrix would be too large to broadcast")
    langs = sorted({p.lang for p in parts})
    counts = np.zeros((len(langs), BUCKETS))
    docs = np.ones(len(langs))
    step = BUCKETS // SHARDS
    for p in parts:
        k = langs.index(p.lang)
        counts[k, p.shard * step : (p.shard + 1) * step] = np.frombuffer(p.counts, np.int64)
        docs[k] = p.docs
    logp = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    weights = np.zeros((BUCKETS + 1, len(langs)), np.float32)
    weights[:-1] = logp.T
    return Model(langs, weights, np.log(docs / docs.sum()))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and lang_score added (columns of those names are replaced).

    Null texts and texts without a letter are und with score 0, as is everything for a model without
    languages. Equal texts get equal results.
    """
    docs = docs.drop("lang_pred", "lang_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    column, names = docs.columns.index(text), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(column).to_pylist()
            lang, score = model.score(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score)], names)

    return docs.mapInArrow(run, schema)


def remainder(mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod


def learn(docs: DataFrame, mod: int = 4, held: int = 2) -> tuple[DataFrame, Model]:
    """docs with held_out added, and a model learnt from the rows that are not held out."""
    flagged = docs.withColumn("held_out", remainder(mod) == held)
    return flagged, train(flagged.where("not held_out"))


def identify(docs: DataFrame, mod: int = 4, held: int = 2) -> DataFrame:
    """docs with held_out, lang_pred and lang_score added (in place of columns of those names), learnt from the
    rows that are not held out. A null id counts as the empty text; rows that repeat are told alike."""
    return predict(*learn(docs, mod, held))
