"""SentencePiece encoding and decoding through a table of distinct chunks.

When no piece has a non-marker before a whitespace marker, no merge crosses the start of a marker run, so
a text's ids are its marked words' ids one after another. Each task keeps a table of distinct marked words
with their ids, segments every new word once with the library, and joins the ids back by position in numpy;
the library then decodes the joined ids. A model without that property is run on whole texts instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.text import pieces

MARK = "▁"
#: Distinct words that a task's table holds before it starts anew, and the longest word it holds.
TABLE_WORDS = 150_000
LONGEST_WORD = 48
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


class Codec:
    """encode() and decode() of one model for batches of texts."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.chunked = self._separable()
        self._new()

    def _separable(self) -> bool:
        sp = self.sp
        if any(re.search(f"[^{MARK}]{MARK}", sp.id_to_piece(i)) for i in range(sp.get_piece_size())):
            return False
        probe = "  a\t① ﬁ  b\n "  # markers kept, one put before, nothing normalised
        return sp.decode(sp.encode(probe)) == probe and sp.id_to_piece(sp.encode("a")[0]).startswith(MARK)

    def _new(self) -> None:
        self.slots: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)

    def _segment(self, chunks: list[str]) -> list[list[int]]:
        """The ids of marked words: the library puts a word's first marker before it by itself."""
        ids = self.sp.encode([c[1:] for c in chunks], num_threads=1)
        for i, c in enumerate(chunks):
            if c == MARK:
                ids[i] = [self.sp.piece_to_id(MARK)]
        return ids

    def _learn(self, chunks: list[str]) -> None:
        """Put new words into the table."""
        ids = self._segment(chunks)
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        self.slots.update(zip(chunks, range(len(self.first), len(self.first) + len(chunks)), strict=True))
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(count.sum()))])

    def run(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """All ids of all texts, the n+1 offsets of the texts in them, and the decoded texts."""
        if not self.chunked:
            ids = self.sp.encode(texts, num_threads=1)
            offs = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])
            return np.array([i for x in ids for i in x], np.int32), offs, [self.sp.decode(x) for x in ids]
        if len(self.slots) > TABLE_WORDS:
            self._new()
        lists = [_CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if new := list({*chain.from_iterable(lists)}.difference(self.slots)):
            self._learn(new)
        per = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))])
        place = np.fromiter(map(self.slots.__getitem__, chain.from_iterable(lists)), np.int64, int(per[-1]))
        size = self.count[place]
        ends = np.cumsum(size)
        at = np.repeat(self.first[place] - (ends - size), size) + np.arange(size.sum())
        offs = np.concatenate([[0], ends])[per]
        ids = self.flat[at]
        for c in new:  # long words are rare: they do not stay
            if len(c) > LONGEST_WORD:
                del self.slots[c]
        spans = zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)
        decoded = self.sp.decode([ids[i:j] for i, j in spans], num_threads=1) if texts else []
        return ids, offs, decoded


def encode(docs: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """docs with piece_ids (array of int) and decoded (string) added; columns of those names are replaced.

    Null and empty texts have no ids and decode to the empty text. No begin or end ids, no sampling. The
    model file is read where the tasks run. Works on any number of rows, none included.
    """
    docs = docs.drop("piece_ids", "decoded")
    schema = T.StructType([*docs.schema.fields, T.StructField("piece_ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("decoded", T.StringType(), False)])
    column, names = docs.columns.index(text), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model_file)
        for batch in batches:
            # an array's 32-bit offsets hold any piece: it has a few times PIECE elements, or one document
            texts = batch.column(column).to_pylist()
            size = np.concatenate([[0], np.cumsum([len(t or "") for t in texts], dtype=np.int64)])
            for i, j in pieces(size):
                ids, offs, decoded = codec.run([t or "" for t in texts[i:j]])
                part = batch.slice(i, j - i)
                lists = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(decoded, pa.string())], names)

    return docs.mapInArrow(run, schema)


def digest(encoded: DataFrame) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 in place of the ids and the decoded text."""
    return encoded.withColumn("n_tokens", F.size("piece_ids").cast("long")).withColumn("ids_sha256", F.sha2(F.array_join(F.col("piece_ids").cast("array<string>"), ",").cast("binary"), 256)).withColumn("decoded_sha256", F.sha2(F.col("decoded").cast("binary"), 256)).drop("piece_ids", "decoded")
