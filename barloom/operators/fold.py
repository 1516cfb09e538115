"""Ordered folds: what must see a key's rows one after another, in bounded memory.

Rows are dealt by key, sorted within the partitions, and streamed to Python in batches. A fold gets its
key's rows as an iterator of pieces and keeps only its own state, so a key with very many rows takes time
but no memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barloom.session import ship

Fold = Callable[[tuple, Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Stretches of rows with one key; a key's stretches follow each other."""
    for pdf in batches:
        if not len(pdf):
            continue
        new = np.zeros(len(pdf), bool)
        new[0] = True
        for k in keys:
            code, _ = pd.factorize(pdf[k])  # -1 for nulls
            new[1:] |= code[1:] != code[:-1]
        cuts = [*np.flatnonzero(new).tolist(), len(pdf)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            first = (pdf[k].iloc[a] for k in keys)
            yield tuple(None if pd.isna(v) else v for v in first), pdf.iloc[a:b]


def each_key(fold: Fold, keys: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A function for mapInPandas that runs the fold on each key of sorted rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source = _runs(batches, keys)
        ahead = next(source, None)
        while ahead is not None:
            key = ahead[0]

            def pieces() -> Iterator[pd.DataFrame]:
                nonlocal ahead
                while ahead is not None and ahead[0] == key:  # noqa: B023
                    piece = ahead[1]
                    ahead = next(source, None)
                    yield piece

            own = pieces()
            yield from fold(key, own)
            for _ in own:  # whatever the fold has left
                pass

    return run


def fold_sorted(df: DataFrame, keys: list[str], order: list[str], fold: Fold, schema: T.StructType | str) -> DataFrame:
    """The rows that a fold makes of each key's rows in order."""
    ship(df.sparkSession)
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(each_key(fold, keys), schema)
