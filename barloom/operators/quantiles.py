"""Exact quantiles of a column of any length, by selection between approximate ones.

A sketch, which tasks make of their rows and which merge, gives two values around each wanted rank that few
rows lie between. One pass counts the rows below, at and between them; a rank that is neither at the one nor
at the other is sought among those between, in the same way, until they are few enough to be read. No sort and
no shuffle of rows, and no state that grows with them.
"""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that are read at last, and the sketch's accuracy: ranks are off by one part in that many.
FEW, ACCURACY = 10_000, 10_000


def _select(rows: DataFrame, ranks: set[int], n: int) -> dict[int, float]:
    """The values of 0-based ranks among the n rows of v, in order."""
    if n <= FEW:
        found = sorted(r.v for r in rows.collect())  # FEW rows at most
        return {k: found[k] for k in ranks}
    out: dict[int, float] = {}
    width = 2.0
    while left := sorted(ranks - out.keys()):
        near = [min(1.0, max(0.0, (k + 0.5) / n + side * width / ACCURACY)) for k in left for side in (-1, 1)]
        edges = rows.agg(F.percentile_approx("v", near, ACCURACY)).first()[0]
        spans = sorted(set(zip(edges[::2], edges[1::2], strict=True)))
        v = F.col("v")
        counts = rows.agg(*[F.count_if(c) for a, b in spans for c in (v < a, v == a, (v > a) & (v < b), v == b)]).first()
        for i, (a, b) in enumerate(spans):
            below, at, between, top = counts[4 * i : 4 * i + 4]
            inside = {k for k in left if k not in out and below + at <= k < below + at + between}
            out |= {k: a for k in left if below <= k < below + at}
            if inside:
                found = _select(rows.where((v > a) & (v < b)), {k - below - at for k in inside}, between)
                out |= {k + below + at: x for k, x in found.items()}
            if b > a:
                out |= {k: b for k in left if below + at + between <= k < below + at + between + top}
        width *= 4
    return out


def exact_quantiles(df: DataFrame, column: Column, shares: list[float]) -> tuple[list[float | None], int]:
    """The quantiles (interpolated between neighbours) of the values that are not null or NaN, and how many there
    are; all None if there are none. df is read a few times: stage it if it is dear."""
    rows = df.select(column.cast("double").alias("v")).where("v is not null and not isnan(v)")
    n = rows.count()
    if not n:
        return [None] * len(shares), 0
    places = [q * (n - 1) for q in shares]
    at = _select(rows, {f(p) for p in places for f in (floor, ceil)}, n)
    return [at[floor(p)] if floor(p) == ceil(p) else (ceil(p) - p) * at[floor(p)] + (p - floor(p)) * at[ceil(p)] for p in places], n
