"""Near-duplicate vectors: int8 tile products with rigorous error bounds, then full precision where needed.

Equal vectors of a label are one class. The classes of a label are dealt into tiles of bounded size; every
pair of tiles of a label is one task's product of int8 codes (in float32, where such sums are exact). With
u = s*q + e for a unit vector u, codes q and scale s, the true cosine of u and v differs from
s*t*(q . r) by at most |e| * (1 + |f|) + |f|, so only pairs above the threshold by that bound are computed
again in double precision. A task returns link counts and a spanning forest of its links, at most two rows
a vector, however many links there are.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.components import connected_components
from barloom.llm.scratch import stage

#: Vectors in a tile, on average, and rows of it that are multiplied at once.
TILE = 2048
STRIP = 512
TINY = 1e-9
#: Distinct vectors that are broadcast to their rows, at most, and the rows that such a one has at least.
LARGEST, LEAST_ROWS = 10_000, 16


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of x, as units: int8 codes, scales, norms of what the codes lack (rounded up), and the units."""
    top = np.abs(x).max(axis=1, keepdims=True)
    y = x / top  # squares neither overflow nor vanish
    unit = y / np.sqrt((y * y).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    lack = np.sqrt(((unit - scale[:, None] * codes) ** 2).sum(axis=1)) * (1 + 1e-9) + TINY
    return codes, scale, lack, unit


def linked_pairs(x: np.ndarray, y: np.ndarray | None, threshold: float):
    """Index pairs (i, j) of rows of x and y (of x alone, i < j, if y is None) with cosine >= threshold."""
    a, s, e, u = quantise(x)
    b, t, f, v = (a, s, e, u) if y is None else quantise(y)
    wide = np.ascontiguousarray(b.astype(np.float32).T)
    exact = a.shape[1] * 127 * 127 < 1 << 24
    if not exact:
        wide = wide.astype(np.float64)
    for k in range(0, len(a), STRIP):
        part = slice(k, min(k + STRIP, len(a)))
        about = (a[part].astype(wide.dtype) @ wide) * s[part, None] * t[None, :]
        bound = e[part, None] * (1 + f[None, :]) + f[None, :]
        i, j = np.nonzero(about + bound >= threshold)
        i = i + k
        if y is None:
            i, j = i[i < j], j[i < j]
        for m in range(0, len(i), 1 << 16):
            p, q = i[m : m + (1 << 16)], j[m : m + (1 << 16)]
            cosine = np.einsum("ij,ij->i", u[p], v[q])
            # the plain formula decides what is within rounding of the threshold
            for z in np.flatnonzero(np.abs(cosine - threshold) < TINY):
                g, h = x[p[z]], (x if y is None else y)[q[z]]
                cosine[z] = float(g @ h) / math.sqrt(float(g @ g) * float(h @ h)) if 0 < float(g @ g) * float(h @ h) < math.inf else cosine[z]
            hit = cosine >= threshold
            yield p[hit], q[hit]


def _forest(root: np.ndarray, p: np.ndarray, q: np.ndarray, out: list[tuple[int, int]]) -> None:
    """Adds the links (p, q) to a union-find and those that joined two trees to out."""
    for i, j in zip(p.tolist(), q.tolist(), strict=True):
        x, y = i, j
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        while root[y] != y:
            root[y] = root[root[y]]
            y = root[y]
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((i, j))


def _multiply(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in pdf.itertuples():
            ids = np.asarray(row.ids, np.int64)
            count = np.asarray(row.counts, np.int64)
            x = np.array([np.asarray(r, np.float64) for r in row.vectors])
            same = row.tile == row.tile_b
            if same:
                y, ids_b, count_b = None, ids, count
            else:
                y, ids_b, count_b = np.array([np.asarray(r, np.float64) for r in row.vectors_b]), np.asarray(row.ids_b, np.int64), np.asarray(row.counts_b, np.int64)
            all_ids = ids if same else np.concatenate([ids, ids_b])
            shift = 0 if same else len(ids)
            links = np.zeros(len(all_ids), np.int64)
            root, forest = np.arange(len(all_ids)), []
            for p, q in linked_pairs(x, y, threshold):
                np.add.at(links, p, count_b[q])
                np.add.at(links, q + shift, count[p])
                _forest(root, p, q + shift, forest)
            has = np.flatnonzero(links)
            out.append(pd.DataFrame({"a": all_ids[has], "b": all_ids[has], "links": links[has]}))
            if forest:
                f = np.array(forest)
                out.append(pd.DataFrame({"a": all_ids[f[:, 0]], "b": all_ids[f[:, 1]], "links": 0}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "links": []}, dtype="int64")

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.8, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """One row for each row of vectors: vec_id, n_links, component_id, kept.

    Two vectors are linked when their labels are equal and not null, their lengths are equal and their cosine
    in double precision is threshold or more. Null, empty and zero vectors, and those with a null, NaN or
    infinite component, are linked with nothing. Equal vectors of a label are linked with each other and
    counted. component_id is the smallest vec_id reachable; the vector with that id is kept. Every row is a
    vector of its own in n_links, even one that repeats an id; a null id is linked with nothing and kept.
    An empty table gives no rows.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v"), F.col(label).alias("label"))
    good = F.expr("vec_id is not null and label is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    rows = stage(rows.withColumn("good", F.coalesce(good, F.lit(False))), "vectors")
    classes = stage(rows.where("good").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumn("dim", F.size("v")), "classes")
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("size")).withColumn("tiles", F.ceil(F.col("size") / TILE).cast("int"))
    dealt = classes.join(sizes, ["label", "dim"]).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    tiles = stage(dealt.groupBy("label", "dim", "tile", "tiles").agg(F.collect_list(F.struct("rep", "n", "v")).alias("m")).select("label", "dim", "tile", "tiles", F.col("m.rep").alias("ids"), F.col("m.n").alias("counts"), F.col("m.v").alias("vectors")), "tiles")
    # each tile goes to the pairs (i, j), i <= j, that it is part of
    pairs = tiles.select("label", "dim", "tile", "tiles").withColumn("tile_b", F.explode(F.expr("sequence(tile, tiles - 1)"))).drop("tiles")
    other = tiles.select("label", "dim", F.col("tile").alias("tile_b"), F.col("ids").alias("ids_b"), F.col("counts").alias("counts_b"), F.col("vectors").alias("vectors_b"))
    none = F.col("tile") == F.col("tile_b")
    both = pairs.join(tiles.drop("tiles"), ["label", "dim", "tile"]).join(other, ["label", "dim", "tile_b"])
    both = both.select("tile", "tile_b", "ids", "counts", "vectors", *[F.when(~none, F.col(c)).alias(c) for c in ("ids_b", "counts_b", "vectors_b")], F.xxhash64("label", "dim", "tile", "tile_b").alias("pair"))
    made = stage(both.groupBy("pair").applyInPandas(_multiply(threshold), "a long, b long, links long"), "products")
    found = connected_components(made.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")))
    links = made.where("a = b").groupBy("a").agg(F.sum("links").alias("links"))
    info = classes.join(links.withColumnRenamed("a", "rep"), "rep", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    info = stage(info.select("label", "v", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "told")
    # vectors that very many rows share are told by broadcast (fewer than LARGEST, as their counts add up to all)
    large = max(LEAST_ROWS, info.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // LARGEST)
    hot = F.broadcast(info.where(F.col("n") > large).drop("n"))
    told = rows.where("good").join(hot, ["label", "v"], "left")
    cold = told.where("component_id is null").select("vec_id", "label", "v").join(info.where(F.col("n") <= large).drop("n"), ["label", "v"])
    linked = told.where("component_id is not null").unionByName(cold, allowMissingColumns=True).select("vec_id", "n_links", "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
