"""Near duplicates among vectors by spherical-cap filters.

A filter is a direction on the sphere; a vector belongs to all filters within a cap around it, that is whose inner product
is at least ``alpha``. The directions are a random product code: each half of the coordinates has its own short list of
random unit vectors, and every pair of them is a direction. So a vector scores two short lists and decodes the pairs whose
scores add up to enough, best first, without looking at the others. Vectors that share a filter are candidates; their
cosine in double precision decides.

A vector in few caps takes its ``least`` best directions, and so do its neighbours, whose scores are alike. In 64
dimensions a vector lies in about 30 caps and one at cosine 0.95 shares half of them. Equal vectors are merged first.

Vectors of different lengths are never compared; each length that occurs has its own directions.

Nulls and edge cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; a null
id is reported with a null component and is not kept; rows that repeat an id are separate vectors of one id; other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, written

CODES = 1220              # unit vectors per half at most: 1.5 million directions
MEAN = 30                 # caps a random vector should lie in
LEAST = 24                # caps every vector takes at least


def _codes(dim: int, codes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors for both halves, scaled so that their pairs are unit vectors. Few dimensions are not halved."""
    rng = np.random.default_rng(seed)
    if dim < 16:
        x = rng.standard_normal((codes, dim))
        return x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((1, 0))
    x, y = rng.standard_normal((codes, dim // 2)), rng.standard_normal((codes, dim - dim // 2))
    return tuple(z / np.linalg.norm(z, axis=1, keepdims=True) / np.sqrt(2) for z in (x, y))


def _scores(v: np.ndarray, codes: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    cut = codes[0].shape[1]
    return v[:, :cut] @ codes[0].T, v[:, cut:] @ codes[1].T


def fitted(dim: int, seed: int = 7) -> tuple[int, float]:
    """Codes per half and least inner product: four standard deviations of a random one, with just enough directions."""
    alpha = min(0.85, 4 / np.sqrt(dim))
    v = np.random.default_rng(seed + 1).standard_normal((100, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    codes = 8
    while codes < CODES:
        x, y = _scores(v, _codes(dim, codes, seed))
        if ((x[:, :, None] + y[:, None, :]) >= alpha).sum((1, 2)).mean() >= MEAN:
            break
        codes = min(CODES, codes * 2) if codes < 256 else CODES
    return codes, alpha


def decode(x: np.ndarray, y: np.ndarray, need: float, least: int) -> np.ndarray:
    """Pairs i * len(y) + j with x[i] + y[j] >= need, or the ``least`` best where fewer reach it."""
    i, j = np.argsort(-x, kind="stable"), np.argsort(-y, kind="stable")
    xs, ys = x[i], y[j]
    width = np.searchsorted(-ys, xs - need, "right")     # how many of ys reach need - x, for each x
    if width.sum() < least:
        # The best pairs lie in the staircase (a + 1) * (b + 1) <= least.
        a = np.arange(min(least, len(xs)))
        width = np.zeros(len(xs), np.int64)
        width[:len(a)] = np.minimum(-(-least // (a + 1)), len(ys))
    rows = np.flatnonzero(width)
    a = np.repeat(rows, width[rows])
    b = np.arange(len(a)) - np.repeat(np.cumsum(width[rows]) - width[rows], width[rows])
    total = xs[a] + ys[b]
    ok = total >= need
    if ok.sum() < least:
        ok = np.argsort(-total, kind="stable")[:least]
    return i[a[ok]] * len(y) + j[b[ok]]


def links(vectors: DataFrame, *, id: str = "vec_id", embedding: str = "embedding", cosine: float = 0.95,
          codes: int | None = None, alpha: float | None = None, least: int = LEAST, seed: int = 7) -> DataFrame:
    """Rows (id, n_links, component_id, kept), one per row of ``vectors``. Unless given, the number of directions and the
    cap follow from the dimension alone (see ``fitted``), for each length that a worker meets."""
    own = vectors.select(F.col(id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("e"))

    def directions(dim):
        n, cap = (codes, alpha) if codes is not None and alpha is not None else fitted(dim, seed)
        return _codes(dim, n, seed), cap

    def unit(batches):
        for b in batches:
            out = []
            for e in b["e"]:
                v = None if e is None else np.asarray(e, np.float64)
                if v is None or not len(v) or not np.isfinite(v).all() or not v.any():
                    out.append(None)
                    continue
                v = v / np.abs(v).max()                   # no overflow of the squares
                out.append((v / np.sqrt(v @ v)).tobytes())
            yield pd.DataFrame({"id": b["id"], "v": out})

    rows = written(own.mapInPandas(unit, "id long, v binary"), "units")
    # A class is one vector, its length included, with the ids that carry it; ids number the classes.
    classes = written(rows.where("v is not null").groupBy("v").agg(F.min("id").alias("cid"), F.count("*").alias("n"))
                      .where("cid is not null").withColumn("rep", F.xxhash64("v")), "classes")

    def filters(batches):
        of = lru_cache(8)(directions)
        for b in batches:
            for n, own in b.groupby(b["v"].map(len)):
                dim = int(n) // 8
                code, cap = of(dim)
                v = np.frombuffer(b"".join(own["v"]), np.float64).reshape(-1, dim)
                xs, ys = _scores(v, code)
                found = [decode(x, y, cap, least) for x, y in zip(xs, ys, strict=True)]
                size = [len(f) for f in found]
                f = np.concatenate([np.empty(0, np.int64), *found]) + (dim << 40)      # caps of one length only
                yield pd.DataFrame({"rep": np.repeat(own["rep"].to_numpy(), size), "f": f})

    caps = written(classes.select("rep", "v").mapInPandas(filters, "rep long, f long"), "caps")
    pairs = (caps.alias("x").join(caps.alias("y"), "f").where("x.rep < y.rep")
             .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct())

    def verify(batches):
        for b in batches:
            for n, own in b.groupby(b["va"].map(len)):
                x, y = (np.frombuffer(b"".join(own[c]), np.float64).reshape(-1, int(n) // 8) for c in ("va", "vb"))
                yield own[["a", "b"]][np.einsum("ij,ij->i", x, y) >= cosine]

    unit_of = classes.select("rep", "v")
    near = written(pairs.join(unit_of.toDF("a", "va"), "a").join(unit_of.toDF("b", "vb"), "b")
                   .mapInPandas(verify, "a long, b long"), "near")
    both = near.unionAll(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = (both.join(classes.select(F.col("rep").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("others")))
    reach = components(near)
    roots = (classes.join(reach, F.col("rep") == F.col("id"), "left").select("rep", "cid", F.coalesce("component", "rep").alias("root")))
    lowest = roots.groupBy("root").agg(F.min("cid").alias("component_id"))
    told = (classes.select("v", "rep", "n").join(roots.select("rep", "root"), "rep").join(lowest, "root")
            .join(linked.withColumnRenamed("a", "rep"), "rep", "left")
            .select("v", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"))
    return (rows.join(told, "v", "left")
            .select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(False))))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY 1),
deg AS (SELECT a, count(*) AS n FROM near GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low.b, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(low.b, vec_id)) AS kept
FROM embeddings LEFT JOIN low ON low.a = vec_id LEFT JOIN deg ON deg.a = vec_id
"""
