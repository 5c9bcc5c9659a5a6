"""Hard negatives by exact search in a multiway hyperplane tree with distance ranges.

Rows are integer vectors with a label; a row's score for an anchor is their inner product. One more coordinate lifts all rows of a
length onto a sphere, where a window of scores around an anchor is an annulus of distances. A crowded node chooses up to ``WAYS``
split points from a bounded sample of its own rows, far from each other; every row goes to the nearest (hyperplanes between
the points), and the node stores, for each split point and each sibling subtree, the least and largest distance between them.
Nodes are split until their rows are few, level by level for all crowded nodes at once.

A search goes down level by level. At a node the triangle inequality bounds how far a row in the annulus may be from each split
point; a sibling whose stored range misses that bound is eliminated. In the leaves that remain all scores are computed, so results
are exact. The searcher's own leaf goes first: what it finds narrows the annulus for all others. Positives are searched
first, their scores then give the windows of the negatives.

Rows equal in label and vector are one entry with its smallest ids, as many as a result can use. Nodes and leaves meet searchers
in blocks of bounded size; a node that no split point divides stays a leaf, cut into blocks.

Nulls and edge cases: rows with a null id, label or vector, an empty vector or null components take no part, nor do vectors whose squared length reaches
2**62 (no long holds their scores); vectors of different lengths do not meet; rows that repeat an id, label and vector are one row; rows that
share the anchor's id are neither its positives nor its negatives; an id with several vectors is as many anchors; other columns are
ignored. An empty table, or no anchors, gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .blocks import first, matrix, paired
from .common import written

WAYS = 16                 # split points of a node at most
OFFERED = 64              # rows of a node from which they are chosen
LEAF = 4096               # entries above which a node is split
DEPTH = 12
FAR = 1 << 62
EXACT = 1 << 53           # sums up to here are exact in double
SLACK = 1e-6              # relative error allowed to distances computed in double

SEARCH = "s long, anchor_id long, other_id long, label long, v array<bigint>, low long, high long, node string"
NAMES = [c.split()[0] for c in SEARCH.split(", ")]


def inner(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All inner products of two sets of integer rows, exactly."""
    longest = (np.square(x.astype(np.float64)).sum(1).max(initial=0) * np.square(y.astype(np.float64)).sum(1).max(initial=0)) ** 0.5
    if longest < EXACT:
        return np.rint(x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x @ y.T


def _lift(v: np.ndarray, top: float) -> np.ndarray:
    """Rows with the coordinate that puts them on the sphere of squared radius ``top``."""
    v = v.astype(np.float64)
    return np.column_stack([v, np.sqrt(np.maximum(top - (v * v).sum(1), 0))])


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances from rows of x to rows of y, from their differences (no cancellation)."""
    out = np.empty((len(x), len(y)))
    for j, p in enumerate(y):
        out[:, j] = np.sqrt(np.square(x - p).sum(1))
    return out


def _apart(v: np.ndarray, ways: int) -> list[int]:
    """Rows far from each other: each next one farthest from those chosen; equal rows are not chosen twice."""
    chosen = [0]
    gap = np.sqrt(np.square(v - v[0]).sum(1))
    while len(chosen) < ways and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.sqrt(np.square(v - v[chosen[-1]]).sum(1)))
    return chosen


class Tree:
    """Entries with their leaf (``node``), and per inner node its split points with the ranges of its subtrees."""

    def __init__(self, entries: DataFrame, *, ways: int = WAYS, leaf: int = LEAF):
        """``entries``: rows (c, label, v, ids)."""
        self.tops = {int(d): float(t) for d, t in entries.groupBy(F.size("v").alias("d"))
                     .agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("t")).collect()}
        self.levels: list[DataFrame] = []
        rows = entries.withColumn("node", F.size("v").cast("string"))
        done = []
        for _ in range(DEPTH):
            crowded = written(rows.groupBy("node").count().where(f"count > {leaf}").select("node"), "crowded")
            if crowded.isEmpty():
                break
            done.append(rows.join(crowded, "node", "left_anti"))
            rows, level, stuck = self._split(rows.join(crowded, "node"), ways)
            done.append(stuck)
            self.levels.append(level)
        done.append(rows)
        all_ = done[0]
        for d in done[1:]:
            all_ = all_.unionByName(d)
        self.rows = written(all_, "leaves")

    def _split(self, rows: DataFrame, ways: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        tops = self.tops
        offer = (rows.select("node", "v", F.xxhash64("c").alias("h"), "c")
                 .withColumn("r", F.row_number().over(W.partitionBy("node").orderBy("h", "c"))).where(f"r <= {OFFERED}"))

        def choose(key, b):
            b = b.sort_values("r")
            v = matrix(b["v"])
            at = _apart(v.astype(np.float64), ways)
            return pd.DataFrame({"node": key[0], "i": np.arange(len(at)), "p": list(v[at])})

        points = written(offer.groupBy("node").applyInPandas(choose, "node string, i int, p array<bigint>"), "points")

        def assign(points, b):
            if not len(b) or not len(points):
                return pd.DataFrame(columns=["c", "label", "v", "ids", "parent", "i", "d"])
            points = points.sort_values("i")
            v = matrix(b["v"])
            top = tops[v.shape[1]]
            d = _distances(_lift(v, top), _lift(matrix(points["p"]), top))
            return b[["c", "label", "v", "ids"]].assign(parent=b["node"], i=d.argmin(1), d=list(d))

        sent = written(paired(points, rows, "node", "node", "c").applyInPandas(
            assign, "c long, label long, v array<bigint>, ids array<long>, parent string, i int, d array<double>"), "sent")
        bounds = [f(F.get("d", F.lit(k))).alias(f"{name}{k}") for k in range(ways) for name, f in (("a", F.min), ("b", F.max))]
        ranges = (sent.groupBy("parent", "i").agg(F.count("*").alias("n"), *bounds)
                  .select(F.col("parent").alias("node"), "i", "n", F.array(*[f"a{k}" for k in range(ways)]).alias("least"),
                          F.array(*[f"b{k}" for k in range(ways)]).alias("most")))
        level = written(points.join(ranges, ["node", "i"], "left"), "level")
        # A node all of whose rows went one way is not split again: its child keeps them as a leaf, cut into blocks.
        alone = level.where("n is not null").groupBy("node").count().where("count = 1").select(F.col("node").alias("parent"))
        child = sent.withColumn("node", F.concat("parent", F.lit("."), "i"))
        kept = child.join(alone, "parent", "left_anti").select("c", "label", "v", "ids", "node")
        return written(kept, "entries"), level, written(child.join(alone, "parent").select("c", "label", "v", "ids", "node"), "stuck")

    def route(self, asked: DataFrame) -> DataFrame:
        """Searchers (SEARCH columns but node) once per leaf that may hold rows of their window."""
        tops = self.tops
        now = asked.withColumn("node", F.size("v").cast("string"))

        def eliminate(left, level):
            if not len(left) or not len(level):
                return left[NAMES]
            level = level.sort_values("i")
            v = matrix(left["v"]).astype(np.float64)
            top = tops[v.shape[1]]
            d = _distances(np.column_stack([v, np.zeros(len(v))]), _lift(matrix(level["p"]), top))
            square = (v * v).sum(1) + top
            near, far = (np.sqrt(np.maximum(square - 2.0 * left[c].to_numpy().astype(np.float64), 0)) for c in ("high", "low"))
            slack = SLACK * (1 + np.sqrt(square))[:, None]
            nearest = np.maximum(d - far[:, None], near[:, None] - d) - slack
            farthest = d + far[:, None] + slack
            out = [left[NAMES].iloc[:0]]
            for i, n, least, most in zip(level["i"], level["n"], level["least"], level["most"], strict=True):
                if not n > 0:
                    continue
                least, most = (np.array(list(x)[:len(level)], np.float64) for x in (least, most))
                open_ = ((least <= farthest) & (most >= nearest)).all(1)
                went = left.loc[open_, NAMES]
                out.append(went.assign(node=went["node"] + f".{i}"))
            return pd.concat(out)

        for level in self.levels:
            inner_ = level.select("node").distinct()
            here = now.join(inner_, "node")
            rest = now.join(inner_, "node", "left_anti")
            went = paired(here, level, "node", "s", "node").applyInPandas(eliminate, SEARCH)
            now = written(rest.unionByName(went.select(*rest.columns)), "routed")
        return now

    def visit(self, asked: DataFrame, same: bool, k: int) -> DataFrame:
        """Best k rows (s, anchor_id, other_id, id, score, c) in each searcher's leaf: score in its window, of its label or of another."""
        def look(left, rows):
            names = ["s", "anchor_id", "other_id", "id", "score", "c"]
            if not len(left) or not len(rows):
                return pd.DataFrame(columns=names)
            score = inner(matrix(left["v"]), matrix(rows["v"]))
            of, own = rows["label"].to_numpy(), left["label"].to_numpy()
            ids, low, high, anchor = list(rows["ids"]), left["low"].to_numpy(), left["high"].to_numpy(), left["anchor_id"].to_numpy()
            lowest, second = (np.array([z[n] if len(z) > n else FAR for z in ids], np.int64) for n in (0, 1))
            alone = np.array([len(z) == 1 for z in ids])
            out = []
            for q in range(len(left)):
                row, own_id = score[q], lowest == anchor[q]
                at = np.flatnonzero(((of == own[q]) == same) & (row >= low[q]) & (row <= high[q]) & ~(own_id & alone))
                if len(at) > k:
                    least = np.partition(row[at], len(at) - k)[len(at) - k]
                    at = at[row[at] >= least]
                at = at[np.lexsort((np.where(own_id, second, lowest)[at], -row[at]))][:k]
                hits = sorted((-int(row[a]), int(x), a) for a in at for x in ids[a] if x != anchor[q])[:k]
                out += [(q, x, -s, a) for s, x, a in hits]
            q, x, s, a = (np.array(z, np.int64) for z in (zip(*out, strict=True) if out else ((), (), (), ())))
            return pd.DataFrame({"s": left["s"].to_numpy()[q], "anchor_id": anchor[q], "other_id": left["other_id"].to_numpy()[q],
                                 "id": x, "score": s, "c": rows["c"].to_numpy()[a]})[names]

        return paired(asked, self.rows, "node", "s", "c").applyInPandas(
            look, "s long, anchor_id long, other_id long, id long, score long, c long")

    def search(self, asked: DataFrame, home: DataFrame, same: bool, k: int) -> DataFrame:
        """Exactly the best k of each searcher. ``home``: rows (s, node), the leaf each searcher is looked up in first."""
        best = W.partitionBy("s").orderBy(F.desc("score"), "id", "c")
        begun = asked.join(home, "s")
        seed = written(self.visit(begun, same, k), "seed")
        bound = seed.groupBy("s").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(f"n >= {k}").select("s", "least")
        closer = asked.join(bound, "s", "left").withColumn("low", F.coalesce("least", "low")).drop("least")
        routed = self.route(written(closer, "closer")).join(home, ["s", "node"], "left_anti")
        found = seed.unionByName(self.visit(routed, same, k))
        return found.withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}")


def hard_negatives(rows: DataFrame, anchors: DataFrame, *, id: str = "vec_id", vector: str = "vector", label: str = "label", positives: int = 5,
                   negatives: int = 10, low: int = 30, high: int = 90, ways: int = WAYS, leaf: int = LEAF) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` holds integer vectors (array of long) with labels, ``anchors`` the ids that are anchors. An anchor's positives are its
    first ``positives`` other rows of the same label, by score, then id; each positive's negatives are the first ``negatives`` rows of
    other labels with low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    own = rows.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"),
                      F.col(f"`{vector}`").cast("array<bigint>").alias("v"))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    own = own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull())).where(length < float(FAR)).distinct()
    keep = max(positives, negatives) + 1
    few = (own.withColumn("r", F.row_number().over(W.partitionBy("v", "label").orderBy("id"))).where(f"r <= {keep}")
           .groupBy("v", "label").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    entries = written(few.withColumn("c", F.monotonically_increasing_id()), "entries")
    tree = Tree(entries.select("c", "label", "v", "ids"), ways=ways, leaf=leaf)

    chosen = own.join(anchors.select(F.col(f"`{id}`").cast("long").alias("id")).distinct(), "id", "left_semi")
    asked = written(chosen.join(entries.select("v", "label", "c"), ["v", "label"]).select(F.col("id").alias("anchor_id"), "label", "v", "c")
                    .withColumn("s", F.monotonically_increasing_id()), "anchors")
    home = written(asked.select("s", "c").join(tree.rows.select("c", "node"), "c").select("s", "node"), "home")
    near = written(tree.search(asked.select("s", "anchor_id", F.lit(0).cast("long").alias("other_id"), "label", "v",
                                            F.lit(-FAR).alias("low"), F.lit(FAR).alias("high")), home, True, positives), "positives")
    # Whole scores in the window: from the ceiling of low percent to the floor of high percent; a negative score has none.
    whole = F.col("positive_score").cast("decimal(20,0)")
    windows = (near.select("s", F.col("id").alias("other_id"), F.col("score").alias("positive_score"))
               .withColumn("low", F.ceil(whole * low / 100).cast("long")).withColumn("high", F.floor(whole * high / 100).cast("long")).where("low <= high"))
    asking = written(windows.join(asked.select("s", "anchor_id", "label", "v"), "s").withColumnRenamed("s", "a")
                     .withColumn("s", F.monotonically_increasing_id()), "windows")
    start = written(asking.select("s", "a").join(home.withColumnRenamed("s", "a"), "a").select("s", "node"), "starts")
    far = tree.search(asking.select("s", "anchor_id", "other_id", "label", "v", "low", "high"), start, False, negatives)
    return (far.join(asking.select("s", "positive_score"), "s")
            .select("anchor_id", F.col("other_id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))


SQL = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id AND len(a.e) = len(b.e)),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank, s.b AS negative_id,
    p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 100 * s.score BETWEEN 30 * p.score AND 90 * p.score)
SELECT * FROM n WHERE rank <= 10
"""
