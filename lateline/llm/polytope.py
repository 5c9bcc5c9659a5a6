"""Approximate nearest neighbours by cross-polytope hashing.

A table rotates unit vectors pseudo-randomly (three rounds of random signs and a fast Hadamard transform) and assigns each to the
nearest signed axis, that is the largest coordinate in size, with its sign. Where an average bucket would hold more than ``bucket``
vectors, several such rotations in a row are weighed. A query probes, in every table, the signed axes nearest to itself, best first;
the vectors of all probed buckets are its candidates, and the cosine of the original vectors in double precision ranks them.

The number of probes is fitted: on a sample of at most ``SAMPLE`` vectors, the fewest with which ``PROBED`` of them find ``recall``
of their neighbours. Another rotation makes buckets finer and candidates fewer, but vectors without near neighbours need thousands
of its probes; the rotations with the least work for that recall are taken (``planned``). The sample is the one thing fitted; every
vector is indexed. Neighbours in the whole table are nearer than those in the sample, so its recall is the lower one. Equal vectors
are one entry with its k + 1 smallest ids: no query can need more of them. Equal query vectors are searched once.

Memory and disk: a vector is kept once with its bucket in every table, a query once per table with the list of its probes; tables
are searched one after the other, each with one shuffle, whose files go before the next. Buckets and their queries meet in blocks of
bounded size (``blocks.paired``), which workers compare in smaller ones.

Nulls and edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids; vectors
of different lengths are never compared; rows that repeat an id and its vector are one row; an id with several vectors is as many
rows, each a candidate of the others and, where it is queried, each with its own ranks; other columns are ignored. An empty
table, or no queries, gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .blocks import first, matrix, paired, sized, usable
from .common import written

TABLES = 4
BUCKET = 4096             # vectors an average bucket may hold before one more rotation of a table is weighed
SAMPLE, PROBED = 4096, 256
PROBE, GROUP = 512, 1 << 19                # what a probe (a query sent to a bucket) and a bucket cost, in candidates compared
MOST = 1 << 14            # probes a table that several rotations may need to be weighed
ASKED, INDEXED = 1 << 19, 1 << 20          # numbers in a block of queries, of rows
AT_ONCE = 1 << 20         # numbers a worker computes at a time
CLOSE = 1e-9              # two ways of computing a cosine differ by less
NUMPY = {"float": np.float32, "double": np.float64}


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (unscaled); the length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x


class Polytopes:
    """Tables of ``turns`` rotations each, for vectors of one length."""

    def __init__(self, dim: int, tables: int, turns: int, seed: int):
        self.width = max(2, 1 << (dim - 1).bit_length())
        self.dim, self.tables, self.turns = dim, tables, turns
        self.signs = np.random.default_rng([seed, dim]).choice([-1.0, 1.0], (tables, turns, 3, self.width))

    def turned(self, unit: np.ndarray, table: int) -> np.ndarray:
        """Coordinates after each rotation of a table: (rows, turns, width)."""
        x = np.zeros((len(unit), self.width))
        x[:, :self.dim] = unit
        out = np.empty((len(unit), self.turns, self.width))
        for turn in range(self.turns):
            y = x
            for sign in self.signs[table, turn]:
                y = hadamard(y * sign) / np.sqrt(self.width)
            out[:, turn] = y
        return out

    def buckets(self, unit: np.ndarray, table: int) -> np.ndarray:
        y = self.turned(unit, table)
        axis = np.abs(y).argmax(2)
        signed = 2 * axis + (np.take_along_axis(y, axis[:, :, None], 2)[:, :, 0] < 0)
        return signed @ (2 * self.width) ** np.arange(self.turns - 1, -1, -1)

    def probes(self, unit: np.ndarray, table: int, count: int) -> np.ndarray:
        """The ``count`` buckets whose signed axes have the largest sum of coordinates, best first: (rows, count)."""
        sides = 2 * self.width
        # Of two lists in order of size, the sum of places a and b (from 1) is exceeded by no fewer than a * b - 1 others.
        sums = [np.nonzero(np.outer(np.arange(1, min(count, sides ** turn) + 1), np.arange(1, min(count, sides) + 1)) <= count)
                for turn in range(self.turns)]
        step = max(1, AT_ONCE // max(sides * self.turns, *(len(a) for a, _ in sums)))
        return np.concatenate([self._probes(unit[at:at + step], table, count, sums) for at in range(0, max(1, len(unit)), step)])

    def _probes(self, unit: np.ndarray, table: int, count: int, sums: list) -> np.ndarray:
        y = self.turned(unit, table)
        near = np.stack([y, -y], 3).reshape(len(unit), self.turns, -1)      # axis a: 2a with its sign, 2a + 1 against it
        code, score = np.zeros((len(unit), 1), np.int64), np.zeros((len(unit), 1))
        for turn, (a, b) in enumerate(sums):
            order = np.argsort(-near[:, turn], axis=1, kind="stable")[:, :count]
            total = score[:, a] + np.take_along_axis(near[:, turn], order, 1)[:, b]
            best = np.argsort(-total, axis=1, kind="stable")[:, :count]
            code, score = np.take_along_axis(code[:, a] * 2 * self.width + order[:, b], best, 1), np.take_along_axis(total, best, 1)
        return code


def scaled(vectors) -> np.ndarray:
    """Rows of doubles, each times a power of two that keeps its squares in range; cosines stay what they are."""
    v = matrix(vectors).astype(np.float64)
    return np.ldexp(v, -np.frexp(np.abs(v).max(1))[1][:, None])


def normed(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(1))[:, None]


def fitted(sample: np.ndarray, tables: int, turns: int, k: int, recall: float, seed: int, most: int | None = None) -> tuple[int, float] | None:
    """Fewest probes a table with which vectors of the sample find ``recall`` of their k nearest in it, and the share of the
    other vectors these probes meet; None where more than ``most`` are needed."""
    poly = Polytopes(sample.shape[1], tables, turns, seed)
    whole = (2 * poly.width) ** turns
    most = whole if most is None else min(whole, most)
    asked = sample[:PROBED]
    s = asked @ sample.T
    s[np.arange(len(asked)), np.arange(len(asked))] = -2
    near = np.argsort(-s, axis=1, kind="stable")[:, :min(k, len(sample) - 1)]
    place, met = np.full(near.shape, whole), np.zeros((len(asked), most), np.int64)
    for t in range(tables):
        homes, probes = poly.buckets(sample, t), poly.probes(asked, t, most)
        for i in range(near.shape[1]):
            hit = probes == homes[near[:, i]][:, None]
            place[:, i] = np.minimum(place[:, i], np.where(hit.any(1), hit.argmax(1), whole))
        code, n = np.unique(homes, return_counts=True)
        at = np.minimum(np.searchsorted(code, probes), len(code) - 1)
        met += np.where(code[at] == probes, n[at], 0)
    count = 1
    while count < whole and near.size and (place < count).mean() < recall:
        count = min(whole, max(count + 1, count * 5 // 4))
    if count > most:
        return None
    return count, (met[:, :count].sum(1).mean() / tables - 1) / max(1, len(sample) - 1)


def planned(sample: np.ndarray, n: int, asked: int, tables: int, bucket: int, k: int, recall: float, seed: int) -> tuple[int, int]:
    """Rotations a table and probes a query for ``asked`` queries of ``n`` vectors: those with which ``recall`` takes the least work,
    counted in candidates compared. Without near neighbours the probes of two rotations would be more work than all vectors."""
    sides, turns, best = 2 * max(2, 1 << (sample.shape[1] - 1).bit_length()), 1, None
    while True:
        most = None if best is None else min(MOST, int(best[0] / (asked * PROBE)))
        fit = fitted(sample, tables, turns, k, recall, seed, most) if most != 0 else None
        if fit is not None:
            count, share = fit
            work = asked * (count * PROBE + share * n) + min(sides ** turns, asked * count) * GROUP
            best = min(best or (work, turns, count), (work, turns, count))
        if sides ** turns * bucket >= n or sides ** (turns + 1) >= 1 << 36:
            return best[1:]
        turns += 1


def nearest(vectors: DataFrame, queries: DataFrame, *, id: str = "vec_id", embedding: str = "embedding", k: int = 5, tables: int = TABLES,
            bucket: int = BUCKET, recall: float = 0.975, seed: int = 11) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest candidates found for each row of ``queries`` among ``vectors``, nearest
    first, ties to the smaller id. A query's own row, where ``vectors`` has it, is no candidate."""
    # Vectors of float stay float until they are compared: half the bytes, the same numbers.
    real = "float" if {dict(df.dtypes)[embedding] for df in (vectors, queries)} == {"array<float>"} else "double"

    def rows_of(df):
        e = F.col(f"`{embedding}`").cast(f"array<{real}>")
        return (df.select(F.col(f"`{id}`").cast("long").alias("id"), e.alias("v"))
                .where(F.col("id").isNotNull() & usable(F.col("v")) & F.exists("v", lambda x: x != 0)).distinct())

    spark = vectors.sparkSession
    few = (rows_of(vectors).withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(f"r <= {k + 1}")
           .groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    classes = written(few.withColumn("c", F.monotonically_increasing_id()), "classes")
    asked = written(rows_of(queries).select("v").distinct().join(classes.select("v", F.col("c").alias("own")), "v", "left")
                    .select("v", F.coalesce("own", F.lit(-1)).alias("own")).withColumn("q", F.monotonically_increasing_id()), "queries")
    askers = written(rows_of(queries).join(asked, "v").select(F.col("id").alias("query_id"), "q", "own"), "askers")

    # Per length of vectors that is queried: rotations by the number of vectors, probes by a bounded sample.
    plans = {}
    dims = [df.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias(n)) for df, n in ((classes, "n"), (asked, "asked"))]
    for dim, n, wanted in [tuple(r) for r in dims[0].join(dims[1], "dim").collect()]:
        part = classes.where(F.size("v") == dim).select(F.col("v").cast("array<double>").alias("v")).orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toPandas()["v"]
        plans[dim] = planned(normed(scaled(part)), n, wanted, tables, bucket, k, recall, seed)
    if not plans:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def keyed(ask):
        def run(batches):
            known = {}
            for b in batches:
                for dim, own in b.groupby(b["v"].map(len)):
                    if dim not in plans:
                        continue
                    turns, count = plans[dim]
                    poly = known.setdefault(dim, Polytopes(dim, tables, turns, seed))
                    step = max(1, min(1024, AT_ONCE // (count if ask else tables)))
                    for at in range(0, len(own), step):
                        part = own.iloc[at:at + step]
                        unit, base = normed(scaled(part["v"])), int(dim) << 40
                        part = part.assign(v=[x.tobytes() for x in matrix(part["v"]).astype(NUMPY[real])])
                        if ask:
                            for t in range(tables):
                                yield part.assign(t=t, keys=list(base + (t << 36) + poly.probes(unit, t, count)))
                        else:
                            yield part.assign(keys=list(np.stack([base + (t << 36) + poly.buckets(unit, t) for t in range(tables)], 1)))
        return run

    index = written(classes.select("c", "ids", "v").mapInPandas(keyed(False), "c long, ids array<long>, v binary, keys array<long>"), "index")
    probes = written(asked.select("q", "v").mapInPandas(keyed(True), "q long, v binary, t int, keys array<long>"), "probes")
    wide = max(plans)
    sizes = written(sized(*(df.select(F.explode("keys").alias("key")) for df in (probes, index)), "key", max(1, ASKED // wide), max(1, INDEXED // wide)), "sizes")

    def best(left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "vec_id": [], "c": [], "score": []})
        x, y = (scaled(np.frombuffer(b"".join(df["v"]), NUMPY[real]).reshape(len(df), -1)) for df in (left, right))
        nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
        ux, uy = x / nx[:, None], y / ny[:, None]
        ids, c, q = list(right["ids"]), right["c"].to_numpy(), left["q"].to_numpy()
        lowest = np.array([z[0] for z in ids])
        out = []
        for a in range(0, len(x), 256):
            i, j, exact, low = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.full(len(x[a:a + 256]), -2.0)
            # k + 1 entries hold k candidates, even if one of them is only the query itself. What was found so far bounds what follows.
            for b in range(0, len(y), 2048):
                s = ux[a:a + 256] @ uy[b:b + 2048].T
                if not b and s.shape[1] > k + 1:
                    low = np.partition(s, s.shape[1] - k - 1, axis=1)[:, s.shape[1] - k - 1]
                ii, jj = np.nonzero(s >= low[:, None] - CLOSE)
                ii, jj = ii + a, jj + b
                more = [(x[ii[z:z + 8192]] * y[jj[z:z + 8192]]).sum(1) / (nx[ii[z:z + 8192]] * ny[jj[z:z + 8192]]) for z in range(0, len(ii), 8192)]
                i, j, exact = np.append(i, ii), np.append(j, jj), np.concatenate([exact, *(np.clip(z, -1, 1) for z in more)])      # rounding may pass 1
                order = np.lexsort((lowest[j], -exact, i))
                order = order[first(i[order], k + 1)]
                i, j, exact = i[order], j[order], exact[order]
                full = np.flatnonzero(np.bincount(i - a, minlength=len(low)) > k)
                low[full] = exact[np.searchsorted(i, full + a, "right") - 1]
            n = np.array([len(ids[z]) for z in j])
            i, j, exact, vec = np.repeat(i, n), np.repeat(j, n), np.repeat(exact, n), np.concatenate([ids[z] for z in j])
            order = np.lexsort((vec, -exact, i))
            order = order[first(i[order], k + 1)]
            out.append(pd.DataFrame({"q": q[i[order]], "vec_id": vec[order], "c": c[j[order]], "score": exact[order]}))
        return pd.concat(out)

    found = []
    for t in range(tables):
        left = probes.where(F.col("t") == t).select("q", "v", F.explode("keys").alias("key"))
        right = index.select("c", "ids", "v", F.col("keys")[t].alias("key"))
        met = paired(left, right, "key", "q", "c", sizes).applyInPandas(best, "q long, vec_id long, c long, score double")
        met = met.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id", "c"))).where(f"r <= {k + 1}").drop("r")
        found.append(written(met, "found"))
    top = (reduce(DataFrame.unionAll, found).groupBy("q", "vec_id", "c").agg(F.max("score").alias("score"))
           .groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id", "c"))), 1, k + 1).alias("top")))
    other = F.filter("top", lambda x: (x["vec_id"] != F.col("query_id")) | (x["c"] != F.col("own")))
    return (askers.join(top, "q").select("query_id", F.posexplode(F.slice(other, 1, k)))
            .select("query_id", (F.col("pos") + 1).alias("rank"), "col.vec_id", (-F.col("col.less")).alias("score")))
