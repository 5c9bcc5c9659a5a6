"""The tree's searches against all scores."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from lateline.llm import gnat

KIND = "vec_id long, vector array<bigint>, label int"


def brute(rows, anchors, positives=5, negatives=10, low=30, high=90):
    rows = sorted({(i, tuple(v), l) for i, v, l in rows if i is not None and l is not None and v and None not in v and sum(x * x for x in v) < 1 << 62})
    out = []
    for i, v, l in rows:
        if i not in anchors:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, m) for j, w, m in rows if j != i and len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2] == l][:positives]:
            fit = [x for x in scored if x[2] != l and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fit)]
    return sorted(out)


def told(df):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


def asked(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "vec_id long")


@pytest.mark.parametrize("dim,leaf,ways", [(2, 20, 3), (8, 25, 4), (64, 60, 5), (64, 4096, 16)])
def test_equals_brute_force(spark, dim, leaf, ways):
    rng = np.random.default_rng(dim)
    base = rng.standard_normal((6, dim))
    v = np.floor(60 * (base[rng.integers(0, 6, 300)] + 0.5 * rng.standard_normal((300, dim)))).astype(int)
    rows = [(i, v[i].tolist(), int(rng.integers(0, 4))) for i in range(300)]
    ids = list(range(0, 300, 12))
    got = told(gnat.hard_negatives(spark.createDataFrame(rows, KIND).repartition(3), asked(spark, ids), leaf=leaf, ways=ways))
    assert got == brute(rows, ids) and len(got) > 300


def test_hot_vector_ties_and_unusable_rows(spark):
    rng = np.random.default_rng(3)
    hot = [10, -3, 4, 0, 8]
    rows = [(i, hot, i % 3) for i in range(0, 120)]
    rows += [(200 + i, (rng.integers(-9, 9, 5)).tolist(), int(rng.integers(0, 3))) for i in range(150)]
    rows += [(200 + i, [2 * x for x in hot], 1) for i in range(6)] + [(5, hot, 5 % 3), (5, [1, 2, 3, 4, 5], 2), (5, [1, 2, 3, 4, 6], 2), (5, [0, 0, 0, 0, 1], 2)]
    rows += [(900, None, 1), (901, [], 1), (902, [1, None, 2, 3, 4], 1), (903, hot, None), (None, hot, 1), (904, [1 << 40] * 5, 1), (905, [0] * 5, 2), (906, [1, 2], 1),
             (907, [2, 2], 1), (908, [1, 1], 2), (909, [1 << 28] * 5, 1), (910, [(1 << 28) - 1] * 5, 2), (911, [-7] * 5, 77)]
    df = spark.createDataFrame([(*r, "x") for r in rows], KIND + ", node string")
    ids = [0, 5, 7, 200, 203, 900, 905, 906, 909, 911, 12345]
    got = told(gnat.hard_negatives(df, asked(spark, ids), leaf=16, ways=4))
    assert got == brute(rows, ids)
    assert {r[0] for r in got} >= {0, 5, 7, 906}


def test_equal_vectors_of_many_labels_stay_a_leaf(spark):
    rows = [(i, [3, 4], i) for i in range(60)] + [(100 + i, [3, 4], 7) for i in range(5)]
    df = spark.createDataFrame(rows, KIND)
    assert told(gnat.hard_negatives(df, asked(spark, [7]), leaf=8, ways=3, high=100)) == brute(rows, [7], high=100)


def test_siblings_are_eliminated(spark):
    rng = np.random.default_rng(8)
    base = 400 * rng.standard_normal((12, 16))
    v = np.floor(base[np.arange(600) % 12] + 4 * rng.standard_normal((600, 16))).astype(int)
    df = spark.createDataFrame([(i, v[i].tolist(), 0, [i]) for i in range(600)], "c long, v array<bigint>, label long, ids array<long>").select("c", "label", "v", "ids")
    tree = gnat.Tree(df, ways=6, leaf=60)
    leaves = tree.rows.select("node").distinct().count()
    one = df.where("c = 5").select(F.lit(0).cast("long").alias("s"), F.lit(5).cast("long").alias("anchor_id"), F.lit(0).cast("long").alias("other_id"), "label", "v",
                                   F.lit(int(v[5] @ v[5]) - 4000).cast("long").alias("low"), F.lit(gnat.FAR).alias("high"))
    routed = [r["node"] for r in tree.route(one).collect()]
    inside = {r["node"] for r in tree.rows.where(F.col("c") % 12 == 5).collect()}
    assert leaves >= 10 and inside & set(routed) and len(routed) <= leaves // 2


def test_empty(spark):
    df = spark.createDataFrame([], KIND)
    assert gnat.hard_negatives(df, asked(spark, [1])).collect() == []
    some = spark.createDataFrame([(1, [1, 2], 0), (2, [1, 3], 0)], KIND)
    assert gnat.hard_negatives(some, asked(spark, [])).collect() == []
    assert gnat.hard_negatives(some, asked(spark, [1])).collect() == []
