import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from lateline.operators import quantiles as Q


@pytest.mark.parametrize("small", [10, 20_000])
def test_matches_numpy_on_skewed_groups(spark, small):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.5 else rng.choice("abc"), rng.choice([rng.gauss(0, 1) ** 9, 1.0, None])) for _ in range(6000)]
    rows += [("one", 4.0), ("two", 1.0), ("two", 2.0), ("none", None), (None, 3.0), (None, 9.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = [0.0, 0.1, 0.5, 0.75, 1.0]
    got = {r.k: [r[f"q{i}"] for i in range(5)] for r in Q.exact_quantiles(df, ["k"], "v", probs, [f"q{i}" for i in range(5)], small).collect()}
    groups = {}
    for k, v in rows:
        groups.setdefault(k, []).append(v)
    assert set(got) == set(groups)
    for k, vs in groups.items():
        vs = [v for v in vs if v is not None]
        if not vs:
            assert got[k] == [None] * 5
        else:
            assert np.allclose(got[k], np.quantile(vs, probs), rtol=1e-12)


def test_several_columns_without_keys(spark):
    df = spark.range(1, 1002).selectExpr("id as a", "cast(id * id as double) as b", "cast(null as int) as c")
    r = Q.medians(df, [], ["a", "b", "c"], small_group=10).first()
    assert (r.a, r.b, r.c) == (501.0, 501.0**2, None)


def test_edges(spark):
    df = spark.range(0, 1001).selectExpr("id as v")
    assert Q.exact_edges(df, "v", 4) == [0.0, 250.0, 500.0, 750.0, 1000.0]
    assert len(Q.quantile_edges(df.selectExpr("1 as v"), "v", 4)) == 1


@pytest.mark.parametrize("shape", ["ties", "steep", "flat", "two"])
def test_no_window_orders_more_than_the_limit(spark, monkeypatch, shape):
    """Skewed values and a small limit: brackets are narrowed until what is ranked fits, and results stay exact."""
    rng = np.random.default_rng(4)
    n, limit = 20_000, 200
    v = {"ties": np.where(rng.random(n) < 0.6, 5.0, rng.normal(5, 1e-3, n)), "steep": rng.normal(size=n) ** 15,
         "flat": rng.random(n), "two": rng.integers(0, 2, n).astype(float)}[shape]
    df = spark.createDataFrame([("a" if i % 4 else None, float(x)) for i, x in enumerate(v)], "k string, v double").repartition(4).cache()
    sizes = []
    ranked = Q._ranked

    def watched(slim, brackets, groups, asked):
        rows = slim.join(brackets, slim.__g0.eqNullSafe(brackets.__g0)) if groups else slim.crossJoin(brackets)
        inner = [F.count_if((F.col("__c0") > F.col(f"__b{i}.low")) & (F.col("__c0") < F.col(f"__b{i}.high"))) for i in range(len(asked))]
        by = [slim.__g0] if groups else []
        sizes.extend(x for r in rows.groupBy(*by).agg(*[c.alias(f"s{i}") for i, c in enumerate(inner)]).collect() for x in r[len(by):])
        return ranked(slim, brackets, groups, asked)

    monkeypatch.setattr(Q, "_ranked", watched)
    probs = [0.0, 0.001, 0.25, 0.5, 0.77, 0.9999, 1.0]
    names = [f"q{i}" for i in range(7)]
    for keys in ([], ["k"]):
        for r in Q.exact_quantiles(df, keys, "v", probs, names, limit).collect():
            own = v if not keys else v[[i for i in range(n) if (i % 4 > 0) == (r.k == "a")]]
            assert np.allclose([r[x] for x in names], np.quantile(own, probs), rtol=1e-12)
    assert sizes and max(sizes) <= limit


def test_quantiles_read_the_rows_twice(spark, folder):
    from test_plans import plan
    spark.range(1000).selectExpr("id % 3 as k", "cast(id as double) as v").write.parquet(f"{folder}/t")
    q = Q.medians(spark.read.parquet(f"{folder}/t"), ["k"], ["v"])
    assert plan(q).count("FileScan parquet") == 1          # the first reading has been written as one row per group
    assert sorted((r.k, r.v) for r in q.collect()) == [(0, 499.5), (1, 499.0), (2, 500.0)]


def test_rows_of_few_groups_stay_where_they_are(spark, monkeypatch):
    df = spark.range(1000).selectExpr("id % 3 as __g0", "cast(id as double) as __c0")
    asked = Q._Requests({"m": ("v", 0.5)})
    from lateline.session import checkpoint
    brackets = checkpoint(Q._first_brackets(df, ["__g0"], asked, 10))
    plan = lambda: Q._beside(df, brackets, ["__g0"], asked)[0]._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")       # as beyond it: large tables make large estimates
    assert "BroadcastHashJoin" in plan() and "hashpartitioning" not in plan()
    monkeypatch.setattr(Q, "FEW_GROUPS", 2)
    assert "SortMergeJoin" in plan()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = {r.k: r.v for r in Q.medians(df.toDF("k", "v"), ["k"], ["v"], small_group=10).collect()}
    assert got == {0: 499.5, 1: 499.0, 2: 500.0}
