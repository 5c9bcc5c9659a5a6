import random

import pytest
from pyspark.sql import functions as F

from lateline.operators import windows as W


def skewed(spark, n=4000, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        u = rng.random()
        key = None if u < 0.2 else ("hot" if u < 0.6 else f"k{rng.randrange(300)}")
        rows.append((i, key, rng.randrange(500), rng.choice([None, *range(20)]), rng.random()))
    return spark.createDataFrame(rows, "id long, k string, t int, v int, x double")


@pytest.mark.parametrize("hot_rows", [0, 50, 10**9])
def test_chunked_equals_plain_window(spark, hot_rows):
    df = skewed(spark)
    kw = dict(lags={"pv": "v", "px": "x"}, index="pos", base=1)
    plain = W.with_previous(df, ["k"], ["t", "id"], **kw)
    cut = W.with_previous(df, ["k"], ["t", "id"], chunk=F.floor(F.col("t") / 7).cast("int"), hot_rows=hot_rows, **kw)
    assert cut.columns == plain.columns
    key = lambda d: sorted((tuple(r) for r in d.collect()), key=lambda r: r[0])
    assert key(plain) == key(cut)


def test_position_over_no_key(spark):
    df = skewed(spark, 1000)
    out = W.position(df, [], ["t", "id"], "pos", base=0, chunk=W.sampled_chunks(df, "t", 16), hot_rows=0)
    got = [r.id for r in out.orderBy("pos").collect()]
    want = [r.id for r in df.orderBy("t", "id").collect()]
    assert got == want


def test_hot_key_is_split_over_tasks(spark):
    df = spark.range(20000).select(F.lit("one").alias("k"), F.col("id").alias("t"), (F.col("id") % 9).alias("v"))
    out = W.previous_value(df, ["k"], ["t"], "v", "prev", chunk=F.floor(F.col("t") / 500).cast("int"), hot_rows=1000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) > 1 and max(sizes) < 20000


def test_distance_modes(spark):
    rows = [("a", 1, 0.0, 0.0), ("b", 2, 3.0, 0.0), ("a", 3, 3.0, 4.0), ("a", 4, 3.0, 4.0), ("b", 5, None, 1.0), ("b", 6, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "trip string, t int, x double, y double").withColumn("day", F.lit(1))
    per_trip = W.distance_to_previous(df, ["day", "trip"], ["t"], "x", "y", "d")
    assert {r.t: r.d for r in per_trip.collect()} == {1: None, 2: None, 3: 5.0, 4: 0.0, 5: None, 6: None}
    file_order = W.distance_to_previous(df, ["day"], ["t"], "x", "y", "d", same="trip")
    assert {r.t: r.d for r in file_order.collect()} == {1: None, 2: None, 3: None, 4: 0.0, 5: None, 6: None}


def test_filled_lag(spark):
    df = spark.createDataFrame([(1, 1, 10), (1, 2, 20), (2, 1, 5)], "k int, t int, v int")
    out = W.previous_value_filled(df, ["k"], ["t"], "v", "p", 7.5)
    assert sorted((r.k, r.t, r.p) for r in out.collect()) == [(1, 1, 7.5), (1, 2, 10.0), (2, 1, 7.5)]
    assert dict(out.dtypes)["p"] == "float"


@pytest.mark.parametrize("hot_rows", [0, 50, 10**9])
def test_null_order_is_the_first_chunk(spark, hot_rows):
    df = skewed(spark, 2000).withColumn("t", F.when(F.col("t") % 4 != 0, F.col("t")))
    kw = dict(lags={"pv": "v"}, index="pos")
    plain = W.with_previous(df, ["k"], ["t", "id"], **kw)
    cut = W.with_previous(df, ["k"], ["t", "id"], chunk=F.floor(F.col("t") / 7).cast("int"), hot_rows=hot_rows, **kw)
    key = lambda d: sorted((tuple(r) for r in d.collect()), key=lambda r: r[0])
    assert key(plain) == key(cut)


@pytest.mark.parametrize("hot_rows,chunk_rows", [(0, 30), (50, 100), (10**9, 5)])
@pytest.mark.parametrize("order", ["t", "s", "at"])
def test_measured_chunks_equal_plain_window(spark, hot_rows, chunk_rows, order):
    df = skewed(spark, 3000).withColumn("t", F.when(F.col("t") % 9 != 0, F.col("t")))
    df = df.withColumn("s", F.concat(F.lit("stop-number-"), F.col("t"))).withColumn("at", F.timestamp_millis(F.col("t") * 1000))
    kw = dict(lags={"pv": "v", "px": "x"}, index="pos", base=1)
    plain = W.with_previous(df, ["k"], [order, "id"], **kw)
    cut = W.with_previous(df, ["k"], [order, "id"], chunk=W.MEASURED, hot_rows=hot_rows, chunk_rows=chunk_rows, **kw)
    key = lambda d: sorted((tuple(r) for r in d.collect()), key=lambda r: r[0])
    assert cut.columns == plain.columns and key(plain) == key(cut)


def test_chunks_of_a_hot_key_have_about_the_size_asked_for(spark):
    # Nine tenths of the rows lie in a hundredth of the axis.
    df = spark.range(40_000).select(F.lit("one").alias("k"), F.when(F.col("id") % 10 > 0, F.col("id")).otherwise(F.col("id") * 100_000).alias("t"))
    hot = W._with_borders(df, W._hot_keys(df, ["k"], 1000), ["k"], ["t"], 1000)
    sizes = [r["count"] for r in df.join(hot, df.k == hot.__hk).groupBy(W._chunk_of(F.col("t"))).count().collect()]
    assert sum(sizes) == 40_000 and 25 <= len(sizes) <= 60 and max(sizes) < 4000


def test_two_scans_with_and_one_without_a_hot_key(spark, folder):
    from test_plans import plan
    spark.range(5000).select((F.col("id") % 2).alias("k"), F.col("id").alias("t")).write.parquet(f"{folder}/t")
    df = spark.read.parquet(f"{folder}/t")
    scans = lambda d: plan(d).count("FileScan parquet")
    none = W.with_previous(df, ["k"], ["t"], lags={"p": "t"}, index="i", chunk=W.MEASURED)
    some = W.with_previous(df, ["k"], ["t"], lags={"p": "t"}, index="i", chunk=W.MEASURED, hot_rows=100, chunk_rows=100)
    assert scans(none) == 1 and plan(none).count("Exchange") == 1 and scans(some) == 2
    assert sorted(map(tuple, none.collect())) == sorted(map(tuple, some.collect()))
