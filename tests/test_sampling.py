from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lateline.operators import sampling as X


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def base(spark, n=3000):
    return spark.range(n).select("id", (F.col("id") % 7).alias("c"), F.when(F.col("id") % 11 != 0, F.col("id") * F.col("id")).alias("v"))


def test_exact_size_and_partition_independence(spark):
    df = base(spark)
    for n in (0, 1, 777, 3000, 5000):
        a = ids(X.sample_exact(df, n, 42, ["id"]))
        assert len(a) == min(n, 3000) and len(set(a)) == len(a)
        assert a == ids(X.sample_exact(df.repartition(13), n, 42, ["id"]))
    assert ids(X.sample_exact(df, 100, 1, ["id"])) != ids(X.sample_exact(df, 100, 2, ["id"]))


def test_splits_are_disjoint_and_complete(spark):
    df = base(spark, 100)
    train, test = X.train_test(df, 42, ["id"], 0.2)
    assert len(ids(train)) == 80 and len(ids(test)) == 20 and sorted(ids(train) + ids(test)) == list(range(100))
    train, test = X.train_test(df, 42, ["id"], 0.2, exact=False)
    assert sorted(ids(train) + ids(test)) == list(range(100))
    none, everything = X.train_test(df, 42, ["id"], 0)
    assert ids(none) == [] and len(ids(everything)) == 100


def test_stratified_split_and_folds(spark):
    df = base(spark)
    train, test = X.stratified_train_test(df, "c", 42, ["id"], 0.25)
    assert sorted(ids(train) + ids(test)) == list(range(3000))
    whole = {r.c: r["count"] for r in df.groupBy("c").count().collect()}
    part = {r.c: r["count"] for r in test.groupBy("c").count().collect()}
    assert all(abs(part[c] - whole[c] * 0.25) <= 0.5 for c in whole)
    folded = X.with_stratified_fold(df, "c", 5, 42, ["id"], hot_rows=100)
    sizes = [r["count"] for r in folded.groupBy("c", "fold").count().collect()]
    assert len(sizes) == 35 and max(sizes) - min(sizes) <= 1


def test_stratified_sample(spark):
    df = base(spark)
    for n in (10, 500):
        s = X.sample_stratified(df, n, "v", 42, ["id"], bins=5)
        assert s.count() == n and s.filter("v is null").count() == 0
    flat = df.withColumn("v", F.lit(1.0))
    assert X.sample_stratified(flat, 50, "v", 42, ["id"]).count() == 50
    skew = df.withColumn("v", F.when(F.col("id") < 2500, 0.0).otherwise(F.col("id").cast("double")))
    assert X.sample_stratified(skew, 300, "v", 42, ["id"]).count() == 300


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=1, max_size=12), st.integers(12, 10**5))
def test_allocation_adds_up(counts, n):
    shares = X.allocate(counts, n)
    assert sum(shares) == n and min(shares) >= 1


def test_fraction():
    assert X.fraction_size(10, 0.05) == 1 and X.fraction_size(999, 0.1) == 99


def test_quota_above_stratum_size_keeps_all(spark):
    df = base(spark, 70)
    assert X.first_by_hash(df, 1, ["id"], ["c"], F.lit(100)).count() == 70


def test_both_sides_read_the_rows_once_each(spark, folder):
    from test_plans import plan
    base(spark).write.parquet(f"{folder}/t")
    df = spark.read.parquet(f"{folder}/t")
    for train, test in (X.train_test(df, 42, ["id"], 0.2), X.stratified_train_test(df, "c", 42, ["id"], 0.25)):
        both = train.unionByName(test)
        assert plan(both).count("FileScan parquet") == 2 and both.count() == 3000


def test_ties_at_the_cut_keep_the_size_exact(spark):
    df = spark.range(600).select((F.col("id") / 100).cast("int").alias("id"), F.col("id").alias("row"))     # 100 rows per key
    for n in (1, 50, 100, 150, 599):
        got = [r.row for r in X.sample_exact(df, n, 3, ["id"]).collect()]
        assert len(got) == n and len(set(got)) == n
    train, test = X.train_test(df, 3, ["id"], 0.25)
    assert train.count() == 450 and test.count() == 150 and train.intersect(test).count() == 0


def test_null_strata_and_null_keys(spark):
    df = spark.range(200).select(F.when(F.col("id") % 5 > 0, F.col("id")).alias("id"), F.when(F.col("id") % 3 > 0, F.lit("x")).alias("s"))
    got = {r.s: r["count"] for r in X.first_by_hash(df, 1, ["id"], ["s"], F.lit(30)).groupBy("s").count().collect()}
    assert got == {None: 30, "x": 30}
