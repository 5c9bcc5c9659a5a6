"""Plans the operators must keep: what is scanned, shuffled and broadcast."""
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lateline.operators import joins, sampling, windows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["w01_lag_by_day_trip", "w03_position_zero_based", "w05_distance_in_trip", "w06_distance_in_file_order"])
def test_windows_never_use_one_partition(spark, sf, name):
    assert "SinglePartition" not in plan(entry.queries()[name](spark, sf))


def test_unchunked_window_shuffles_once(spark):
    df = spark.range(10).selectExpr("id % 3 as k", "id as t")
    assert plan(windows.previous_value(df, ["k"], ["t"], "t", "p")).count("Exchange") == 1


def test_filters_and_columns_reach_the_scan(spark, sf):
    p = plan(entry.queries()["p13_equalities"](spark, sf))
    assert "EqualTo(event_type,click)" in p and "EqualTo(user_id,8)" in p
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,value:double>" in p
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_linestatus:string>" in plan(entry.queries()["a06_count_distinct"](spark, sf))


def test_hash_split_and_folds_do_not_shuffle(spark):
    df = spark.range(100)
    train, test = sampling.train_test(df, 1, ["id"], exact=False)
    for d in (train, test, sampling.with_fold(df, 5, 1, ["id"])):
        assert "Exchange" not in plan(d)


def test_large_dimension_is_not_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fact, dim = spark.range(10).withColumnRenamed("id", "k"), spark.range(10).selectExpr("id", "id * 2 as v")
        assert "Broadcast" not in plan(joins.lookup(fact, dim, {"k": "id"}, {"v": "v"}))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_small_dimensions_are_broadcast(spark, sf):
    assert "BroadcastHashJoin" in plan(entry.queries()["j07_region_filter"](spark, sf))
    assert "BroadcastHashJoin" in plan(entry.queries()["j06_traffic_inner"](spark, sf))


def test_metrics_do_not_evaluate_the_prediction_twice(spark):
    from lateline.operators.metrics import class_summary, regression_metrics
    calls = F.udf(lambda x: float(x), "double").asNondeterministic()
    df = spark.range(10).select(F.col("id").cast("double").alias("label"), calls("id").alias("prediction"))
    for d in (regression_metrics(df), class_summary(df)):
        assert plan(d).count("BatchEvalPython") == 1
