import datetime as dt
import math

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from lateline.learn import features as E


def test_target_mean(spark):
    df = spark.createDataFrame([(8, 0, 100.0), (8, 0, 200.0), (17, 0, 50.0), (17, 0, 150.0), (8, 1, 80.0)], "hour int, dow int, label double")
    m = E.HistoricalMean(keyCols=["hour", "dow"]).fit(df)
    new = spark.createDataFrame([(8, 0), (17, 0), (23, 6), (None, 0)], "hour int, dow int")
    got = {(r.hour, r.dow): r.hist_mean_delay for r in m.transform(new).collect()}
    assert got == {(8, 0): 150.0, (17, 0): 100.0, (23, 6): 116.0, (None, 0): 116.0}
    with pytest.raises(ValueError):
        E.HistoricalMean(keyCols=["hour"], labelCol="y").fit(df)


def test_scaler_uses_population_std(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    m = E.Standardize(inputCols=["a", "b"]).fit(df)
    assert [(r.a, r.b) for r in m.transform(df).collect()] == [(-1.0, 0.0), (1.0, 0.0)]
    assert m.transform(spark.createDataFrame([(5.0, 6.0)], "a double, b double")).first() == (3.0, 1.0)


def test_products_and_waves(spark):
    df = spark.createDataFrame([(2.0, 3.0, 9.0)], "a double, b double, rest double")
    out = E.Products(inputCols=["a", "b"], degree=2).transform(df)
    assert out.columns == ["rest", "a", "b", "a^2", "a b", "b^2"] and tuple(out.first()) == (9.0, 2.0, 3.0, 4.0, 6.0, 9.0)
    assert len(E.Products(inputCols=["a", "b"], degree=3).transform(df).columns) == 10
    w = E.Waves(inputCols=["a", "b"], waves=3).transform(df)
    assert len(w.columns) == len(df.columns) + 10 and "a" not in w.columns
    assert w.first()["b_sin2"] == pytest.approx(math.sin(6.0))
    t = E.ProductsAndWaves(inputCols=["a"], degree=2, waves=1).transform(df)
    assert t.columns == ["b", "rest", "a", "a^2", "a_sin", "a_cos"]


def test_codes_by_appearance(spark):
    df = spark.createDataFrame([(3, "b"), (1, "z"), (2, "b"), (4, "a"), (5, None)], "i int, c string")
    m = E.CategoryCodes(inputCols=["c"], orderCol="i").fit(df)
    got = {r.i: r.c for r in m.transform(df).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2, 5: 3}
    assert m.transform(spark.createDataFrame([(9, "new")], "i int, c string")).first().c == 3
    m = E.CategoryCodes(inputCols=["c"]).fit(df)
    assert {r.i: r.c for r in m.transform(df).collect()} == {1: 2, 2: 1, 3: 1, 4: 0, 5: 3}


def test_wind_stages(spark):
    df = spark.createDataFrame([(90.0, 2.0, 4.0)], "wind_dir double, wind_speed double, wind_gust double")
    r = E.WindMean().transform(E.WindDirection().transform(df)).first()
    assert r.wind == 3.0 and r.wind_dir_sin == pytest.approx(1.0) and set(r.asDict()) == {"wind", "wind_dir_sin", "wind_dir_cos"}


def test_rush_hour_needs_a_time(spark):
    df = spark.createDataFrame([(9, 2.0, 0.0), (10, 2.0, 0.0), (16, 0.0, None), (19, None, 0.1)], "hour int, precipitation double, snow_depth double")
    got = [(r.is_rush_hour, r.weather_rush_hour_stress) for r in E.RushHourStress().transform(df).collect()]
    assert got == [(1, 1), (0, 0), (1, 0), (1, 1)]
    with pytest.raises(ValueError):
        E.RushHourStress().transform(df.drop("hour"))


def test_principal_parts(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) @ np.diag([3.0, 1.0, 0.1]) + 5
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    out = E.PrincipalParts(inputCols=["a", "b", "c"], variance=0.95).fit(df).transform(df)
    assert out.columns == ["pc1", "pc2"]
    got = np.array([tuple(r) for r in out.collect()])
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs((u * s)[:, :2]), atol=1e-8)
    assert len(E.PrincipalParts(inputCols=["a", "b", "c"], k=3).fit(df).transform(df).columns) == 3


def test_kernel_features_reproduce_the_kernel(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 2))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double")
    m = E.KernelFeatures(inputCols=["a", "b"], keyCols=["id"], landmarks=100, gamma=0.5).fit(df)
    rows = m.transform(df).orderBy("id").collect()
    z = np.array([tuple(r)[1:] for r in rows])
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert z.shape == (30, 30) and np.allclose(z @ z.T, np.exp(-0.5 * d2), atol=1e-5)


def trips(spark):
    at = lambda d, m: dt.datetime(2025, 1, d, 8, m)
    rows = [("a", at(1, 0), 10), ("a", at(1, 5), 30), ("b", at(1, 1), 50), ("a", at(2, 0), 70)]
    return spark.createDataFrame(rows, "trip_id string, timestamp timestamp_ntz, arrival_delay_s int")


def test_previous_delay_paths(spark):
    df = trips(spark)
    m = E.PreviousDelay().fit(df)
    assert m["default"] == 40.0
    slow = m.transform(df)
    assert slow.columns == ["timestamp", "prev_stop_delay"]
    assert sorted(r.prev_stop_delay for r in slow.collect()) == [10.0, 40.0, 40.0, 40.0]
    fast = m.transform(df.withColumn("prev_stop_delay", F.when(F.col("trip_id") == "b", 1)))
    assert sorted(r.prev_stop_delay for r in fast.collect()) == [1.0, 40.0, 40.0, 40.0]
    bare = df.drop("arrival_delay_s")
    assert m.transform(bare).columns == bare.columns


def test_chain_is_saved_and_loaded(spark, folder):
    df = spark.createDataFrame([(i, dt.datetime(2025, 1, 1 + i % 20, i % 24), "xyz"[i % 3], float(i % 7)) for i in range(60)],
                               "id int, timestamp timestamp_ntz, line string, label double")
    chain = Pipeline(stages=[E.CalendarParts(), E.HistoricalMean(keyCols=["line", "hour"]), E.CategoryCodes(inputCols=["line"], orderCol="id"),
                             E.Standardize(inputCols=["hour"]), E.Waves(inputCols=["dow"], waves=2), E.PrincipalParts(inputCols=["hour", "month"], k=1)])
    m = chain.fit(df)
    m.write().overwrite().save(f"{folder}/m")
    again = PipelineModel.load(f"{folder}/m")
    key = lambda d: sorted(tuple(r) for r in d.collect())
    assert key(m.transform(df)) == key(again.transform(df))
