import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from lateline.learn import boosting as B
from lateline.learn import experiment as X


def sides(spark, rows, **kw):
    df = spark.createDataFrame(rows, "x double, label double")
    return B.MissingSides(inputCols=["x"], cuts=16, **kw).fit(df), df


@pytest.mark.parametrize("missing,below", [(0.0, True), (100.0, False)])
def test_missing_rows_join_the_side_they_resemble(spark, missing, below):
    rows = [(float(i % 10), 0.0 if i % 10 < 5 else 100.0) for i in range(200)] + [(None, missing)] * 40 + [(float("nan"), missing)] * 10
    model, df = sides(spark, rows)
    fill = model["fills"][0]
    assert fill < 0 if below else fill > 9
    stump = B.with_missing(["x"], GBTRegressor(maxIter=1, maxDepth=1), flags=False).fit(df)
    got = {r.prediction for r in stump.transform(df).where("x is null or isnan(x) or x = " + ("0" if below else "9")).collect()}
    assert got == {missing}


def test_sides_of_classes_equal_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 6))
        sums = {b: [float(c.sum()), *map(float, c)] for b in range(-1, n) for c in [rng.integers(0, 9, 3)]}
        def error(groups):
            return sum(s[0] - sum(t * t for t in s[1:]) / s[0] for s in groups if s[0])     # squared error of indicators
        add = lambda parts: [sum(z) for z in zip([0.0] * 4, *parts)]
        def best(left):
            out = []
            for b in range(n):
                low, high = [sums[k] for k in range(b + 1)], [sums[k] for k in range(b + 1, n)]
                if left and sum(h[0] for h in high) > 0:
                    out.append(error([add(low + [sums[-1]]), add(high)]))
                if not left:
                    out.append(error([add(low), add(high + [sums[-1]])]))
            return min(out, default=float("inf"))
        want, other = best(True), best(False)
        if abs(want - other) > 1e-9:
            assert B.left_loses_least(sums, n) == (want < other)


def test_columns_without_gaps_or_values_and_medians(spark):
    df = spark.createDataFrame([(float(i), None, None if i % 3 else float(i), i % 2, float(i)) for i in range(99)], "a double, b double, c double, d int, label double")
    model = B.MissingSides(inputCols=["a", "b", "c", "d"]).fit(df)
    assert model["fills"][:2] == [49.0, 0.0]
    later = spark.createDataFrame([(None, None, None, None, 1.0)], df.schema)
    row = model.transform(later).first()
    assert (row.a, row.b, row.a_missing, row.d_missing) == (49.0, 0.0, 1.0, 1.0)
    medians = B.MissingSides(inputCols=["a", "c"], how="median", flags=False).fit(df)
    assert medians["fills"] == [49.0, 48.0] and "a_missing" not in medians.transform(df).columns
    empty = B.MissingSides(inputCols=["a"]).fit(df.limit(0))
    assert empty["fills"] == [0.0]


def test_boosters_and_forests_take_gaps_and_are_saved(spark, folder):
    rng = np.random.default_rng(1)
    rows = [(i, float(a) if rng.random() > 0.3 else None, float(b), float(3 * a + b)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "id int, a double, b double, label double")
    with pytest.raises(Exception):
        X.vectors(["a", "b"]).transform(df)
        GBTRegressor(maxIter=1).fit(X.vectors(["a", "b"]).transform(df))
    for model in (GBTRegressor(maxIter=8, maxDepth=4, seed=1), RandomForestRegressor(numTrees=10, seed=1)):
        fitted = B.with_missing(["a", "b"], model).fit(df)
        error = fitted.transform(df).agg(F.avg(F.pow(F.col("prediction") - F.col("label"), 2))).first()[0]
        assert error < 0.5 * df.agg(F.var_pop("label")).first()[0]
        fitted.write().overwrite().save(f"{folder}/m")
        again = PipelineModel.load(f"{folder}/m")
        key = lambda m: sorted((r.id, r.prediction) for r in m.transform(df).select("id", "prediction").collect())
        assert key(again) == key(fitted)


@pytest.fixture(scope="module")
def classes(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=600) > 0).astype(int) + (x[:, 1] > 0.8)
    noise = rng.integers(0, 3, 600)
    df = spark.createDataFrame([(i, *map(float, r), float(t), float(u)) for i, (r, t, u) in enumerate(zip(x, y, noise))], "id int, a double, b double, c double, label double, noise double")
    return X.vectors(["a", "b", "c"]).transform(df)


def test_joint_boosting_learns_stops_and_is_saved(classes, folder):
    est = B.BoostedClasses(keyCols=["id"], rounds=12, depth=3, step=0.4, patience=2, slice=0.2)
    model = est.fit(classes)
    scored = model.transform(classes).select("id", "label", "probability", "prediction").collect()
    assert all(len(r.probability) == 3 and sum(r.probability) == pytest.approx(1.0) and min(r.probability) > 0 for r in scored)
    assert all(r.probability[int(r.prediction)] == max(r.probability) for r in scored)
    assert np.mean([r.label == r.prediction for r in scored]) > 0.85
    assert model["losses"][model["rounds"] - 1] == min(model["losses"]) < np.log(3)
    model.write().overwrite().save(f"{folder}/boosted")
    again = B.BoostedClassesModel.load(f"{folder}/boosted").transform(classes)
    assert {r.id: tuple(np.round(r.probability, 9)) for r in again.collect()} == {r.id: tuple(np.round(r.probability, 9)) for r in scored}


def test_noise_stops_early(classes):
    model = B.BoostedClasses(keyCols=["id"], labelCol="noise", rounds=30, depth=3, step=0.5, patience=2, slice=0.3).fit(classes)
    assert model["rounds"] <= 5 and len(model["losses"]) < 30


def test_rounds_follow_the_gradient(classes):
    """Two rounds against the same steps by hand, on one split."""
    df = classes.withColumn("x1", (F.col("a") > 0).cast("double")).drop("features")
    df = X.vectors(["x1"]).transform(df)
    model = B.BoostedClasses(keyCols=["id"], slice=0.0, rounds=2, depth=1, step=0.7, mode="none").fit(df)
    rows = [(r.x1, int(r.label), r.probability) for r in model.transform(df).collect()]
    side = {v: np.bincount([y for x, y, _ in rows if x == v], minlength=3) / sum(x == v for x, _, _ in rows) for v in (0.0, 1.0)}
    prior = np.bincount([y for _, y, _ in rows], minlength=3) / len(rows)
    soft = lambda f: np.exp(f) / np.exp(f).sum()
    for v in side:
        f = np.log(prior)
        for _ in range(2):
            p = soft(f)
            f = f + 0.7 * (side[v] - p) / (p * (1 - p))
        assert np.allclose(next(p for x, _, p in rows if x == v), soft(f), atol=1e-6)


def test_perceptron_stops_when_the_slice_stops_improving(classes, folder):
    from lateline.learn import models as M
    separable = classes.withColumn("label", (F.col("a") > 0).cast("double"))
    model = M.StoppingPerceptron(keyCols=["id"], hidden=[4.0], block=10, most=400, slice=0.2).fit(separable)
    assert 10 <= model["kept"] <= model["iterations"] < 400
    got = model.transform(separable).select("id", "label", "prediction").collect()
    assert np.mean([r.label == r.prediction for r in got]) > 0.97
    model.write().overwrite().save(f"{folder}/p")
    again = M.StoppedPerceptronModel.load(f"{folder}/p").transform(separable)
    assert {r.id: r.prediction for r in again.collect()} == {r.id: r.prediction for r in got}
    noise = M.StoppingPerceptron(keyCols=["id"], labelCol="noise", hidden=[8.0], block=5, most=300, slice=0.3).fit(classes)
    assert noise["iterations"] < 300 and noise["losses"][noise["kept"] // 5 - 1] <= 1.01 * min(noise["losses"])


def test_race_is_the_same_serial_and_side_by_side(classes):
    from pyspark.ml.classification import RandomForestClassifier

    from lateline.learn import models as M
    ridge = lambda s: M.Ridge(alpha=s["alpha"])
    target = classes.withColumn("label", 3 * F.col("a") - F.col("b"))
    runs = [X.race(target, target, ridge, {"alpha": ("log", 1e-3, 1e5)}, key=["id"], trials=6, rungs=[0.3, 1.0], keep=0.5, parallelism=p) for p in (1, 4)]
    assert runs[0][0] == runs[1][0] and [t[:2] for t in runs[0][3]] == [t[:2] for t in runs[1][3]]
    assert [t[0] for t in runs[0][3]] == [0.3] * 6 + [1.0] * 3
    full = {t: s for share, t, s in X.race(target, target, ridge, {"alpha": ("log", 1e-3, 1e5)}, key=["id"], trials=6, rungs=[1.0])[3]}
    final = [t for share, t, _ in runs[0][3] if share == 1.0]
    assert max(full, key=full.get) in final
    tree = lambda s: RandomForestClassifier(numTrees=3, maxDepth=s["depth"], seed=1)
    best, metrics, _, told = X.race(classes, classes, tree, {"depth": ("choice", [0, 3])}, key=["id"], trials=4, rungs=[0.5, 1.0], classify=True)
    assert best == {"depth": 3} and metrics.first()["macro_f1"] > 0.5
