import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from lateline.learn import experiment as X
from lateline.learn import models as M
from lateline.learn.base import Saved


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 3))
    y = 60 * x[:, 0] - 20 * x[:, 1] + 40 * np.maximum(x[:, 2], 0) + rng.normal(scale=5, size=600) + 80
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id int, a double, b double, c double, label double")
    return X.vectors(["a", "b", "c"]).transform(df).cache(), x, y


def test_ridge_matches_the_normal_equations(data):
    df, x, y = data
    for alpha in (0.0, 1.0, 500.0):
        m = M.Ridge(alpha=alpha).fit(df)
        xc, yc = x - x.mean(0), y - y.mean()
        w = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
        assert np.allclose(m.coefficients.toArray(), w, rtol=1e-6)
        assert m.intercept == pytest.approx(y.mean() - x.mean(0) @ w, rel=1e-6)


def test_out_of_fold_covers_every_row_once(data):
    df, _, _ = data
    from lateline.operators.sampling import with_fold
    oof = M.out_of_fold(with_fold(df, 4, 1, ["id"]), [M.Ridge(alpha=1.0)], 4, ["p"], "prediction", 2)
    assert oof.count() == 600 and oof.select("id").distinct().count() == 600 and oof.filter("p is null").count() == 0


def reload(model, folder):
    model.write().overwrite().save(folder)
    return type(model).load(folder) if isinstance(model, Saved) else None


def r2(model, df):
    from lateline.operators.metrics import regression_metrics
    return regression_metrics(model.transform(df)).first()["r2"]


def same(a, b, df):
    key = lambda m: sorted((r.id, round(r.prediction, 9)) for r in m.transform(df).select("id", "prediction").collect())
    return key(a) == key(b)


def test_regression_wrappers(data, folder):
    df, _, _ = data
    tree = RandomForestRegressor(numTrees=5, maxDepth=5, seed=1)
    ridge = M.Ridge(alpha=1.0)
    plain = r2(ridge.fit(df), df)
    fits = {
        "stack": M.StackedRegressor(bases=[ridge, tree], meta=ridge, folds=3, keyCols=["id"]),
        "residual": M.ResidualStack(first=ridge, second=tree, folds=3, keyCols=["id"]),
        "by_class": M.ByClass(classifier=RandomForestClassifier(numTrees=5, seed=1), regressor=ridge, bins=[-400.0, 60.0, 120.0]),
        "ordinal": M.Ordinal(model=LogisticRegression(maxIter=20), bins=[60.0, 120.0], expected=True),
        "log": M.LogTarget(model=ridge),
    }
    for name, est in fits.items():
        m = est.fit(df)
        assert "features" in m.transform(df).columns
        score = r2(m, df)
        if name in ("stack", "residual"):
            assert score > plain - 0.01
        assert same(m, reload(m, f"{folder}/{name}"), df), name


def test_log_target_raises_its_offset(spark):
    df = X.vectors(["a"]).transform(spark.createDataFrame([(float(i), float(i - 5)) for i in range(20)], "a double, label double"))
    assert M.LogTarget(model=M.Ridge(alpha=0.1)).fit(df)["offset"] == 6.0
    shifted = df.withColumn("label", F.col("label") + 5)
    assert M.LogTarget(model=M.Ridge(alpha=0.1)).fit(shifted)["offset"] == 1.0


def test_small_class_uses_all_rows(data):
    df, _, y = data
    edge = float(np.sort(y)[4])
    m = M.ByClass(classifier=RandomForestClassifier(numTrees=3, seed=1), regressor=M.Ridge(alpha=1.0), bins=[edge]).fit(df)
    whole = M.Ridge(alpha=1.0).fit(df)
    assert np.allclose(m.parts["regressors"][0].coefficients, whole.coefficients)


def test_chain_probabilities(spark):
    df = spark.createDataFrame([(0.9, 0.5, 0.2), (0.4, 0.6, 0.1), (0.0, 0.0, 0.0)], "a double, b double, c double")
    got = [tuple(round(v, 6) for v in r) for r in df.select(*M.chain_probabilities([F.col(c) for c in "abc"])).collect()]
    assert got == [(0.1, 0.4, 0.3, 0.2), (0.6, 0.0, 0.3, 0.1), (1.0, 0.0, 0.0, 0.0)]


def test_class_models(data, folder):
    from lateline.learn.features import DelayClass
    from lateline.operators.metrics import class_summary
    df = DelayClass(inputCol="label", outputCol="label", bins=[40.0, 120.0]).transform(data[0])
    forest = RandomForestClassifier(numTrees=8, maxDepth=5, seed=1)
    fits = {
        "ordinal": M.Ordinal(model=LogisticRegression(maxIter=20)),
        "stack": M.StackedClassifier(bases=[forest, LogisticRegression(maxIter=20)], meta=LogisticRegression(maxIter=20), folds=3, keyCols=["id"]),
        "logistic": M.logistic(max_iter=20), "forest": M.forest_classifier(numTrees=8, seed=1),
        "boosted": M.boosted_classifier(maxIter=3, seed=1), "perceptron": M.perceptron(3, 3, hidden=(8,), maxIter=30, seed=1),
        "growing": M.GrowingForest(forest=forest, keyCols=["id"], sizes=[2.0, 4.0]),
    }
    for name, est in fits.items():
        m = est.fit(df)
        s = class_summary(m.transform(df)).first()
        assert s.n == 600 and s.macro_f1 > 0.6, name
        if isinstance(m, Saved):
            assert same(m, reload(m, f"{folder}/{name}"), df), name
    p = fits["ordinal"].fit(df).transform(df).select(vector_to_array("probability").alias("p"))
    assert p.filter(F.abs(F.aggregate("p", F.lit(0.0), lambda a, v: a + v) - 1) > 1e-9).count() == 0
    with pytest.raises(ValueError):
        M.StackedClassifier(bases=[], meta=forest)


def test_search_ablation_and_suite(data, spark):
    df = data[0]
    train, test = X.load(df, "label", ["c_absent"], ["id"])
    assert train.count() == 480 and test.count() == 120
    best, metrics, model = X.search(train, test, lambda s: M.Ridge(**s), {"alpha": ("log", 0.1, 10.0)}, key=["id"], trials=2, sample=200)
    assert 0.1 <= best["alpha"] <= 10 and metrics.first().r2 > 0.8
    bare = lambda t: t.drop("features")
    abl = {r.name: r.r2 for r in X.ablation(bare(train), bare(test), {"all": ["a", "b", "c"], "one": ["b"]}, lambda: M.Ridge(alpha=1.0)).collect()}
    assert abl["all"] > abl["one"]
    runs = {n: (lambda n=n, a=a: X.run_regression(n, train, test, [M.Ridge(alpha=a)])) for n, a in (("weak", 1e5), ("good", 1.0))}
    assert [r.name for r in X.run_suite(runs, "r2").collect()] == ["good", "weak"]
    forest = RandomForestRegressor(numTrees=5, seed=1).fit(train)
    assert X.importance(spark, forest, ["a", "b", "c"]).first().feature == "a"


def test_early_stop_is_independent_of_an_outer_hash_split(data):
    from pyspark.ml.regression import GBTRegressor
    from lateline.operators.sampling import train_test
    train, _ = train_test(data[0], 42, ["id"], 0.2, exact=False)
    m = M.EarlyStopped(booster=GBTRegressor(maxIter=5, seed=1), keyCols=["id"]).fit(train)
    assert 1 <= m.getNumTrees <= 5


def test_stacked_fits_pass_over_cached_rows(data, spark):
    df, _, _ = data
    plans = []

    class Seen(M.Ridge):
        def _fit(self, rows):
            plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
            return super()._fit(rows)

    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    written = spark.createDataFrame(df.rdd, df.schema)
    M.StackedRegressor(bases=[Seen(alpha=1.0)], meta=Seen(alpha=1.0), folds=2, keyCols=["id"]).fit(written)
    assert len(plans) == 4 and all("InMemoryRelation" in p for p in plans)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
