"""Registered queries whose models have a closed form, so plain SQL must give the same predictions.

A tree of depth one on a 0/1 column predicts each side's mean or likeliest class, a logistic fit on it each side's share,
and a ridge on one column is two sums. All of them run over all rows.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from ..learn import boosting as B
from ..learn import experiment as X
from ..learn import features as E
from ..learn import models as M
from ..operators.sampling import train_test
from .q_learn import _MD5, _TEST, BINS, KEY, _r
from .q_streaming import scratch
from .registry import query, table

_X = "CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
_E = f"e AS (SELECT event_id, {_X} AS x, CAST(user_id AS DOUBLE) AS u, value AS y FROM events)"
_CLASS = "CASE WHEN y <= 5 THEN 0 WHEN y <= 20 THEN 1 WHEN y <= 60 THEN 2 ELSE 3 END"
_HELD = f"({_MD5.format(s='42/slice')} / 4294967296.0 < 0.1)"


def _rows(spark, d, *columns):
    e = table(spark, d, "events").select(
        "event_id", F.when(F.col("event_type") == "error", 1.0).otherwise(0.0).alias("x"), F.col("user_id").cast("double").alias("u"),
        F.col("value").alias("label"))
    return X.vectors(columns).transform(e)


def _classes(spark, d):
    return E.DelayClass(inputCol="label", outputCol="label", bins=BINS).transform(_rows(spark, d, "x"))


def _told(model, rows, digits=4):
    return model.transform(rows).select("event_id", _r(F.col("prediction"), digits).alias("prediction"))


@query("m02_boosted_stump", f"""
WITH {_E}, m AS (SELECT x, avg(y) AS p FROM e WHERE NOT {_HELD} GROUP BY x) SELECT event_id, round(p, 4) AS prediction FROM e JOIN m USING (x)""")
def _(spark, d):
    rows = _rows(spark, d, "x")
    return _told(M.EarlyStopped(booster=GBTRegressor(maxIter=1, maxDepth=1, seed=42), keyCols=KEY).fit(rows), rows)


# Of the three ways to part known zeros, known ones and missing values in two, the one that explains most.
@query("m02_missing_sides", """
WITH e AS (SELECT event_id, CASE event_type WHEN 'view' THEN NULL WHEN 'error' THEN 1.0 ELSE 0.0 END AS x, value AS y FROM events),
g AS (SELECT CAST(count(*) FILTER (x = 0) AS DOUBLE) AS n0, sum(y) FILTER (x = 0) AS s0, CAST(count(*) FILTER (x = 1) AS DOUBLE) AS n1, sum(y) FILTER (x = 1) AS s1,
  CAST(count(*) FILTER (x IS NULL) AS DOUBLE) AS nm, sum(y) FILTER (x IS NULL) AS sm FROM e),
w AS (SELECT (s0 + sm) * (s0 + sm) / (n0 + nm) + s1 * s1 / n1 AS l, s0 * s0 / n0 + (s1 + sm) * (s1 + sm) / (n1 + nm) AS r, (s0 + s1) * (s0 + s1) / (n0 + n1) + sm * sm / nm AS a FROM g),
p AS (SELECT event_id, y, CASE WHEN l >= greatest(r, a) THEN coalesce(x = 1, false) WHEN r >= a THEN coalesce(x = 0, false) ELSE x IS NULL END AS side FROM e, w)
SELECT event_id, round(avg(y) OVER (PARTITION BY side), 4) AS prediction FROM p""")
def _(spark, d):
    rows = table(spark, d, "events").select(
        "event_id", F.when(F.col("event_type") == "error", 1.0).when(F.col("event_type") != "view", 0.0).alias("x"), F.col("value").alias("label"))
    return _told(B.with_missing(["x"], GBTRegressor(maxIter=1, maxDepth=1, seed=42), flags=False).fit(rows), rows)


@query("m02_missing_medians", """
WITH e AS (SELECT event_id, CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'error' THEN CAST('nan' AS DOUBLE) ELSE CAST(user_id % 7 AS DOUBLE) END AS x FROM events),
k AS (SELECT event_id, CASE WHEN NOT isnan(x) THEN x END AS x FROM e), m AS (SELECT quantile_disc(x, 0.5) AS m FROM k)
SELECT event_id, coalesce(x, m) AS x, CAST(x IS NULL AS INTEGER) AS x_missing FROM k, m""")
def _(spark, d):
    rows = table(spark, d, "events").select(
        "event_id", F.when(F.col("event_type") == "error", float("nan")).when(F.col("event_type") != "view", (F.col("user_id") % 7).cast("double")).alias("x"))
    out = B.MissingSides(inputCols=["x"], how="median").fit(rows).transform(rows)
    return out.select("event_id", "x", F.col("x_missing").cast("int").alias("x_missing"))


@query("m03_single_split_forest", f"WITH {_E}, m AS (SELECT x, avg(y) AS p FROM e GROUP BY x) SELECT event_id, round(p, 4) AS prediction FROM e JOIN m USING (x)")
def _(spark, d):
    rows = _rows(spark, d, "x")
    forest = RandomForestRegressor(maxDepth=1, bootstrap=False, featureSubsetStrategy="all", seed=42)
    return _told(M.GrowingForest(forest=forest, keyCols=KEY, sizes=[1.0, 2.0]).fit(rows), rows)


# With balanced weights a side's class is the one with most rows in proportion to its size.
_BALANCED = f"""
WITH {_E}, c AS (SELECT *, {_CLASS} AS k FROM e), n AS (SELECT k, count(*) AS n FROM c GROUP BY k),
s AS (SELECT x, k, count(*) / any_value(n) AS w FROM c JOIN n USING (k) GROUP BY x, k), b AS (SELECT x, arg_max(k, w) AS p FROM s GROUP BY x)
SELECT event_id, CAST(p AS DOUBLE) AS prediction FROM e JOIN b USING (x)"""


@query("m05_single_split_classes", _BALANCED)
def _(spark, d):
    rows = _classes(spark, d)
    model = M.forest_classifier(numTrees=1, maxDepth=1, bootstrap=False, featureSubsetStrategy="all", seed=42).fit(rows)
    return _told(model, rows)


@query("m04_boosted_stump_classes", _BALANCED)
def _(spark, d):
    rows = _classes(spark, d)
    return _told(M.boosted_classifier(maxIter=1, maxDepth=1, seed=42, parallelism=2).fit(rows), rows)


# One round from equal weighted shares: each side's score moves by step * (share - 1/K) / (1/K * (1 - 1/K)).
@query("m04_joint_round", f"""
WITH {_E}, c AS (SELECT *, {_CLASS} AS k FROM e), n AS (SELECT k, count(*) AS n FROM c GROUP BY k), t AS (SELECT count(*) AS classes FROM n),
s AS (SELECT x, k, count(*) / any_value(n) AS w FROM c JOIN n USING (k) GROUP BY x, k), a AS (SELECT x, sum(w) AS w FROM s GROUP BY x),
f AS (SELECT a.x, n.k, exp(0.5 * (coalesce(s.w, 0) / a.w - 1.0 / classes) / (1.0 / classes * (1 - 1.0 / classes))) AS f
  FROM a CROSS JOIN n CROSS JOIN t LEFT JOIN s ON s.x = a.x AND s.k = n.k),
p AS (SELECT x, k, f / sum(f) OVER (PARTITION BY x) AS p FROM f),
b AS (SELECT x, CAST(arg_max(k, p) AS DOUBLE) AS prediction, {", ".join(f"max(p) FILTER (k = {k}) AS p{k}" for k in range(4))} FROM p GROUP BY x)
SELECT event_id, prediction, {", ".join(f"round(p{k}, 4) AS p{k}" for k in range(4))} FROM e JOIN b USING (x)""")
def _(spark, d):
    rows = _classes(spark, d)
    model = B.BoostedClasses(keyCols=KEY, slice=0.0, rounds=1, depth=1, step=0.5).fit(rows)
    return model.transform(rows).select("event_id", "prediction", *[_r(F.get("probability", F.lit(k)), 4).alias(f"p{k}") for k in range(4)])


@query("m06_saturated_logistic", f"""
WITH {_E}, m AS (SELECT x, avg(CASE WHEN y > 20 THEN 1.0 ELSE 0.0 END) AS p FROM e GROUP BY x) SELECT event_id, round(p, 3) AS p FROM e JOIN m USING (x)""")
def _(spark, d):
    rows = _rows(spark, d, "x").withColumn("label", (F.col("label") > 20).cast("double"))
    model = LogisticRegression(maxIter=200, tol=1e-12).fit(rows)
    return model.transform(rows).select("event_id", _r(F.get(vector_to_array("probability"), F.lit(1)), 3).alias("p"))


_SHARES = f"""{_E}, c AS (SELECT *, {_CLASS} AS k FROM e),
s AS (SELECT x, avg(CASE WHEN k = 0 THEN 1.0 ELSE 0 END) AS p0, avg(CASE WHEN k = 1 THEN 1.0 ELSE 0 END) AS p1,
  avg(CASE WHEN k = 2 THEN 1.0 ELSE 0 END) AS p2, avg(CASE WHEN k = 3 THEN 1.0 ELSE 0 END) AS p3 FROM c GROUP BY x)"""


@query("m12_ordinal_shares", f"WITH {_SHARES} SELECT event_id, round(-25.0 * p0 + 12.5 * p1 + 40.0 * p2 + 110.0 * p3, 1) AS prediction FROM e JOIN s USING (x)")
def _(spark, d):
    rows = _rows(spark, d, "x")
    return _told(M.Ordinal(model=LogisticRegression(maxIter=200, tol=1e-12), bins=BINS, expected=True).fit(rows), rows, 1)


@query("m13_ordinal_likeliest", f"""
WITH {_SHARES} SELECT event_id, CASE greatest(p0, p1, p2, p3) WHEN p0 THEN 0.0 WHEN p1 THEN 1.0 WHEN p2 THEN 2.0 ELSE 3.0 END::DOUBLE AS prediction FROM e JOIN s USING (x)""")
def _(spark, d):
    rows = _classes(spark, d)
    return _told(M.Ordinal(model=LogisticRegression(maxIter=200, tol=1e-12)).fit(rows), rows)


@query("m15_staged_likeliest", f"""
WITH {_SHARES} SELECT event_id, CASE greatest(p0, p1, p2, p3) WHEN p0 THEN 0.0 WHEN p1 THEN 1.0 WHEN p2 THEN 2.0 ELSE 3.0 END::DOUBLE AS prediction FROM e JOIN s USING (x)""")
def _(spark, d):
    rows = _rows(spark, d, "x").drop("features")
    inner = Pipeline(stages=[E.Standardize(inputCols=["x"]), X.vectors(["x"]), LogisticRegression(maxIter=200, tol=1e-12)])
    outer = Pipeline(stages=[E.DelayClass(inputCol="label", outputCol="label", bins=BINS), inner])
    return _told(outer.fit(rows), rows)


# Folds by the key's hash; a ridge w = Sxy / (Sxx + 1), b = mean(y) - w mean(x) per fold, and one more on what they predict.
_FOLDS = f"""{_E}, g AS (SELECT *, {_MD5.format(s=42)} % 3 AS f FROM e),
fit AS (SELECT k.f, regr_sxy(y, u) / (regr_sxx(y, u) + 1.0) AS w, avg(u) AS mx, avg(y) AS my FROM (SELECT DISTINCT f FROM g) k JOIN g ON g.f <> k.f GROUP BY k.f),
oof AS (SELECT event_id, u, y, my + w * (u - mx) AS p FROM g JOIN fit USING (f)),
whole AS (SELECT regr_sxy(y, u) / (regr_sxx(y, u) + 1.0) AS w, avg(u) AS mx, avg(y) AS my FROM e)"""


@query("m08_stacked_ridges", f"""
WITH {_FOLDS}, meta AS (SELECT regr_sxy(y, p) / (regr_sxx(y, p) + 1.0) AS w, avg(p) AS mx, avg(y) AS my FROM oof)
SELECT event_id, round(meta.my + meta.w * (whole.my + whole.w * (u - whole.mx) - meta.mx), 4) AS prediction FROM e, meta, whole""")
def _(spark, d):
    rows = _rows(spark, d, "u")
    return _told(M.StackedRegressor(bases=[M.Ridge(alpha=1.0)], meta=M.Ridge(alpha=1.0), folds=3, keyCols=KEY).fit(rows), rows)


@query("m09_residual_ridges", f"""
WITH {_FOLDS}, two AS (SELECT regr_sxy(y - p, u) / (regr_sxx(y - p, u) + 1.0) AS w, avg(u) AS mx, avg(y - p) AS my FROM oof)
SELECT event_id, round(whole.my + whole.w * (u - whole.mx) + two.my + two.w * (u - two.mx), 4) AS prediction FROM e, whole, two""")
def _(spark, d):
    rows = _rows(spark, d, "u")
    return _told(M.ResidualStack(first=M.Ridge(alpha=1.0), second=M.Ridge(alpha=1.0), folds=3, keyCols=KEY).fit(rows), rows)


@query("m11_by_likeliest_class", f"""
WITH {_E}, c AS (SELECT *, CASE WHEN y <= 20 THEN 0 ELSE 1 END AS k FROM e),
b AS (SELECT x, CASE WHEN avg(k) > 0.5 THEN 1 ELSE 0 END AS k FROM c GROUP BY x),
r AS (SELECT k, regr_sxy(y, x) / (regr_sxx(y, x) + 1.0) AS w, avg(x) AS mx, avg(y) AS my FROM c GROUP BY k)
SELECT event_id, round(my + w * (x - mx), 4) AS prediction FROM e JOIN b USING (x) JOIN r USING (k)""")
def _(spark, d):
    rows = _rows(spark, d, "x")
    clf = RandomForestClassifier(numTrees=1, maxDepth=1, bootstrap=False, featureSubsetStrategy="all", seed=42)
    return _told(M.ByClass(classifier=clf, regressor=M.Ridge(alpha=1.0), bins=[20.0]).fit(rows), rows)


def _metrics(column: str, alpha: float, name: str) -> str:
    """SQL of a one-column ridge fitted on the training rows and judged on the others."""
    return f"""(WITH {_E}, w AS (SELECT regr_sxy(y, {column}) / (regr_sxx(y, {column}) + {alpha}) AS w, avg({column}) AS mx, avg(y) AS my FROM e WHERE NOT {_TEST}),
t AS (SELECT y, my + w * ({column} - mx) AS p FROM e, w WHERE {_TEST})
SELECT '{name}' AS name, count(*) AS n, round(avg((y - p) ** 2), 4) AS mse, round(sqrt(avg((y - p) ** 2)), 4) AS rmse,
  round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2 FROM t)"""


def _shown(df):
    return df.select("name", "n", _r(F.col("mse"), 4).alias("mse"), _r(F.col("rmse"), 4).alias("rmse"), _r(F.col("r2"), 6).alias("r2"))


def _halves(spark, d, *columns):
    return train_test(_rows(spark, d, *columns), 42, KEY, 0.2, exact=False)


@query("m16_search_all_rows", f"SELECT * REPLACE ('search' AS name) FROM {_metrics('u', 1.0, 'search')}")
def _(spark, d):
    train, test = _halves(spark, d, "u")
    _, metrics, _ = X.search(train, test, lambda s: M.Ridge(**s), {"alpha": ("choice", [1.0])}, key=KEY, trials=2)
    return _shown(metrics.withColumn("name", F.lit("search")))


@query("m17_ridge_experiment", f"SELECT * FROM {_metrics('u', 1.0, 'ridge')}")
def _(spark, d):
    train, test = _halves(spark, d, "u")
    return _shown(X.run_regression("ridge", train, test, [M.Ridge(alpha=1.0)]))


@query("m18_ridge_suite", f"SELECT * FROM {_metrics('u', 1.0, 'light')} UNION ALL SELECT * FROM {_metrics('u', 1e9, 'heavy')}")
def _(spark, d):
    train, test = _halves(spark, d, "u")
    runs = {n: (lambda n=n, a=a: X.run_regression(n, train, test, [M.Ridge(alpha=a)])) for n, a in (("light", 1.0), ("heavy", 1e9))}
    return _shown(X.run_suite(runs, "r2"))


@query("m19_single_column_ablation", f"SELECT * FROM {_metrics('u', 1.0, 'user')} UNION ALL SELECT * FROM {_metrics('x', 1.0, 'kind')}")
def _(spark, d):
    train, test = (t.drop("features") for t in _halves(spark, d, "u"))
    return _shown(X.ablation(train, test, {"user": ["u"], "kind": ["x"]}, lambda: M.Ridge(alpha=1.0)))


@query("m20_saved_scoring", f"""
WITH {_E}, w AS (SELECT regr_sxy(y, u) / (regr_sxx(y, u) + 1.0) AS w, avg(u) AS mx, avg(y) AS my FROM e) SELECT event_id, round(my + w * (u - mx), 4) AS prediction FROM e, w""")
def _(spark, d):
    rows = _rows(spark, d, "u").drop("features")
    at = scratch(spark)
    Pipeline(stages=[X.vectors(["u"]), M.Ridge(alpha=1.0)]).fit(rows).write().overwrite().save(at)
    return X.score(spark, at, rows).select("event_id", _r(F.col("prediction"), 4).alias("prediction"))


@query("m17_classification_experiment", f"""
WITH {_E}, c AS (SELECT event_id, x, CASE WHEN y <= 20 THEN 0 ELSE 1 END AS k FROM e),
b AS (SELECT x, CASE WHEN avg(k) > 0.5 THEN 1 ELSE 0 END AS p FROM c WHERE NOT {_TEST} GROUP BY x),
t AS (SELECT k, p FROM c JOIN b USING (x) WHERE {_TEST})
SELECT 'share' AS name, count(*) AS n, round(avg(CASE WHEN k = p THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM t""")
def _(spark, d):
    train, test = _halves(spark, d, "x")
    out = X.encode_then_classify("share", train, test, [LogisticRegression(maxIter=200, tol=1e-12)], "label", [20.0])
    return out.select("name", "n", _r(F.col("accuracy")).alias("accuracy"))


@query("m22_one_split_importance", "SELECT * FROM (VALUES ('x', 1.0::DOUBLE), ('constant', 0.0::DOUBLE)) t(feature, importance)")
def _(spark, d):
    rows = X.vectors(["x", "constant"]).transform(_rows(spark, d, "x").drop("features").withColumn("constant", F.lit(1.0)))
    forest = RandomForestRegressor(numTrees=1, maxDepth=1, bootstrap=False, featureSubsetStrategy="all", seed=42).fit(rows)
    return X.importance(spark, forest, ["x", "constant"]).select("feature", _r(F.col("importance")).alias("importance"))


@query("e13_one_landmark", f"""
WITH l AS (SELECT arg_min(value, md5(concat_ws('|', '42', CAST(event_id AS VARCHAR)))) AS v FROM events)
SELECT event_id, round(exp(-0.001 * (value - v) ** 2), 6) AS nys1 FROM events, l""")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    return (E.KernelFeatures(inputCols=["value"], keyCols=KEY, landmarks=1, gamma=0.001, seed=42).fit(e).transform(e)
            .select("event_id", _r(F.col("nys1")).alias("nys1")))


@query("w01_lag_null_order", """
SELECT event_id, lag(value) OVER w AS previous, CAST(row_number() OVER w - 1 AS INTEGER) AS place FROM (
  SELECT event_id, user_id % 3 AS k, value, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END AS t FROM events)
WINDOW w AS (PARTITION BY k ORDER BY t NULLS FIRST, event_id)""")
def _(spark, d):
    from ..operators.windows import with_previous
    e = table(spark, d, "events").select(
        "event_id", (F.col("user_id") % 3).alias("k"), "value", F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("t"))
    out = with_previous(e, ["k"], ["t", "event_id"], lags={"previous": "value"}, index="place", chunk=F.to_date("t"), hot_rows=50)
    return out.select("event_id", "previous", F.col("place").cast("int").alias("place"))


@query("e12_principal_null_rows", """
WITH v AS (SELECT event_id, coalesce(CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END, 0.0) AS a FROM events)
SELECT event_id, round(abs(a - (SELECT avg(a) FROM v)), 5) AS pc1 FROM v""")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("a"))
    return E.PrincipalParts(inputCols=["a"], k=1).fit(e).transform(e).select("event_id", _r(F.abs("pc1"), 5).alias("pc1"))


@query("j05_repeated_weather", """
WITH w AS (SELECT user_id AS station, max(value) AS v FROM events GROUP BY 1)
SELECT event_id, v AS temperature FROM events JOIN w ON station = user_id""")
def _(spark, d):
    from ..operators.joins import add_weather
    e = table(spark, d, "events")
    at = F.lit("2025-07-01 10:00:00").cast("timestamp_ntz")
    weather = e.select(F.col("user_id").cast("string").alias("station_id"), at.alias("timestamp"), F.col("value").alias("temperature"))
    fact = e.select("event_id", F.col("user_id").alias("stop_id"), F.lit("2025-07-01 12:15:00").cast("timestamp_ntz").alias("timestamp"))
    stations = e.select(F.col("user_id").alias("stop_id"), F.col("user_id").cast("string").alias("weather_station")).distinct()
    return add_weather(fact, stations, weather, columns=["temperature"]).select("event_id", "temperature")


@query("j05_whole_weather_rows", """
WITH w AS (SELECT user_id AS station, value AS t, -value AS p, event_id % 5 AS h FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY h DESC, t DESC) AS rn FROM w)
SELECT event_id, h AS humidity, t AS temperature, p AS pressure FROM events JOIN o ON station = user_id WHERE rn = 1""")
def _(spark, d):
    from ..operators.joins import add_weather
    e = table(spark, d, "events")
    at = F.lit("2025-07-01 10:00:00").cast("timestamp_ntz")
    weather = e.select(F.col("user_id").cast("string").alias("station_id"), at.alias("timestamp"), (F.col("event_id") % 5).alias("humidity"),
                       F.col("value").alias("temperature"), (-F.col("value")).alias("pressure"))
    fact = e.select("event_id", F.col("user_id").alias("stop_id"), F.lit("2025-07-01 12:15:00").cast("timestamp_ntz").alias("timestamp"))
    stations = e.select(F.col("user_id").alias("stop_id"), F.col("user_id").cast("string").alias("weather_station")).distinct()
    return add_weather(fact, stations, weather, columns=["humidity", "temperature", "pressure"]).select("event_id", "humidity", "temperature", "pressure")


@query("m07_separable_perceptron", f"WITH {_E} SELECT event_id, x AS prediction FROM e")
def _(spark, d):
    rows = _rows(spark, d, "x").withColumn("label", F.col("x"))
    return _told(M.StoppingPerceptron(keyCols=KEY, hidden=[3.0], block=5, most=60).fit(rows), rows)


# A tree of depth 0 gives one class to all rows, one of depth 1 tells the two sides apart and wins the race.
@query("m16_race_classes", _BALANCED)
def _(spark, d):
    rows = _classes(spark, d)
    build = lambda s: M.forest_classifier(numTrees=1, maxDepth=s["depth"], bootstrap=False, featureSubsetStrategy="all", seed=42)
    _, _, model, _ = X.race(rows, rows, build, {"depth": ("choice", [0, 1])}, key=KEY, trials=4, rungs=[0.5, 1.0], classify=True)
    return _told(model, rows)
