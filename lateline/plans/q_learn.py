"""Registered queries: feature stages, models and experiments."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from ..functions import timeparts as P
from ..learn import experiment as X
from ..learn import features as E
from ..learn import models as M
from ..operators import metrics as K
from ..operators.windows import with_previous
from ..session import checkpoint
from .registry import query, table

BINS = [5.0, 20.0, 60.0]
KEY = ["event_id"]
_MD5 = "CAST('0x' || substr(md5(concat_ws('|', '{s}', CAST(event_id AS VARCHAR))), 1, 8) AS BIGINT)"
_TEST = f"({_MD5.format(s=42)} / 4294967296.0 < 0.2)"


def _r(c, n=6):
    return F.round(c, n)


def _events(spark, d):
    return table(spark, d, "events")


# --- feature stages -------------------------------------------------------------------------------

@query("e01_calendar_parts", """
SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS dow, CAST(month(ts) AS INTEGER) AS month FROM events""")
def _(spark, d):
    return E.CalendarParts(timeCol="ts").transform(_events(spark, d).select("event_id", "ts"))


@query("e02_wind_mean", "SELECT event_id, (value + CAST(user_id AS DOUBLE)) / 2 AS wind FROM events")
def _(spark, d):
    e = _events(spark, d).selectExpr("event_id", "value as wind_speed", "cast(user_id as double) as wind_gust")
    return E.WindMean().transform(e)


@query("e03_wind_direction", "SELECT event_id, round(sin(radians(value)), 6) AS wind_dir_sin, round(cos(radians(value)), 6) AS wind_dir_cos FROM events")
def _(spark, d):
    out = E.WindDirection().transform(_events(spark, d).selectExpr("event_id", "value as wind_dir"))
    return out.select("event_id", *[_r(F.col(c)).alias(c) for c in ("wind_dir_sin", "wind_dir_cos")])


@query("e04_weather_signs", """
WITH w AS (SELECT event_id, value AS t, CAST(user_id AS DOUBLE) AS v, CASE WHEN event_type = 'view' THEN NULL ELSE value / 50 END AS p,
  CASE WHEN event_type = 'click' THEN value ELSE 0 END AS s FROM events)
SELECT event_id, round(t - 0.7 * v, 6) AS wind_chill, CAST(coalesce(p > 1.0, false) OR s > 0 AS TINYINT) AS adverse_weather FROM w""")
def _(spark, d):
    w = _events(spark, d).selectExpr(
        "event_id", "value as temperature", "cast(user_id as double) as wind_speed",
        "case when event_type = 'view' then null else value / 50 end as precipitation",
        "case when event_type = 'click' then value else 0D end as snow_depth")
    return E.WeatherSigns().transform(w).select("event_id", _r(F.col("wind_chill")).alias("wind_chill"), "adverse_weather")


@query("e05_rush_hour_stress", """
SELECT event_id, CAST(hour(ts) BETWEEN 7 AND 9 OR hour(ts) BETWEEN 16 AND 19 AS TINYINT) AS is_rush_hour,
  CAST((hour(ts) BETWEEN 7 AND 9 OR hour(ts) BETWEEN 16 AND 19) AND value > 1.0 AS TINYINT) AS weather_rush_hour_stress FROM events""")
def _(spark, d):
    w = _events(spark, d).selectExpr("event_id", "ts as timestamp", "value as precipitation", "0D as snow_depth")
    return E.RushHourStress().transform(w).select("event_id", "is_rush_hour", "weather_rush_hour_stress")


_SEEN = "WITH f AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY min({k}), o_orderpriority) - 1 AS code FROM orders WHERE o_orderpriority <> '2-HIGH' GROUP BY o_orderpriority)"


@query("e06_first_appearance_codes", _SEEN.format(k="o_orderkey") + """
SELECT o_orderkey, CAST(coalesce(code, (SELECT count(*) FROM f)) AS INTEGER) AS o_orderpriority FROM orders LEFT JOIN f ON o_orderpriority = v""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    m = E.CategoryCodes(inputCols=["o_orderpriority"], orderCol="o_orderkey").fit(o.filter("o_orderpriority <> '2-HIGH'"))
    return m.transform(o)


@query("e06_alphabetical_codes", """
WITH f AS (SELECT c_name AS v, row_number() OVER (ORDER BY c_name) - 1 AS code FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY c_name)
SELECT c_custkey, CAST(coalesce(code, (SELECT count(*) FROM f)) AS INTEGER) AS c_name FROM customer LEFT JOIN f ON c_name = v""")
def _(spark, d):
    c = table(spark, d, "customer")
    m = E.CategoryCodes(inputCols=["c_name"]).fit(c.filter("c_mktsegment <> 'BUILDING'"))
    return m.transform(c.select("c_custkey", "c_name"))


@query("j09_encoder_lookup", _SEEN.format(k="o_custkey") + """
SELECT o_orderkey, CAST(coalesce(code, (SELECT count(*) FROM f)) AS INTEGER) AS o_orderpriority FROM orders LEFT JOIN f ON o_orderpriority = v""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    # Customers repeat, so first appearances tie here and the text decides.
    m = E.CategoryCodes(inputCols=["o_orderpriority"], orderCol="o_custkey").fit(o.filter("o_orderpriority <> '2-HIGH'"))
    return m.transform(o).select("o_orderkey", "o_orderpriority")


_MEANS = """WITH tr AS (SELECT * FROM events WHERE event_type <> 'view'), g AS (SELECT event_type, hour(ts) AS h, avg(value) AS m FROM tr GROUP BY 1, 2)
SELECT event_id, round(coalesce(m, (SELECT avg(value) FROM tr)), 6) AS hist_mean_delay FROM events e LEFT JOIN g ON e.event_type = g.event_type AND hour(e.ts) = g.h"""


@query("e07_historical_mean", _MEANS)
def _(spark, d):
    e = _events(spark, d).select("event_id", "event_type", F.hour("ts").alias("hour"), "value")
    m = E.HistoricalMean(keyCols=["event_type", "hour"], labelCol="value").fit(e.filter("event_type <> 'view'"))
    return m.transform(e).select("event_id", _r(F.col("hist_mean_delay")).alias("hist_mean_delay"))


@query("j10_group_mean_lookup", """
WITH tr AS (SELECT * FROM lineitem WHERE l_returnflag = 'A'), g AS (SELECT l_suppkey, avg(l_quantity) AS m FROM tr WHERE l_discount < 0.02 GROUP BY l_suppkey)
SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, round(coalesce(m, (SELECT avg(l_quantity) FROM tr WHERE l_discount < 0.02)), 6) AS mean
FROM lineitem LEFT JOIN g USING (l_suppkey)""")
def _(spark, d):
    li = table(spark, d, "lineitem")
    m = E.HistoricalMean(keyCols=["l_suppkey"], labelCol="l_quantity", outputCol="mean").fit(li.filter("l_returnflag = 'A' and l_discount < 0.02"))
    return m.transform(li).select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", _r(F.col("mean")).alias("mean"))


@query("e08_standardize", """
SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), 6) AS value, 0.0::DOUBLE AS flat FROM events""")
def _(spark, d):
    e = _events(spark, d).selectExpr("event_id", "value", "3D as flat")
    return E.Standardize(inputCols=["value", "flat"]).fit(e).transform(e).withColumn("value", _r(F.col("value")))


@query("e09_products", """
SELECT event_id, a, b, round(a * a, 4) AS "a^2", round(a * b, 4) AS "a b", round(b * b, 4) AS "b^2" FROM (SELECT event_id, value AS a, CAST(user_id AS DOUBLE) AS b FROM events)""")
def _(spark, d):
    e = _events(spark, d).selectExpr("event_id", "value as a", "cast(user_id as double) as b")
    out = E.Products(inputCols=["a", "b"], degree=2).transform(e)
    return out.select("event_id", "a", "b", *[_r(F.col(f"`{c}`"), 4).alias(c) for c in ("a^2", "a b", "b^2")])


@query("e10_products_and_waves", """
SELECT event_id, a, round(a * a, 4) AS "a^2", round(sin(a), 6) AS a_sin_1, round(cos(a), 6) AS a_cos_1, round(sin(2 * a), 6) AS a_sin_2, round(cos(2 * a), 6) AS a_cos_2
FROM (SELECT event_id, value AS a FROM events)""")
def _(spark, d):
    out = E.ProductsAndWaves(inputCols=["a"], degree=2, waves=2).transform(_events(spark, d).selectExpr("event_id", "value as a"))
    return out.select("event_id", "a", _r(F.col("`a^2`"), 4).alias("a^2"), *[_r(F.col(c)).alias(c) for c in ("a_sin_1", "a_cos_1", "a_sin_2", "a_cos_2")])


@query("e11_waves", """
SELECT event_id, round(sin(value), 6) AS value_sin1, round(cos(value), 6) AS value_cos1, round(sin(2 * value), 6) AS value_sin2, round(cos(2 * value), 6) AS value_cos2,
  round(sin(3 * value), 6) AS value_sin3, round(cos(3 * value), 6) AS value_cos3 FROM events""")
def _(spark, d):
    out = E.Waves(inputCols=["value"], waves=3).transform(_events(spark, d).select("event_id", "value"))
    return out.select("event_id", *[_r(F.col(c)).alias(c) for c in out.columns if c != "event_id"])


def _vec(spark, d, n=8):
    return table(spark, d, "embeddings").select(
        "vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(n)])


@query("e12_principal_parts")
def _(spark, d):
    e = _vec(spark, d)
    cols = [f"x{i}" for i in range(8)]
    out = E.PrincipalParts(inputCols=cols, variance=0.8).fit(e).transform(e)
    return out.select("vec_id", *[_r(F.abs(F.col(c))).alias(c) for c in out.columns if c.startswith("pc")])


# For two columns the principal variances have a closed form, so the fitted parts can be checked.
@query("e12_principal_variances", """
WITH m AS (SELECT var_samp(embedding[1]::DOUBLE) AS a, var_samp(embedding[2]::DOUBLE) AS c, covar_samp(embedding[1]::DOUBLE, embedding[2]::DOUBLE) AS b FROM embeddings)
SELECT round((a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b), 8) AS v1, round((a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b), 8) AS v2, 0.0::DOUBLE AS mean1 FROM m""")
def _(spark, d):
    e = _vec(spark, d, 2)
    out = E.PrincipalParts(inputCols=["x0", "x1"], k=2).fit(e).transform(e)
    return out.agg(_r(F.var_samp("pc1"), 8).alias("v1"), _r(F.var_samp("pc2"), 8).alias("v2"), F.abs(_r(F.avg("pc1"), 8)).alias("mean1"))


@query("e13_kernel_features")
def _(spark, d):
    e = _vec(spark, d, 4)
    out = E.KernelFeatures(inputCols=[f"x{i}" for i in range(4)], keyCols=["vec_id"], landmarks=20).fit(e).transform(e)
    return out.select("vec_id", *[_r(F.col(f"nys{i}")).alias(f"nys{i}") for i in range(1, 21)])


@query("e14_previous_delay", """
SELECT event_id, round(CAST(CAST(coalesce(lag(value) OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY ts), (SELECT median(value) FROM events)) AS FLOAT) AS DOUBLE), 3) AS prev_stop_delay FROM events""")
def _(spark, d):
    e = _events(spark, d).selectExpr("event_id", "ts as timestamp", "user_id as trip_id", "value as arrival_delay_s")
    out = E.PreviousDelay().fit(e).transform(e)
    return out.select("event_id", _r(F.col("prev_stop_delay").cast("double"), 3).alias("prev_stop_delay"))


_CLS = "(CAST(value > 5 AS INTEGER) + CAST(value > 20 AS INTEGER) + CAST(value > 60 AS INTEGER))"


@query("e15_class_contract", f"""
SELECT event_id, CAST({_CLS} AS DOUBLE) AS label, CASE {_CLS} WHEN 0 THEN -25.0::DOUBLE WHEN 1 THEN 12.5 WHEN 2 THEN 40.0 ELSE 110.0 END AS delay FROM events""")
def _(spark, d):
    e = E.DelayClass(inputCol="value", bins=BINS).transform(_events(spark, d))
    return E.ClassToDelay(inputCol="label", bins=BINS).transform(e).select("event_id", "label", "delay")


@query("e16_fit_on_train_only", f"""
WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM events WHERE NOT {_TEST})
SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, round((value - m) / sd, 6) AS value FROM events, s WHERE {_TEST}""")
def _(spark, d):
    from ..operators.sampling import train_test
    train, test = train_test(_events(spark, d).select("event_id", "ts", "value"), 42, KEY, 0.2, exact=False)
    chain = Pipeline(stages=[E.CalendarParts(timeCol="ts"), E.Standardize(inputCols=["value"])])
    return chain.fit(train).transform(test).select("event_id", "hour", _r(F.col("value")).alias("value"))


# --- models ---------------------------------------------------------------------------------------

def _rows(spark, d):
    """Event rows with calendar, previous value and position; the value is the delay to predict."""
    e = _events(spark, d).select("event_id", "ts", "user_id", "event_type", "value", P.service_date("ts").alias("day"))
    e = with_previous(e, ["user_id"], ["ts"], lags={"prev": "value"}, index="pos", chunk=F.unix_date("day"))
    e = E.CalendarParts(timeCol="ts").transform(e.withColumn("prev", F.coalesce("prev", F.lit(20.0))))
    k = F.col("user_id").cast("double")
    return e.select("event_id", "event_type", "hour", "dow", "pos", "prev", k.alias("user"),
                    (F.col("value") + F.col("prev") * 0.5 + F.col("hour")).alias("label"))


FEATURES = ["hour", "dow", "pos", "prev", "user"]


def _split(spark, d):
    from ..operators.sampling import train_test
    # Read once per fit and fold; the written rows need no release.
    rows = checkpoint(X.vectors(FEATURES).transform(_rows(spark, d)))
    return train_test(rows, 42, KEY, 0.2, exact=False)


def _scored(model, test):
    return model.transform(test).select("event_id", _r(F.col("prediction"), 4).alias("prediction"), _r(F.col("label"), 4).alias("label"))


# One feature and an intercept: w = Sxy / (Sxx + alpha), b = mean(y) - w mean(x).
@query("m01_ridge_one_feature", """
WITH s AS (SELECT regr_sxy(l_extendedprice, l_quantity) / (regr_sxx(l_extendedprice, l_quantity) + 5000.0) AS w, avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem)
SELECT l_orderkey, l_partkey, l_linenumber, round(my + w * (l_quantity - mx), 3) AS prediction FROM lineitem, s""")
def _(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_extendedprice", "label")
    rows = X.vectors(["l_quantity"]).transform(li)
    return M.Ridge(alpha=5000.0).fit(rows).transform(rows).select("l_orderkey", "l_partkey", "l_linenumber", _r(F.col("prediction"), 3).alias("prediction"))


@query("m01_ridge_two_features", """
WITH s AS (SELECT var_pop(l_quantity) * count(*) + 5000.0 AS a, var_pop(l_linenumber) * count(*) + 5000.0 AS c, covar_pop(l_quantity, l_linenumber) * count(*) AS b,
  covar_pop(l_quantity, l_extendedprice) * count(*) AS p, covar_pop(l_linenumber, l_extendedprice) * count(*) AS q FROM lineitem)
SELECT round((c * p - b * q) / (a * c - b * b), 4) AS w_quantity, round((a * q - b * p) / (a * c - b * b), 4) AS w_line FROM s""")
def _(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_extendedprice", "label")
    rows = X.vectors(["l_quantity", "l_linenumber"]).transform(li)
    w = M.Ridge(alpha=5000.0).fit(rows).coefficients
    return rows.agg(F.lit(round(float(w[0]), 4)).alias("w_quantity"), F.lit(round(float(w[1]), 4)).alias("w_line"))


@query("m02_boosted_early_stop")
def _(spark, d):
    train, test = _split(spark, d)
    return _scored(M.EarlyStopped(booster=GBTRegressor(maxIter=10, maxDepth=4, seed=42), keyCols=KEY).fit(train), test)


@query("m03_growing_forest")
def _(spark, d):
    train, test = _split(spark, d)
    forest = RandomForestRegressor(maxDepth=6, seed=42)
    return _scored(M.GrowingForest(forest=forest, keyCols=KEY, sizes=[5.0, 10.0, 20.0]).fit(train), test)


def _class_split(spark, d):
    train, test = _split(spark, d)
    enc = E.DelayClass(inputCol="label", outputCol="label", bins=[25.0, 60.0])
    return enc.transform(train), enc.transform(test)


@query("m04_boosted_classes")
def _(spark, d):
    train, test = _class_split(spark, d)
    return _scored(M.boosted_classifier(maxIter=5, maxDepth=3, seed=42, parallelism=2).fit(train), test)


@query("m05_forest_classes")
def _(spark, d):
    train, test = _class_split(spark, d)
    return _scored(M.forest_classifier(numTrees=10, maxDepth=5, seed=42).fit(train), test)


@query("m06_logistic_classes")
def _(spark, d):
    train, test = _class_split(spark, d)
    return _scored(M.logistic(l1_share=0.5, strength=0.001, max_iter=20).fit(train), test)


@query("m07_perceptron_classes")
def _(spark, d):
    train, test = _class_split(spark, d)
    return _scored(M.perceptron(len(FEATURES), 3, hidden=(16, 8), maxIter=20, seed=42).fit(train), test)


def _tree(n=5):
    return RandomForestRegressor(numTrees=n, maxDepth=5, seed=42)


@query("m08_stacked_regressor")
def _(spark, d):
    train, test = _split(spark, d)
    return _scored(M.StackedRegressor(bases=[M.Ridge(alpha=1.0), _tree()], meta=M.Ridge(alpha=1.0), folds=3, keyCols=KEY).fit(train), test)


@query("m09_residual_stack")
def _(spark, d):
    train, test = _split(spark, d)
    return _scored(M.ResidualStack(first=M.Ridge(alpha=1.0), second=_tree(), folds=3, keyCols=KEY).fit(train), test)


# A log-target ridge on one feature is closed-form too.
@query("m10_log_target", """
WITH s AS (SELECT regr_sxy(ln(value + 1), CAST(user_id AS DOUBLE)) / (regr_sxx(ln(value + 1), CAST(user_id AS DOUBLE)) + 1.0) AS w, avg(user_id) AS mx, avg(ln(value + 1)) AS my FROM events)
SELECT event_id, round(exp(my + w * (user_id - mx)) - 1, 6) AS prediction FROM events, s""")
def _(spark, d):
    rows = X.vectors(["user_id"]).transform(_events(spark, d).withColumnRenamed("value", "label"))
    return M.LogTarget(model=M.Ridge(alpha=1.0)).fit(rows).transform(rows).select("event_id", _r(F.col("prediction")).alias("prediction"))


@query("m11_by_class")
def _(spark, d):
    train, test = _split(spark, d)
    clf = RandomForestClassifier(numTrees=5, maxDepth=5, seed=42)
    return _scored(M.ByClass(classifier=clf, regressor=M.Ridge(alpha=1.0), bins=[25.0, 60.0]).fit(train), test)


@query("m12_ordinal_regressor")
def _(spark, d):
    train, test = _split(spark, d)
    return _scored(M.Ordinal(model=LogisticRegression(maxIter=20), bins=[25.0, 60.0, 120.0], expected=True).fit(train), test)


@query("m13_ordinal_classifier")
def _(spark, d):
    train, test = _class_split(spark, d)
    return _scored(M.Ordinal(model=GBTClassifier(maxIter=5, maxDepth=3, seed=42)).fit(train), test)


@query("m14_stacked_classifier")
def _(spark, d):
    train, test = _class_split(spark, d)
    bases = [RandomForestClassifier(numTrees=5, maxDepth=5, seed=42), LogisticRegression(maxIter=10)]
    return _scored(M.StackedClassifier(bases=bases, meta=LogisticRegression(maxIter=10), folds=3, keyCols=KEY).fit(train), test)


@query("m15_classifier_with_own_stages")
def _(spark, d):
    from ..operators.sampling import train_test
    train, test = train_test(_rows(spark, d), 42, KEY, 0.2, exact=False)
    inner = Pipeline(stages=[E.Waves(inputCols=["hour"], waves=2), E.Standardize(inputCols=["prev", "user"]),
                             X.vectors(["hour_sin1", "hour_cos1", "hour_sin2", "hour_cos2", "dow", "pos", "prev", "user"]),
                             LogisticRegression(maxIter=15)])
    outer = Pipeline(stages=[E.DelayClass(inputCol="label", outputCol="label", bins=[25.0, 60.0]), inner])
    return _scored(outer.fit(train), test)


@query("m16_search")
def _(spark, d):
    train, test = _split(spark, d)
    space = {"alpha": ("log", 0.01, 100.0)}
    _, metrics, _ = X.search(train, test, lambda s: M.Ridge(**s), space, key=KEY, trials=3, sample=2000)
    return metrics


@query("m17_experiment")
def _(spark, d):
    train, test = _split(spark, d)
    return X.run_regression("ridge", train, test, [M.Ridge(alpha=1.0)])


@query("m18_suite_leaderboard")
def _(spark, d):
    train, test = _split(spark, d)
    runs = {
        "ridge": lambda: X.run_regression("ridge", train, test, [M.Ridge(alpha=1.0)]),
        "forest": lambda: X.run_regression("forest", train, test, [_tree()]),
        "log_ridge": lambda: X.run_regression("log_ridge", train, test, [M.LogTarget(model=M.Ridge(alpha=1.0))]),
    }
    return X.run_suite(runs, "r2")


@query("m19_ablation")
def _(spark, d):
    train, test = (t.drop("features") for t in _split(spark, d))
    sets = {"all": FEATURES, "no_lag": [c for c in FEATURES if c != "prev"], "position_only": ["pos"]}
    return X.ablation(train, test, sets, lambda: M.Ridge(alpha=1.0))


@query("m20_batch_scoring")
def _(spark, d):
    train, test = _split(spark, d)
    scored = M.Ridge(alpha=1.0).fit(train).transform(test.unionByName(train))
    enc = lambda c: E.DelayClass(inputCol=c, outputCol=c, bins=[25.0, 60.0])
    return K.class_summary(enc("prediction").transform(enc("label").transform(scored)))


@query("m22_importance")
def _(spark, d):
    train, _ = _split(spark, d)
    model = _tree(10).fit(train)
    ranked = X.importance(spark, model, FEATURES)
    return ranked.withColumn("importance", _r(F.col("importance")))


@query("m06_probabilities")
def _(spark, d):
    train, test = _class_split(spark, d)
    p = vector_to_array(F.col("probability"))
    out = M.logistic(balanced=False, max_iter=20).fit(train).transform(test).withColumn("p", p)
    return out.select("event_id", *[_r(F.get("p", F.lit(i)), 4).alias(f"p{i}") for i in range(3)])
