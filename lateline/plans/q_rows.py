"""Registered queries: scans, projections, filters and column functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import conditions as C
from ..functions import delays as D
from ..functions import timeparts as P
from ..operators import rows as R
from ..operators.aggregates import keyed_json, standard_score
from ..operators.quantiles import medians
from ..schema import SERVING_DEFAULTS
from ..sources.actuals import null_cells
from ..sources.tables import merge_tables, with_column_once
from ..sources.weather import hourly_rows, station_time, stations_from_json
from .registry import OBS_SQL, observations, query, table

BINS = [5.0, 20.0, 60.0]


def _r(c, n=6):
    return F.round(c, n)


def _events(spark, d):
    return table(spark, d, "events")


# --- scans ----------------------------------------------------------------------------------------

@query("s01_semicolon_cells", """
SELECT event_id, CASE WHEN event_type IN ('error') THEN NULL ELSE event_type END AS kind,
  CASE WHEN value < 1 THEN NULL ELSE CAST(value AS VARCHAR) END AS amount FROM events""")
def _(spark, d):
    line = F.concat_ws(
        ";", F.col("event_id").cast("string"), F.when(F.col("event_type") == "error", "NA").otherwise(F.col("event_type")),
        F.when(F.col("value") < 1, "").otherwise(F.col("value").cast("string")))
    cells = _events(spark, d).select(F.from_csv(line, "event_id string, kind string, amount string", {"sep": ";"}).alias("c"))
    return null_cells(cells.select("c.*")).withColumn("event_id", F.col("event_id").cast("bigint"))


@query("s03_declared_scan", "SELECT event_id, event_type, value FROM events")
def _(spark, d):
    declared = T.StructType([
        T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])
    return spark.read.schema(declared).parquet(f"{d}/events.parquet")


@query("s06_merge_parts", """
SELECT o_orderkey AS key, o_totalprice AS price, o_orderstatus AS status, NULL::DOUBLE AS quantity FROM orders
UNION ALL SELECT l_orderkey, l_extendedprice, NULL, l_quantity FROM lineitem""")
def _(spark, d):
    a = table(spark, d, "orders").selectExpr("o_orderkey as key", "o_totalprice as price", "o_orderstatus as status")
    b = table(spark, d, "lineitem").selectExpr("l_quantity as quantity", "l_extendedprice as price", "l_orderkey as key")
    return merge_tables([a, b])


@query("s08_features_and_target", "SELECT event_id, user_id, event_type, value AS target FROM events")
def _(spark, d):
    return R.drop_columns(_events(spark, d), ["props", "ts", "not_there"]).withColumnRenamed("value", "target")


@query("s09_station_features", """
SELECT 'c' || c_custkey AS station_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'c' || c_custkey ELSE c_name END AS name,
  c_acctbal AS lon, c_acctbal / 2 AS lat, CASE WHEN c_acctbal > 5000 THEN NULL ELSE 1.5::DOUBLE END AS alt
FROM customer WHERE c_mktsegment <> 'MACHINERY'""")
def _(spark, d):
    body = """to_json(named_struct('features', array(named_struct(
        'id', concat('c', c_custkey),
        'geometry', named_struct('coordinates', case when c_mktsegment = 'MACHINERY' then array(c_acctbal)
                     when c_acctbal > 5000 then array(c_acctbal, c_acctbal / 2) else array(c_acctbal, c_acctbal / 2, 1.5D) end),
        'properties', named_struct('title', case when c_mktsegment = 'BUILDING' then null else c_name end)))))"""
    return stations_from_json(table(spark, d, "customer").selectExpr(f"{body} as body"), "body").drop("asset_url")


@query("s10_hourly_arrays", """
WITH j AS (SELECT event_id, ts, value, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events), rows AS (
  SELECT event_id, date_trunc('minute', ts) AS timestamp, value AS t, k AS w FROM j
  UNION ALL SELECT event_id, date_trunc('minute', ts) + INTERVAL 1 HOUR, value + 1, NULL FROM j)
SELECT CAST(event_id AS VARCHAR) AS station_id, timestamp, round(t, 3) AS temperature, round(w / 3.6, 3) AS wind_speed,
  NULL::DOUBLE AS humidity FROM rows""")
def _(spark, d):
    minute = "replace(substring(cast({} as string), 1, 16), ' ', 'T')"
    hour_later = minute.format("(ts + interval '1' hour)")
    body = f"""to_json(named_struct('hourly', named_struct(
        'time', array({minute.format('ts')}, {hour_later}),
        'temperature_2m', array(value, value + 1),
        'wind_speed_10m', array(cast(get_json_object(props, '$.k') as double), null))), map('ignoreNullFields', 'false'))"""
    made = _events(spark, d).selectExpr("cast(event_id as string) as sid", f"{body} as body")
    h = hourly_rows(made, "body", "sid")
    return h.select("station_id", "timestamp", _r(F.col("temperature").cast("double"), 3).alias("temperature"),
                    _r(F.col("wind_speed").cast("double"), 3).alias("wind_speed"), F.col("humidity").cast("double").alias("humidity"))


@query("s11_station_time", """
SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN date_trunc('minute', ts)
  WHEN 'view' THEN date_trunc('minute', ts) WHEN 'signup' THEN date_trunc('hour', ts)
  ELSE date_trunc('minute', ts) END AS at FROM events""")
def _(spark, d):
    s = "cast(ts as string)"
    y, m, dd, hh, mi = (f"substring({s}, {a}, {b})" for a, b in ((1, 4), (6, 2), (9, 2), (12, 2), (15, 2)))
    text = f"""case event_type when 'error' then 'n/a' when 'click' then concat({y}, {m}, {dd}, {hh}, {mi})
        when 'view' then concat({dd}, '.', {m}, '.', {y}, ' ', {hh}, ':', {mi})
        when 'signup' then concat({y}, {m}, {dd}, {hh}) else concat({y}, '-', {m}, '-', {dd}, 'T', {hh}, ':', {mi}) end"""
    return _events(spark, d).selectExpr("event_id", f"{text} as t").select("event_id", station_time("t").alias("at"))


@query("s14_keyed_medians", """
SELECT event_type || '|' || CAST((isodow(ts) - 1) AS INTEGER) AS key, round(coalesce(median(value), 0), 6) AS value,
  round(coalesce(median(CASE WHEN event_type <> 'error' THEN CAST(user_id AS DOUBLE) END), 0), 6) AS user
FROM events GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY event_type, isodow(ts)"))
def _(spark, d):
    e = _events(spark, d).select(
        "event_type", P.day_of_week("ts").alias("dow"), "value",
        F.when(F.col("event_type") != "error", F.col("user_id").cast("double")).alias("user"))
    k = keyed_json(medians(e, ["event_type", "dow"], ["value", "user"]), ["event_type", "dow"], ["value", "user"])
    return k.select("key", *[_r(F.get_json_object("body", f"$.{c}").cast("double")).alias(c) for c in ("value", "user")])


@query("s15_add_column_once", "SELECT event_id, value, CAST(isodow(ts) - 1 AS INTEGER) AS dow FROM events")
def _(spark, d):
    e = with_column_once(_events(spark, d), "value", lambda x: x.withColumn("value", F.lit(-1.0)))
    e = with_column_once(e, "dow", lambda x: x.withColumn("dow", P.day_of_week("ts")))
    return e.select("event_id", "value", "dow")


# --- projections and filters ----------------------------------------------------------------------

@query("p01_rename_known", "SELECT event_id AS TRIP_ID, event_type AS PRODUCT_ID, value FROM events")
def _(spark, d):
    e = _events(spark, d).selectExpr("event_id as FAHRT_BEZEICHNER", "event_type as PRODUKT_ID", "value")
    from ..schema import RAW_HEADERS
    return R.rename_known(e, RAW_HEADERS)


@query("p02_keep_columns", "SELECT l_orderkey, l_suppkey, l_shipdate FROM lineitem")
def _(spark, d):
    return R.keep_columns(table(spark, d, "lineitem"), ["l_orderkey", "l_suppkey", "l_shipdate"])


@query("p03_drop_columns", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(spark, d):
    return R.drop_columns(table(spark, d, "orders"), ["o_orderstatus", "o_orderdate", "o_orderpriority", "absent"])


@query("p04_product_filter", "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = 'building'")
def _(spark, d):
    return R.only_product(table(spark, d, "customer"), "c_mktsegment", "Building").select("c_custkey", "c_mktsegment")


@query("p05_flags", f"""WITH o AS ({OBS_SQL})
SELECT trip_id, part_id, line_no, price, coalesce(lower(cancelled) IN ('true', '1'), false) AS text_flag, pass_code <> 0 AS number_flag,
  additional_trip AS bool_flag FROM o""")
def _(spark, d):
    return observations(spark, d).select(
        "trip_id", "part_id", "line_no", "price", C.flag("cancelled", "string").alias("text_flag"),
        C.flag("pass_code", "int").alias("number_flag"), C.flag("additional_trip", "boolean").alias("bool_flag"))


@query("p06_drop_flagged", f"""WITH o AS ({OBS_SQL})
SELECT operator, line, count(*) AS n, round(sum(price), 2) AS price FROM o
WHERE NOT coalesce(lower(cancelled) = 'true', false) AND pass_code = 0 AND NOT additional_trip GROUP BY operator, line""")
def _(spark, d):
    kept = R.drop_flagged(observations(spark, d), "cancelled", "pass_code", "additional_trip")
    return kept.groupBy("operator", "line").agg(F.count("*").alias("n"), _r(F.sum("price"), 2).alias("price"))


@query("p07_observed_only", """
SELECT event_id, CASE WHEN event_type = 'click' THEN ts END AS seen FROM events""")
def _(spark, d):
    return _events(spark, d).select("event_id", D.observed_only("ts", "event_type", ["click"]).alias("seen"))


@query("p08_band_or_null", f"""WITH o AS ({OBS_SQL})
SELECT operator, line, count(*) AS n, min(arr) AS lo, max(dep) AS hi, count(arr) AS n_arr FROM o
WHERE (arr IS NOT NULL OR dep IS NOT NULL) AND (arr IS NULL OR arr BETWEEN -120 AND 1800)
  AND (dep IS NULL OR dep BETWEEN -120 AND 1800) GROUP BY operator, line""")
def _(spark, d):
    kept = R.keep_in_band(observations(spark, d), "arr", "dep")
    return kept.groupBy("operator", "line").agg(
        F.count("*").alias("n"), F.min("arr").alias("lo"), F.max("dep").alias("hi"), F.count("arr").alias("n_arr"))


@query("p09_band_both", f"""WITH o AS ({OBS_SQL})
SELECT operator, line, count(*) AS n, min(arr) AS lo, max(dep) AS hi FROM o
WHERE arr >= -120 AND dep >= -120 AND arr <= 1800 AND dep <= 1800 GROUP BY operator, line""")
def _(spark, d):
    kept = R.drop_late(R.drop_early(observations(spark, d), "arr", "dep"), "arr", "dep")
    return kept.groupBy("operator", "line").agg(F.count("*").alias("n"), F.min("arr").alias("lo"), F.max("dep").alias("hi"))


@query("p10_drop_missing", f"""WITH o AS ({OBS_SQL})
SELECT trip_id, part_id, line_no, price, arr, dep FROM o WHERE arr IS NOT NULL AND dep IS NOT NULL""")
def _(spark, d):
    return R.drop_missing(observations(spark, d), ["arr", "dep", "absent"]).select(
        "trip_id", "part_id", "line_no", "price", "arr", "dep")


@query("p11_fill_constant", f"""WITH o AS ({OBS_SQL})
SELECT trip_id, part_id, line_no, price, coalesce(arr, 0) AS arr FROM o""")
def _(spark, d):
    return R.fill_constant(observations(spark, d), {"arr": 0, "absent": 1}).select("trip_id", "part_id", "line_no", "price", "arr")


@query("p12_serving_defaults", f"""
WITH w AS (SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS temperature,
  CASE WHEN event_type IN ('view', 'click') THEN NULL ELSE value END AS speed,
  CASE WHEN event_type IN ('view', 'error') THEN NULL ELSE value * 2 END AS gust FROM events)
SELECT event_id, coalesce(temperature, {SERVING_DEFAULTS['temperature']}) AS temperature,
  round((coalesce(speed, 3.0) + coalesce(gust, speed, 3.0)) / 2, 6) AS wind FROM w""")
def _(spark, d):
    w = _events(spark, d).selectExpr(
        "event_id", "case when event_type = 'view' then null else value end as temperature",
        "case when event_type in ('view', 'click') then null else value end as speed",
        "case when event_type in ('view', 'error') then null else value * 2 end as gust")
    return w.select("event_id", C.serving_value("temperature").alias("temperature"), _r(C.serving_wind("speed", "gust")).alias("wind"))


@query("p13_equalities", "SELECT event_id, value FROM events WHERE event_type = 'click' AND user_id = 8")
def _(spark, d):
    return R.equals_all(_events(spark, d), event_type="click", user_id=8).select("event_id", "value")


_LAGGED = f"""WITH o AS ({OBS_SQL}), l AS (
SELECT *, lag(arr) OVER w AS prev, price - lag(price) OVER w AS dist FROM o
WINDOW w AS (PARTITION BY trip_id ORDER BY ts, stop_id, part_id, line_no, price))"""


def _lagged(spark, d):
    from ..operators.windows import with_previous
    out = with_previous(
        observations(spark, d), ["trip_id"], ["ts", "stop_id", "part_id", "line_no", "price"],
        lags={"prev": "arr", "pp": "price"}, chunk=F.unix_date(F.to_date("ts")))
    return out.withColumn("dist", F.col("price") - F.col("pp")).drop("pp")


@query("p14_after_first_stop", _LAGGED + """
SELECT trip_id, part_id, line_no, prev, round(dist, 4) AS dist FROM l WHERE prev IS NOT NULL AND NOT coalesce(dist, -1) = 0""")
def _(spark, d):
    return R.after_first_stop(_lagged(spark, d), "prev", "dist").select(
        "trip_id", "part_id", "line_no", "prev", _r(F.col("dist"), 4).alias("dist"))


@query("p14_positive_distance", _LAGGED + """
SELECT trip_id, part_id, line_no, round(dist, 4) AS dist FROM l WHERE dist IS NOT NULL AND dist > 0""")
def _(spark, d):
    return R.positive_distance(_lagged(spark, d), "dist").select("trip_id", "part_id", "line_no", _r(F.col("dist"), 4).alias("dist"))


@query("p15_join_miss_drop", """
SELECT o_orderkey, c_acctbal FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') c
  ON o_custkey = c_custkey WHERE c_acctbal IS NOT NULL""")
def _(spark, d):
    from ..operators.joins import lookup
    dim = table(spark, d, "customer").filter(F.col("c_mktsegment") != "BUILDING")
    joined = lookup(table(spark, d, "orders"), dim, {"o_custkey": "c_custkey"}, {"c_acctbal": "c_acctbal"})
    return R.drop_missing(joined, ["c_acctbal"]).select("o_orderkey", "c_acctbal")


@query("p16_text_match", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(red|blue).*t$')")
def _(spark, d):
    return R.text_matches(table(spark, d, "part"), "p_name", "^(red|blue).*t$").select("p_partkey", "p_name")


@query("p17_cap", "SELECT event_type, count(*) AS n, max(value) AS top FROM events WHERE value <= 60 GROUP BY event_type")
def _(spark, d):
    return R.cap(_events(spark, d), "value", 60).groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"))


@query("p18_named_columns", f"""WITH o AS ({OBS_SQL})
SELECT arr AS prev_stop_delay, price AS dist_to_prev_stop FROM o""")
def _(spark, d):
    o = observations(spark, d).selectExpr("arr as prev_stop_delay", "price as dist_to_prev_stop", "trip_id")
    return R.keep_columns(o, ["prev_stop_delay", "dist_to_prev_stop"])


@query("p19_numeric_matrix", f"""WITH o AS ({OBS_SQL})
SELECT trip_id, part_id, coalesce(CAST(arr AS DOUBLE), 0) AS arr, coalesce(CAST(dep AS DOUBLE), 0) AS dep,
  CAST(additional_trip AS INTEGER)::DOUBLE AS additional_trip FROM o""")
def _(spark, d):
    return R.numeric_matrix(observations(spark, d), ["arr", "dep", "additional_trip"], keep=["trip_id", "part_id"])


# --- column functions ------------------------------------------------------------------------------

def _swiss_text(seconds: bool) -> str:
    s = "cast(ts as string)"
    return (f"concat(substring({s}, 9, 2), '.', substring({s}, 6, 2), '.', substring({s}, 1, 4), ' ', "
            f"substring({s}, 12, {8 if seconds else 5}))")


def _texts(spark, d):
    return _events(spark, d).selectExpr(
        "event_id", "ts", f"case when event_type = 'error' then 'bad' else {_swiss_text(True)} end as full",
        f"case when event_type = 'view' then null else {_swiss_text(False)} end as short")


@query("f01_parse_times", """
SELECT event_id, CASE WHEN event_type <> 'error' THEN date_trunc('second', ts) END AS full_at,
  CASE WHEN event_type <> 'view' THEN date_trunc('minute', ts) END AS short_at,
  CASE WHEN event_type <> 'view' THEN CAST(ts AS DATE) END AS day FROM events""")
def _(spark, d):
    return _texts(spark, d).select(
        "event_id", P.parse_local("full", seconds=True).alias("full_at"), P.parse_local("short").alias("short_at"),
        P.parse_day(F.substring("short", 1, 10)).alias("day"))


_SHIFT = "((event_id * 7919) % 172801) - 86400"


@query("f02_delay_wrap", f"""
WITH t AS (SELECT event_id, ts AS s, ts + to_seconds({_SHIFT}) AS a FROM events),
g AS (SELECT event_id, hour(a) * 3600 + minute(a) * 60 + second(a) - hour(s) * 3600 - minute(s) * 60 AS gap FROM t),
f AS (SELECT event_id, CASE WHEN gap <= -43200 THEN gap + 86400 ELSE gap END AS gap FROM g)
SELECT event_id, CAST(CASE WHEN gap > 43200 THEN gap - 86400 ELSE gap END AS INTEGER) AS delay FROM f""")
def _(spark, d):
    t = _events(spark, d).selectExpr("event_id", "ts as s", f"ts + make_dt_interval(0, 0, 0, {_SHIFT}) as a")
    return t.select("event_id", D.time_of_day_delay("s", "a").alias("delay"))


@query("f03_text_minutes", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE CAST(hour(ts) * 60 + minute(ts) AS INTEGER) END AS minute_of_day,
  CASE WHEN event_type = 'error' THEN 1 ELSE CAST(month(ts) AS INTEGER) END AS month FROM events""")
def _(spark, d):
    return _texts(spark, d).select("event_id", P.text_minute_of_day("full").alias("minute_of_day"), P.text_month("full").alias("month"))


@query("f04_coalesce_times", f"""WITH o AS ({OBS_SQL})
SELECT trip_id, part_id, line_no, price, coalesce(arr, dep) AS delay FROM o""")
def _(spark, d):
    return observations(spark, d).select("trip_id", "part_id", "line_no", "price", F.coalesce("arr", "dep").alias("delay"))


_CYCLE = "round({f}(2 * pi() * {x} / {p}), 5) AS {n}"


def _cycle_sql(parts):
    return ", ".join(_CYCLE.format(f=f, x=x, p=p, n=f"{n}_{f}") for n, x, p in parts for f in ("sin", "cos"))


@query("f05_training_cycles", "SELECT event_id, " + _cycle_sql([
    ("time", "(hour(ts) * 60 + minute(ts))", 1440), ("dow", "(isodow(ts) - 1)", 7), ("month", "month(ts)", 12)]) + " FROM events")
def _(spark, d):
    cycles = P.training_cycles(F.hour("ts") * 60 + F.minute("ts"), P.day_of_week("ts"), F.month("ts"))
    return _events(spark, d).select("event_id", *[_r(c.cast("double"), 5).alias(n) for n, c in cycles.items()])


@query("f06_weekday", "SELECT event_id, CAST(isodow(ts) - 1 AS INTEGER) AS dow, isodow(ts) >= 6 AS weekend FROM events")
def _(spark, d):
    return _events(spark, d).select("event_id", P.day_of_week("ts").alias("dow"), P.is_weekend("ts").alias("weekend"))


@query("f08_calendar_groups", """
SELECT CAST(year(l_shipdate) AS INTEGER) AS y, CAST(month(l_shipdate) AS INTEGER) AS m, count(*) AS n FROM lineitem
WHERE year(l_shipdate) <> 1996 GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY year(l_shipdate), month(l_shipdate)"))
def _(spark, d):
    li = table(spark, d, "lineitem").filter(F.year("l_shipdate") != 1996)
    return li.groupBy(F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m")).agg(F.count("*").alias("n"))


@query("f09_utc_hour", """
SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, date_trunc('hour',
  ((l_shipdate + to_minutes((l_partkey * 7) % 1440)) AT TIME ZONE 'Europe/Zurich') AT TIME ZONE 'UTC') AS hour_utc FROM lineitem""")
def _(spark, d):
    li = table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice",
        "l_shipdate + make_dt_interval(0, 0, cast((l_partkey * 7) % 1440 as int)) as ts")
    return li.select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", P.utc_hour("ts").alias("hour_utc"))


@query("f10_service_date", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY CAST(ts AS DATE)")
def _(spark, d):
    return _events(spark, d).groupBy(P.service_date("ts").alias("day")).agg(F.count("*").alias("n"))


@query("f11_direction", "SELECT event_id, round(sin(radians(value)), 6) AS s, round(cos(radians(value)), 6) AS c FROM events")
def _(spark, d):
    s, c = C.direction_parts("value")
    return _events(spark, d).select("event_id", _r(s).alias("s"), _r(c).alias("c"))


@query("f12_mean_of_two", f"""WITH o AS ({OBS_SQL}) SELECT trip_id, part_id, line_no, price, (arr + dep) / 2 AS wind FROM o""")
def _(spark, d):
    return observations(spark, d).select("trip_id", "part_id", "line_no", "price", C.mean_of_two("arr", "dep").alias("wind"))


@query("f13_weather_signs", f"""WITH o AS ({OBS_SQL})
SELECT trip_id, part_id, line_no, price, round(quantity - 0.7 * arr, 6) AS chill,
  coalesce(arr > 1.0, false) OR coalesce(dep > 0, false) AS adverse FROM o""")
def _(spark, d):
    return observations(spark, d).select(
        "trip_id", "part_id", "line_no", "price", _r(C.wind_chill("quantity", "arr")).alias("chill"), C.is_adverse("arr", "dep").alias("adverse"))


@query("f14_rush_hour", """
SELECT CAST(hour(ts) AS INTEGER) AS hour, hour(ts) BETWEEN 7 AND 9 OR hour(ts) BETWEEN 16 AND 19 AS rush, count(*) AS n,
  count(*) FILTER (WHERE (hour(ts) BETWEEN 7 AND 9 OR hour(ts) BETWEEN 16 AND 19) AND value > 1.0) AS stress
FROM events GROUP BY hour(ts)""")
def _(spark, d):
    rush = C.is_rush_hour(F.hour("ts"))
    e = _events(spark, d).select(F.hour("ts").alias("hour"), rush.alias("rush"), "value")
    return e.groupBy("hour", "rush").agg(F.count("*").alias("n"), F.count_if(F.col("rush") & C.is_adverse("value", F.lit(None).cast("double"))).alias("stress"))


@query("f15_guarded_ratio", """
SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice,
  round(CASE WHEN l_discount > 0 THEN (l_tax + l_quantity) / l_discount ELSE 0 END, 4) AS heavy FROM lineitem""")
def _(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", _r(C.heavy_share("l_tax", "l_quantity", "l_discount"), 4).alias("heavy"))


@query("f16_half_day_peak", "SELECT event_id, CASE WHEN hour(ts) < 12 THEN value ELSE CAST(user_id AS DOUBLE) END AS peak FROM events")
def _(spark, d):
    return _events(spark, d).select("event_id", C.peak_by_half_day(F.hour("ts"), "value", F.col("user_id").cast("double")).alias("peak"))


@query("f17_planar_distance", """
SELECT vec_id, round(sqrt(pow(embedding[3]::DOUBLE - embedding[1]::DOUBLE, 2) + pow(embedding[4]::DOUBLE - embedding[2]::DOUBLE, 2)), 6) AS dist FROM embeddings""")
def _(spark, d):
    e = [F.get("embedding", F.lit(i)).cast("double") for i in range(4)]
    return table(spark, d, "embeddings").select("vec_id", _r(C.planar_distance(*e)).alias("dist"))


@query("f18_grid_to_wgs84", """
WITH g AS (SELECT o_orderkey, (2485000 + o_totalprice * 0.7 - 2600000) / 1000000 AS y, (1075000 + o_custkey * 10 - 1200000) / 1000000 AS x FROM orders)
SELECT o_orderkey, round((16.9023892 + 3.238272 * x - 0.270978 * pow(y, 2) - 0.002528 * pow(x, 2) - 0.0447 * pow(y, 2) * x - 0.0140 * pow(x, 3)) * 100 / 36, 6) AS lat,
  round((2.6779094 + 4.728982 * y + 0.791484 * y * x + 0.1306 * y * pow(x, 2) - 0.0436 * pow(y, 3)) * 100 / 36, 6) AS lon FROM g""")
def _(spark, d):
    g = table(spark, d, "orders").selectExpr("o_orderkey", "2485000 + o_totalprice * 0.7D as e", "1075000 + o_custkey * 10 as n")
    lat, lon = C.swiss_grid_to_wgs84("e", "n")
    return g.select("o_orderkey", _r(lat).alias("lat"), _r(lon).alias("lon"))


@query("f19_units", "SELECT event_id, round(value / 3600, 8) AS sunshine, round(value / 3.6, 6) AS ms FROM events")
def _(spark, d):
    return _events(spark, d).select("event_id", _r(C.sunshine_fraction("value"), 8).alias("sunshine"), _r(C.kmh_to_ms("value")).alias("ms"))


@query("f20_weekday_from_cycle", "SELECT event_id, CAST(isodow(ts) - 1 AS INTEGER) AS dow FROM events")
def _(spark, d):
    s, c = P.cyclic(P.day_of_week("ts"), 7)
    return _events(spark, d).select("event_id", P.weekday_from_cycle(s, c).alias("dow"))


@query("f21_safe_id", """
SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderstatus = 'F' THEN 'x' || o_custkey ELSE CAST(o_custkey AS VARCHAR) END AS INTEGER) AS id FROM orders""")
def _(spark, d):
    o = table(spark, d, "orders").selectExpr("o_orderkey", "concat(if(o_orderstatus = 'F', 'x', ''), o_custkey) as t")
    return o.select("o_orderkey", C.safe_id("t").alias("id"))


@query("f22_shifted_log", f"""WITH o AS ({OBS_SQL})
SELECT trip_id, part_id, line_no, price, round(ln(arr + 136), 6) AS y, round(exp(ln(arr + 136)) - 136, 4) AS back FROM o""")
def _(spark, d):
    o = observations(spark, d)
    y = C.shifted_log("arr", 136.0)
    return o.select("trip_id", "part_id", "line_no", "price", _r(y).alias("y"), _r(C.shifted_exp(y, 136.0), 4).alias("back"))


_CLS = "(CAST(value > 5 AS INTEGER) + CAST(value > 20 AS INTEGER) + CAST(value > 60 AS INTEGER))"


@query("f23_delay_class", f"SELECT event_id, {_CLS} AS cls FROM events")
def _(spark, d):
    return _events(spark, d).select("event_id", D.delay_class("value", BINS).alias("cls"))


@query("f24_class_names", f"""
SELECT CASE {_CLS} WHEN 0 THEN '≤5s' WHEN 1 THEN '5–20s' WHEN 2 THEN '20–60s' ELSE '>60s' END AS name, count(*) AS n FROM events GROUP BY 1""")
def _(spark, d):
    return _events(spark, d).groupBy(D.class_name(D.delay_class("value", BINS), BINS).alias("name")).agg(F.count("*").alias("n"))


@query("f25_class_value", f"""
SELECT event_id, CASE {_CLS} WHEN 0 THEN -25.0::DOUBLE WHEN 1 THEN 12.5 WHEN 2 THEN 40.0 ELSE 110.0 END AS delay FROM events""")
def _(spark, d):
    return _events(spark, d).select("event_id", D.class_value(D.delay_class("value", BINS), BINS).alias("delay"))


_W = [f"exp(-pow(value - {c}, 2) / (2.0 * {w} * {w}))" for c, w in ((30, 30), (90, 30), (210, 90), (420, 180))]


@query("f26_soft_classes", "SELECT event_id, " + ", ".join(
    f"round({w} / ({' + '.join(_W)}), 6) AS p{i}" for i, w in enumerate(_W)) + " FROM events")
def _(spark, d):
    return _events(spark, d).select("event_id", *[_r(p).alias(f"p{i}") for i, p in enumerate(D.soft_classes("value"))])


@query("f27_severity", """
SELECT event_id, CASE WHEN value <= 60 THEN 'On time' WHEN value <= 120 THEN 'Slight delay' WHEN value <= 300 THEN 'Moderate delay'
  ELSE 'Major delay' END AS label, CAST(floor(greatest(0, value - 64) + 0.5) AS BIGINT) AS low, CAST(floor(value + 64 + 0.5) AS BIGINT) AS high FROM events""")
def _(spark, d):
    low, high = D.likely_range("value")
    return _events(spark, d).select("event_id", D.severity("value").alias("label"), low.alias("low"), high.alias("high"))


@query("f28_standard_score", """
SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_samp(value) FROM events), 6) AS z FROM events""")
def _(spark, d):
    return standard_score(_events(spark, d), "value", "z").select("event_id", _r(F.col("z")).alias("z"))


@query("f29_fractional_hour", "SELECT event_id, round(hour(ts) + minute(ts) / 60.0, 6) AS h FROM events")
def _(spark, d):
    return _events(spark, d).select("event_id", _r(P.fractional_hour("ts")).alias("h"))


@query("f30_gap_and_late", f"""
WITH t AS (SELECT event_id, date_trunc('second', ts) AS s, date_trunc('second', ts) + to_seconds(CAST(floor(value) AS BIGINT) * 3 - 60) AS a FROM events)
SELECT event_id, CAST(abs(epoch(a) - epoch(s)) AS INTEGER) AS gap, abs(epoch(a) - epoch(s)) >= 90 AS late FROM t""")
def _(spark, d):
    t = _events(spark, d).selectExpr("event_id", "ts as s", "ts + make_dt_interval(0, 0, 0, floor(value) * 3 - 60) as a")
    gap = D.absolute_gap_seconds("s", "a")
    return t.select("event_id", gap.cast("int").alias("gap"), D.is_late(gap).alias("late"))


@query("f31_serving_cycles", "SELECT event_id, " + _cycle_sql([
    ("time", "hour(ts)", 24), ("dow", "(isodow(ts) - 1)", 7), ("month", "(month(ts) - 1)", 12)]) + " FROM events")
def _(spark, d):
    return _events(spark, d).select("event_id", *[_r(c.cast("double"), 5).alias(n) for n, c in P.serving_cycles("ts").items()])
