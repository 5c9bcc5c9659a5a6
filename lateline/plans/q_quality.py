"""Registered queries: data-quality rules, accounting and incremental jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timeparts as P
from ..functions.delays import in_band_or_null
from ..operators import aggregates as A
from ..operators import quality as Q
from ..operators.windows import with_previous
from .registry import OBS_SQL, observations, query, table


def _r(c, n=6):
    return F.round(c, n)


# A feature table with every checked column, made from the line items.
_FEATURES = f"""o AS ({OBS_SQL}), l AS (SELECT *, lag(arr) OVER w AS prev, row_number() OVER w AS pos, price - lag(price) OVER w AS dist FROM o
  WINDOW w AS (PARTITION BY trip_id ORDER BY ts, stop_id, part_id, line_no, price)),
f AS (SELECT ts AS timestamp, CAST(sin(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440) AS FLOAT) AS time_sin, CAST(cos(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440) AS FLOAT) AS time_cos,
  CAST(sin(2 * pi() * (isodow(ts) - 1) / 7) AS FLOAT) AS dow_sin, CAST(cos(2 * pi() * (isodow(ts) - 1) / 7) AS FLOAT) AS dow_cos,
  CAST(sin(2 * pi() * month(ts) / 12) AS FLOAT) AS month_sin, CAST(cos(2 * pi() * month(ts) / 12) AS FLOAT) AS month_cos,
  isodow(ts) >= 6 AS is_weekend, operator, line, stop_id, 'stop' AS stop_name, additional_trip, arr AS arrival_delay_s, dep AS departure_delay_s,
  pass_code = 3 AS is_public_holiday, prev AS prev_stop_delay, pos AS trip_stop_index, abs(dist) AS dist_to_prev_stop,
  CASE WHEN pass_code = 1 THEN NULL ELSE quantity - 5 END AS temperature, quantity / 10 AS precipitation, quantity * 2 AS humidity, quantity / 3 AS wind_speed,
  quantity * 2 AS wind_gust, quantity * 7.2 AS wind_dir, 900 + quantity AS pressure, quantity / 40 AS sunshine, quantity / 4 AS snow_depth,
  price AS traffic_dtv, price / 10 AS traffic_peak, quantity / 60 AS traffic_heavy_share, CASE WHEN quantity = 7 THEN 0 ELSE quantity / 20 END AS traffic_peak_ratio FROM l)"""


def features(spark, d):
    l = with_previous(
        observations(spark, d), ["trip_id"], ["ts", "stop_id", "part_id", "line_no", "price"],
        lags={"prev": "arr", "pp": "price"}, index="pos", base=1, chunk=F.unix_date(F.to_date("ts")))
    c = P.training_cycles(F.hour("ts") * 60 + F.minute("ts"), P.day_of_week("ts"), F.month("ts"))
    return l.withColumns(c).withColumn("is_weekend", P.is_weekend("ts")).selectExpr(
        "ts as timestamp", *c, "is_weekend", "operator", "line", "stop_id", "'stop' as stop_name", "additional_trip",
        "arr as arrival_delay_s", "dep as departure_delay_s", "pass_code = 3 as is_public_holiday", "prev as prev_stop_delay",
        "pos as trip_stop_index", "abs(price - pp) as dist_to_prev_stop",
        "case when pass_code = 1 then null else quantity - 5 end as temperature", "quantity / 10 as precipitation", "quantity * 2 as humidity",
        "quantity / 3 as wind_speed", "quantity * 2 as wind_gust", "quantity * 7.2D as wind_dir", "900 + quantity as pressure",
        "quantity / 40 as sunshine", "quantity / 4 as snow_depth", "price as traffic_dtv", "price / 10 as traffic_peak",
        "quantity / 60 as traffic_heavy_share", "case when quantity = 7 then 0D else quantity / 20 end as traffic_peak_ratio")


def _report(spark, d, rules):
    return Q.validate(features(spark, d), rules).select("name", "status", _r(F.col("measure"), 4).alias("measure"))


def _sql(checks: list[tuple[str, str, str, str]]) -> str:
    """SQL of a report from (name, measure, passes, warns) with the measure called m."""
    one = "SELECT " + ", ".join(f"CAST({m} AS DOUBLE) AS m{i}" for i, (_, m, _, _) in enumerate(checks)) + " FROM f"
    parts = [
        f"SELECT '{n}' AS name, CASE WHEN {ok.replace('@', f'm{i}')} THEN 'PASS' WHEN {soft.replace('@', f'm{i}')} THEN 'WARN' ELSE 'FAIL' END AS status, round(m{i}, 4) AS measure FROM one"
        for i, (n, _, ok, soft) in enumerate(checks)]
    return f"WITH {_FEATURES}, one AS ({one}) " + " UNION ALL ".join(parts)


_NULLS = "count(*) FILTER (WHERE {c} IS NULL)"
_PCT = "count(*) FILTER (WHERE {c}) * 100.0 / count(*)"
_OUT = "count(*) FILTER (WHERE {c} < {a} OR {c} > {b})"


@query("q01_columns_present", f"""WITH {_FEATURES}, n AS (SELECT count(*) AS n FROM f)
SELECT name, CASE WHEN n > 0 THEN 'PASS' END AS status, 0.0::DOUBLE AS measure FROM n, (VALUES ('all required columns present'), ('all weather columns present'), ('all traffic columns present'), ('all trip columns present')) v(name)""")
def _(spark, d):
    f = features(spark, d)
    return Q.validate(f, Q.column_rules(f.columns)).select("name", "status", "measure")


@query("q02_completeness", _sql(
    [(f"no null in {c}", _NULLS.format(c=c), "@ = 0", "false") for c in [*Q.NEVER_NULL, "trip_stop_index"]]
    + [("every row has a delay", "count(*) FILTER (WHERE arrival_delay_s IS NULL AND departure_delay_s IS NULL)", "@ = 0", "false")]
    + [(f"{c} null rate < {a}%", _PCT.format(c=f"{c} IS NULL"), f"@ < {a}", f"@ < {b}") for c, (a, b) in Q.NULL_LIMITS.items()]
    + [(f"null rate of {c} is 0", _PCT.format(c=f"{c} IS NULL"), "@ = 0", "@ < 5") for c in Q.TRAFFIC]))
def _(spark, d):
    return _report(spark, d, Q.completeness_rules())


@query("q05_ranges", _sql(
    [(f"{c} in [-1, 1]", f"CASE WHEN min({c}) >= -1.01 AND max({c}) <= 1.01 THEN 0 ELSE 1 END", "@ = 0", "false") for c in Q.CYCLIC]
    + [("rows outside 1998 < 0.1%", _PCT.format(c="year(timestamp) <> 1998"), "@ < 0.1", "true"),
       ("stop_id > 0", "count(*) FILTER (WHERE stop_id <= 0)", "@ = 0", "false")]
    + [(f"{c} within 12 h", _OUT.format(c=c, a=-43200, b=43200), "@ = 0", "false") for c in Q.HALF_DAY_COLUMNS]
    + [(f"{c} in [{a}, {b}]", _OUT.format(c=c, a=a, b=b), "@ = 0", str(s).lower()) for c, (a, b, s) in Q.WEATHER_BOUNDS.items()]
    + [("dist_to_prev_stop in [0, 100000]", _OUT.format(c="dist_to_prev_stop", a=0, b=100000), "@ = 0", "false"),
       ("trip_stop_index in [0, 500)", "count(*) FILTER (WHERE trip_stop_index < 0 OR trip_stop_index >= 500)", "@ = 0", "false")]
    + [x for c in ("traffic_dtv", "traffic_peak") for x in (
        (f"{c} >= 0", f"count(*) FILTER (WHERE {c} < 0)", "@ = 0", "false"), (f"{c} is not zero", f"count(*) FILTER (WHERE {c} = 0)", "@ = 0", "true"))]
    + [("traffic_heavy_share in [0, 1]", _OUT.format(c="traffic_heavy_share", a=0, b=1), "@ = 0", "false"),
       ("traffic_peak_ratio in [0, 2]", _OUT.format(c="traffic_peak_ratio", a=0, b=2), "@ = 0", "true")]))
def _(spark, d):
    return _report(spark, d, Q.range_rules(1998))


@query("q10_distributions", _sql([
    ("weekend share 15-35%", "avg(CAST(is_weekend AS DOUBLE)) * 100", "@ BETWEEN 15 AND 35", "false"),
    ("each month has 4-15% of rows", " + ".join(
        f"CASE WHEN {_PCT.format(c=f'month(timestamp) = {m}')} > 0 AND NOT ({_PCT.format(c=f'month(timestamp) = {m}')} BETWEEN 4 AND 15) THEN 1 ELSE 0 END" for m in range(1, 13)), "@ = 0", "false"),
    ("no hour above 15% of rows", " + ".join(f"CASE WHEN {_PCT.format(c=f'hour(timestamp) = {h}')} > 15 THEN 1 ELSE 0 END" for h in range(24)), "@ = 0", "false"),
    ("no hour below 0.5% of rows", " + ".join(
        f"CASE WHEN {_PCT.format(c=f'hour(timestamp) = {h}')} > 0 AND {_PCT.format(c=f'hour(timestamp) = {h}')} < 0.5 THEN 1 ELSE 0 END" for h in range(24)), "@ = 0", "true"),
    ("delays above 3 h < 1%", _PCT.format(c="departure_delay_s > 10800 OR arrival_delay_s > 10800"), "@ < 1", "true"),
    ("additional trips < 20%", "avg(CAST(additional_trip AS DOUBLE)) * 100", "@ < 20", "false"),
]))
def _(spark, d):
    return _report(spark, d, Q.distribution_rules())


@query("q11_consistency", _sql([
    ("is_weekend agrees with the encoded weekday",
     "count(*) FILTER (WHERE is_weekend <> ((CAST(round(atan2(dow_sin, dow_cos) * 7.0 / (2 * pi())) AS INTEGER) % 7 + 7) % 7 >= 5))", "@ = 0", "false"),
    ("no row with both delays null", "count(*) FILTER (WHERE arrival_delay_s IS NULL AND departure_delay_s IS NULL)", "@ = 0", "false"),
]))
def _(spark, d):
    return _report(spark, d, Q.consistency_rules())


_HIT = _PCT.format(c="temperature IS NOT NULL")


@query("q12_weather_join", _sql([
    ("weather hit rate > 80%", _HIT, "@ > 80", "false"), ("weather row coverage > 95%", _HIT, "@ > 95", "false"),
    ("temperature std > 1", "stddev_samp(temperature)", "@ > 1", "false"),
]))
def _(spark, d):
    return _report(spark, d, Q.weather_join_rules())


_TRAFFIC_SQL = _sql([
    ("traffic hit rate = 100%", _PCT.format(c="traffic_dtv IS NOT NULL"), "@ = 100", "false"),
    ("traffic_dtv std > 100", "stddev_samp(traffic_dtv)", "@ > 100", "false"),
    ("traffic_heavy_share mean > 0.01", "avg(traffic_heavy_share)", "@ > 0.01", "true"),
    ("traffic_peak_ratio zero share < 10%", _PCT.format(c="traffic_peak_ratio = 0"), "@ < 10", "false"),
    ("more than 2000 distinct traffic_dtv", "count(DISTINCT traffic_dtv)", "@ > 2000", "false"),
])


@query("q13_traffic_join", _TRAFFIC_SQL)
def _(spark, d):
    return _report(spark, d, Q.traffic_join_rules())


@query("q14_status_counts", f"SELECT status, count(*) AS n FROM ({_TRAFFIC_SQL}) r GROUP BY status")
def _(spark, d):
    return Q.status_counts(Q.validate(features(spark, d), Q.traffic_join_rules()))


@query("q15_build_checks", _sql([
    ("lag inside the accepted band", _OUT.format(c="prev_stop_delay", a=-120, b=1800), "@ = 0", "false"),
    ("stop index is not negative", "count(*) FILTER (WHERE trip_stop_index < 0)", "@ = 0", "false"),
    ("distance is never zero", "count(*) FILTER (WHERE dist_to_prev_stop = 0)", "@ = 0", "false"),
    ("traffic null rate < 5%", _PCT.format(c="traffic_dtv IS NULL"), "@ < 5", "false"),
]))
def _(spark, d):
    return _report(spark, d, Q.build_rules())


@query("q16_row_accounting", f"""WITH o AS ({OBS_SQL}), k AS (SELECT operator, (arr IS NOT NULL OR dep IS NOT NULL) AND (arr IS NULL OR arr BETWEEN -120 AND 1800)
  AND (dep IS NULL OR dep BETWEEN -120 AND 1800) AS keep FROM o)
SELECT operator, count(*) AS before, count(*) FILTER (WHERE keep) AS after, count(*) - count(*) FILTER (WHERE keep) AS dropped,
  round((count(*) - count(*) FILTER (WHERE keep)) * 100.0 / count(*), 6) AS dropped_pct FROM k GROUP BY operator""")
def _(spark, d):
    b = A.before_after(observations(spark, d), in_band_or_null("arr", "dep"), ["operator"])
    return b.withColumn("dropped_pct", _r(F.col("dropped_pct")))


@query("build_events_features", """
WITH l AS (SELECT *, lag(value) OVER w AS prev, CAST(row_number() OVER w - 1 AS INTEGER) AS pos FROM events WHERE event_type <> 'error' WINDOW w AS (PARTITION BY CAST(ts AS DATE), user_id ORDER BY ts)),
wx AS (SELECT event_type AS station, date_trunc('hour', ts) AS h, avg(value) AS temperature FROM events GROUP BY 1, 2)
SELECT event_id, CAST(isodow(ts) - 1 AS INTEGER) AS dow, prev, pos, round(temperature, 6) AS temperature FROM l JOIN wx ON l.event_type = wx.station
  AND wx.h = date_trunc('hour', (ts AT TIME ZONE 'Europe/Zurich') AT TIME ZONE 'UTC') WHERE prev IS NOT NULL""")
def _(spark, d):
    """Filter → trip window → first-stop drop → hourly weather: the shape of the dataset build."""
    from ..operators.joins import lookup
    e = table(spark, d, "events")
    wx = e.groupBy(F.col("event_type").alias("station"), P.hour_floor("ts").alias("h")).agg(F.avg("value").alias("temperature"))
    kept = e.filter("event_type <> 'error'").withColumn("day", P.service_date("ts"))
    l = with_previous(kept, ["day", "user_id"], ["ts"], lags={"prev": "value"}, index="pos", chunk=F.hour("ts") * 60 + F.minute("ts"))
    l = l.filter(F.col("prev").isNotNull()).withColumn("hour_utc", P.utc_hour("ts"))
    out = lookup(l, wx, {"event_type": "station", "hour_utc": "h"}, {"temperature": "temperature"}, how="inner")
    return out.select("event_id", P.day_of_week("ts").alias("dow"), "prev", "pos", _r(F.col("temperature")).alias("temperature"))
