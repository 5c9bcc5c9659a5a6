"""Registered query: the whole dataset build from raw text cells, against SQL that follows its rules step by step."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..schema import CYCLIC, TRAFFIC, TRAFFIC_COUNTS, WEATHER
from .dataset import build_full_table
from .registry import query, table

_STATIONS = ["click", "error", "purchase", "signup", "view"]
# What a weather column adds to the hour's mean, and a road's count to its class.
_SHIFT = {c: float(i) for i, c in enumerate(WEATHER)}
_SHARE = {"dwv_fzg": 0.9, "msp_fzg": 0.08, "asp_fzg": 0.12, "dtv_pw": 0.8, "dtv_lw": 0.05, "dtv_lz": 0.03, "dtv_li": 0.02}

_ARR = "CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_id * 37 % 2100 - 150 END"
_DEP = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id * 53 % 2000 END"
_r = lambda x, n: f"round(CAST(CAST({x} AS FLOAT) AS DOUBLE), {n})"
_f = lambda x, n: f"CASE WHEN {_r(x, n)} = 0 THEN 0.0 ELSE {_r(x, n)} END"       # no negative zero

_SQL = f"""
WITH kept AS (SELECT *, date_trunc('minute', ts) AS due, user_id % 20 AS trip, event_id % 997 AS stop, {_ARR} AS arr, {_DEP} AS dep FROM events
  WHERE event_id % 19 <> 0 AND event_id % 17 <> 0 AND coalesce({_ARR}, {_DEP}) IS NOT NULL
    AND coalesce({_ARR}, 0) BETWEEN -120 AND 1800 AND coalesce({_DEP}, 0) BETWEEN -120 AND 1800),
grid AS (SELECT p_partkey AS id, 2600000.0 + p_partkey * 137 % 20000 AS e, 1200000.0 + p_partkey * 911 % 20000 AS n,
  CASE p_partkey % 3 WHEN 0 THEN 'VD' WHEN 1 THEN 'ZH' ELSE 'BE' END AS canton FROM part WHERE p_partkey < 900),
stops AS (SELECT *, (16.9023892 + 3.238272 * x - 0.270978 * pow(y, 2) - 0.002528 * pow(x, 2) - 0.0447 * pow(y, 2) * x - 0.0140 * pow(x, 3)) * 100 / 36 AS lat,
  (2.6779094 + 4.728982 * y + 0.791484 * y * x + 0.1306 * y * pow(x, 2) - 0.0436 * pow(y, 3)) * 100 / 36 AS lon
  FROM (SELECT *, (e - 2600000) / 1000000 AS y, (n - 1200000) / 1000000 AS x FROM grid)),
moved AS (SELECT k.*, row_number() OVER w - 1 AS place, lag(arr) OVER w AS prev, sqrt(pow(s.e - lag(s.e) OVER w, 2) + pow(s.n - lag(s.n) OVER w, 2)) AS dist
  FROM kept k LEFT JOIN stops s ON stop = s.id WINDOW w AS (PARTITION BY CAST(due AS DATE), trip ORDER BY due, stop)),
roads AS (SELECT s_suppkey AS road, 2600000.0 + s_suppkey * 1733 % 20000 AS x0, 1200000.0 + s_suppkey * 577 % 20000 AS y0, CAST(s_suppkey * 10 % 700 AS DOUBLE) AS dtv FROM supplier),
gap AS (SELECT s.id, r.*, greatest(x0 - e, 0, e - (x0 + 400)) AS dx, greatest(y0 - n, 0, n - (y0 + 300)) AS dy FROM stops s CROSS JOIN roads r),
band AS (SELECT *, CASE WHEN greatest(dx, dy) <= 500 THEN 0 WHEN greatest(dx, dy) <= 1000 THEN 1 WHEN greatest(dx, dy) <= 2000 THEN 2 ELSE 3 END AS band FROM gap WHERE greatest(dx, dy) <= 5000),
traffic AS (SELECT id, dtv FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY band, dx * dx + dy * dy, road) AS rn FROM band) WHERE rn = 1),
station AS (SELECT id, arg_min(k, pow(lat - slat, 2) + pow(lon - slon, 2)) AS station
  FROM stops CROSS JOIN (SELECT unnest(range({len(_STATIONS)})) AS i, unnest({_STATIONS}) AS k, 46.95 + i * 0.04 AS slat, 7.44 + i * 0.05 AS slon) GROUP BY id),
weather AS (SELECT event_type AS station, date_trunc('hour', ts) AS hour, round(avg(value), 3) AS v FROM events GROUP BY 1, 2)
SELECT due AS timestamp, 't' || trip AS trip_id, CAST(stop AS INTEGER) AS stop_id, 'stop ' || stop AS stop_name, event_type AS operator, CAST(user_id AS VARCHAR) AS line,
  isodow(due) >= 6 AS is_weekend, false AS additional_trip, false AS pass_through, CAST(arr AS INTEGER) AS arrival_delay_s, CAST(dep AS INTEGER) AS departure_delay_s,
  canton = 'VD' AND day(due) % 5 = 0 AS is_public_holiday, CAST(place AS SMALLINT) AS trip_stop_index, CAST(prev AS INTEGER) AS prev_stop_delay, {_f("dist", 1)} AS dist_to_prev_stop,
  {", ".join(f"{_f(f'{f}(2 * pi() * {v} / {p})', 4)} AS {n}_{f}" for n, v, p in (("time", "(hour(due) * 60 + minute(due))", 1440.0), ("dow", "(isodow(due) - 1)", 7.0), ("month", "month(due)", 12.0)) for f in ("sin", "cos"))},
  {_f("dtv", 3)} AS traffic_dtv, {", ".join(f"{_f(f'dtv * {_SHARE[s]}', 3)} AS {c}" for c, s in zip(TRAFFIC_COUNTS, ("dwv_fzg", "dtv_pw", "dtv_lw", "dtv_lz", "dtv_li")))},
  {_f("CASE WHEN hour(due) < 12 THEN dtv * 0.08 ELSE dtv * 0.12 END", 3)} AS traffic_peak, CASE WHEN dtv > 0 THEN {_f("(dtv * 0.05 + dtv * 0.03) / dtv", 3)} ELSE 0 END AS traffic_heavy_share,
  CASE WHEN dtv > 0 THEN {_f("dtv * 0.12 / dtv", 3)} ELSE 0 END AS traffic_peak_ratio, {", ".join(f"{_f(f'v + {s}', 2)} AS {c}" for c, s in _SHIFT.items())}
FROM moved JOIN stops s ON stop = s.id JOIN traffic t ON t.id = s.id JOIN station a ON a.id = s.id
JOIN weather w ON w.station = a.station AND w.hour = date_trunc('hour', (due AT TIME ZONE 'Europe/Zurich') AT TIME ZONE 'UTC')
WHERE prev IS NOT NULL AND coalesce(dist, -1) <> 0"""


def _raw(e):
    """Events as the text cells of a daily file: other products, cancelled trips, estimates and unreadable times among them."""
    text = lambda c, s="": F.date_format(c, "dd.MM.yyyy HH:mm" + s)
    plan = F.date_trunc("minute", F.col("ts").cast("timestamp"))
    later = lambda seconds: F.timestamp_seconds(F.unix_timestamp(plan) + seconds)
    arr, dep = F.expr("event_id * 37 % 2100 - 150"), F.expr("event_id * 53 % 2000")
    return e.select(
        F.when(F.col("event_id") % 19 == 0, "Zug").otherwise("Bus").alias("PRODUCT_ID"), F.date_format("ts", "dd.MM.yyyy").alias("DATE"),
        F.concat(F.lit("t"), F.col("user_id") % 20).alias("TRIP_ID"), F.col("event_type").alias("OPERATOR_ABB"), F.col("user_id").cast("string").alias("LINE_NAME"),
        (F.col("event_id") % 997).cast("string").alias("BPUIC"), F.concat(F.lit("stop "), F.col("event_id") % 997).alias("STOP_NAME"),
        text(plan).alias("ARRIVAL_TIME"), text(later(60)).alias("DEPARTURE_TIME"),
        text(later(arr), ":ss").alias("ARRIVAL_FORECAST"), F.when(F.col("event_id") % 13 == 0, "PROGNOSE").otherwise("REAL").alias("ARRIVAL_FORECAST_STATUS"),
        F.when(F.col("event_id") % 7 == 0, "unknown").otherwise(text(later(60 + dep), ":ss")).alias("DEPARTURE_FORECAST"), F.lit("REAL").alias("DEPARTURE_FORECAST_STATUS"),
        F.lit("false").alias("ADDITIONAL_TRIP"), F.when(F.col("event_id") % 17 == 0, "true").otherwise("false").alias("CANCELLED"), F.lit("0").alias("PASS_THROUGH"))


@query("build_full_table", _SQL)
def _(spark, d):
    e = table(spark, d, "events")
    stops = table(spark, d, "part").filter("p_partkey < 900").selectExpr(
        "cast(p_partkey as string) as number", "cast(2600000 + p_partkey * 137 % 20000 as double) as lv95east", "cast(1200000 + p_partkey * 911 % 20000 as double) as lv95north",
        "case p_partkey % 3 when 0 then 'VD' when 1 then 'ZH' else 'BE' end as cantonabbreviation", "'town' as municipalityname")
    holidays = e.select(F.to_date("ts").alias("date")).distinct().filter(F.dayofmonth("date") % 5 == 0).select(
        "date", F.lit("VD").alias("canton"), F.lit(True).alias("is_public_holiday"))
    roads = table(spark, d, "supplier").selectExpr(
        "s_suppkey as id", "cast(2600000 + s_suppkey * 1733 % 20000 as double) as minx", "cast(1200000 + s_suppkey * 577 % 20000 as double) as miny", "cast(s_suppkey * 10 % 700 as double) as dtv_fzg")
    roads = roads.withColumns({"maxx": F.col("minx") + 400, "maxy": F.col("miny") + 300, **{c: F.col("dtv_fzg") * s for c, s in _SHARE.items()}})
    kinds = F.array(*[F.lit(k) for k in _STATIONS])
    place = F.array_position(kinds, F.col("station_id")) - 1
    stations = e.select(F.col("event_type").alias("station_id")).distinct().withColumns({"lat": 46.95 + place * 0.04, "lon": 7.44 + place * 0.05})
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    weather = e.groupBy(F.col("event_type").alias("station_id"), hour.alias("timestamp")).agg(F.round(F.avg("value"), 3).alias("v"))
    weather = weather.select("station_id", "timestamp", *[(F.col("v") + s).alias(c) for c, s in _SHIFT.items()])
    out = build_full_table(_raw(e), stops, holidays, roads, stations, weather)
    digits = {**dict.fromkeys(CYCLIC, 4), **dict.fromkeys([*TRAFFIC, *TRAFFIC_COUNTS], 3), **dict.fromkeys(WEATHER, 2), "dist_to_prev_stop": 1}
    return out.withColumns({c: F.round(F.col(c).cast("double"), n) for c, n in digits.items()})
