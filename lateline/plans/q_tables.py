"""Registered queries: joins, aggregates, windows, sorts, set operations and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import conditions as C
from ..functions import delays as D
from ..functions import timeparts as P
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import nearest as N
from ..operators import quantiles as Q
from ..operators import sampling as X
from ..operators import windows as W
from ..operators.joins import CANTONS, EASTER_RULES, FIXED_DATE_RULES, WEEKDAY_RULES
from .registry import OBS_SQL, observations, query, table

BINS = [5.0, 20.0, 60.0]
_CLS = "(CAST({x} > 5 AS INTEGER) + CAST({x} > 20 AS INTEGER) + CAST({x} > 60 AS INTEGER))"


def _r(c, n=6):
    return F.round(c, n)


def _events(spark, d):
    return table(spark, d, "events")


# --- joins ----------------------------------------------------------------------------------------

def _holiday_sql(years: str) -> str:
    """The rule tables as DuckDB SQL over a one-column query of years."""
    def in_list(names):
        return "['" + "', '".join((CANTONS if names == "*" else names).split()) + "']"

    parts = [f"SELECT make_date(y, {m}, {d}) AS date, unnest({in_list(c)}) AS canton FROM ys" for _, m, d, c in FIXED_DATE_RULES]
    parts += [f"SELECT CAST(easter + {k} AS DATE), unnest({in_list(c)}) FROM ys" for _, k, c in EASTER_RULES]
    nth = {"SUN": 7, "THU": 4}
    first = "(make_date(y, {m}, 1) + CAST((({w} - isodow(make_date(y, {m}, 1)) + 7) % 7) AS INTEGER))"
    parts += [f"SELECT CAST({first.format(m=m, w=nth[w])} + {k} AS DATE), unnest({in_list(c)}) FROM ys" for _, m, w, k, c in WEEKDAY_RULES]
    april = first.format(m=4, w=4)
    parts.append(f"SELECT CAST(CASE WHEN {april} = easter - 3 THEN {april} + 7 ELSE {april} END AS DATE), 'GL' FROM ys")
    return f"""y0 AS ({years}),
y1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y0),
y2 AS (SELECT *, (19 * a + b - b // 4 - ((b - (b + 8) // 25 + 1) // 3) + 15) % 30 AS h FROM y1),
y3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - (c % 4)) % 7 AS l FROM y2),
y4 AS (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM y3),
ys AS (SELECT y, make_date(y, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) AS easter FROM y4),
hol AS (SELECT DISTINCT date, canton FROM ({' UNION ALL '.join(parts)}))"""


_YEARS = "SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y FROM orders"


def _holidays(spark, d):
    years = table(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return J.holiday_dim(years)


@query("j02_holiday_dimension", f"WITH {_holiday_sql(_YEARS)} SELECT date, canton, true AS is_public_holiday FROM hol")
def _(spark, d):
    return _holidays(spark, d)


@query("j01_public_holidays", f"""WITH {_holiday_sql(_YEARS)},
stop AS (SELECT c_custkey AS stop_id, string_split('{CANTONS}', ' ')[c_nationkey + 1] AS canton FROM customer)
SELECT o_orderkey, coalesce(hol.canton IS NOT NULL, false) AS is_public_holiday FROM orders
LEFT JOIN stop ON o_custkey = stop_id LEFT JOIN hol ON stop.canton = hol.canton AND CAST(o_orderdate AS DATE) = hol.date""")
def _(spark, d):
    stops = table(spark, d, "customer").select(
        F.col("c_custkey").alias("stop_id"), F.get(F.split(F.lit(CANTONS), " "), F.col("c_nationkey")).alias("canton"))
    o = table(spark, d, "orders")
    return J.add_holidays(o, stops, _holidays(spark, d), stop_id="o_custkey", day=P.service_date("o_orderdate")).select(
        "o_orderkey", "is_public_holiday")


@query("j03_nearest_station", """
WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS tx, embedding[4]::DOUBLE AS ty FROM embeddings),
c AS (SELECT a.vec_id, b.vec_id AS station, (b.tx - a.x) * (b.tx - a.x) + (b.ty - a.y) * (b.ty - a.y) AS d2 FROM p a CROSS JOIN p b),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, station) AS rn FROM c)
SELECT vec_id, station, round(d2, 9) AS d2 FROM r WHERE rn = 1""")
def _(spark, d):
    e = [F.get("embedding", F.lit(i)).cast("double") for i in range(4)]
    p = table(spark, d, "embeddings").select("vec_id", *[c.alias(n) for c, n in zip(e, ("x", "y", "tx", "ty"))])
    near = N.nearest_point(p.select("vec_id", "x", "y"), p.select(F.col("vec_id").alias("sid"), "tx", "ty"),
                           point_key="vec_id", x="x", y="y", target_key="sid", tx="tx", ty="ty", out="station")
    return near.select("vec_id", "station", _r(F.col("d2"), 9).alias("d2"))


@query("j04_nearest_road_box", """
WITH e AS (SELECT vec_id, embedding[1]::DOUBLE * 20000 AS x, embedding[2]::DOUBLE * 20000 AS y,
  embedding[3]::DOUBLE * 20000 AS x0, embedding[4]::DOUBLE * 20000 AS y0,
  abs(embedding[5]::DOUBLE) * 1000 AS w, abs(embedding[6]::DOUBLE) * 1000 AS h FROM embeddings),
c AS (SELECT p.vec_id, b.vec_id AS road, greatest(b.x0 - p.x, 0, p.x - (b.x0 + b.w)) AS dx, greatest(b.y0 - p.y, 0, p.y - (b.y0 + b.h)) AS dy FROM e p CROSS JOIN e b),
g AS (SELECT *, CASE WHEN greatest(dx, dy) <= 500 THEN 0 WHEN greatest(dx, dy) <= 1000 THEN 1 WHEN greatest(dx, dy) <= 2000 THEN 2
  WHEN greatest(dx, dy) <= 5000 THEN 3 ELSE 4 END AS band FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY band, dx * dx + dy * dy, road) AS rn FROM g WHERE band < 4)
SELECT vec_id, road, round(dx * dx + dy * dy, 3) AS d2 FROM r WHERE rn = 1""")
def _(spark, d):
    e = [F.get("embedding", F.lit(i)).cast("double") for i in range(6)]
    p = table(spark, d, "embeddings").select(
        "vec_id", (e[0] * 20000).alias("east"), (e[1] * 20000).alias("north"), (e[2] * 20000).alias("minx"),
        (e[3] * 20000).alias("miny"), (F.abs(e[4]) * 1000).alias("w"), (F.abs(e[5]) * 1000).alias("h"))
    boxes = p.select(F.col("vec_id").alias("id"), "minx", (F.col("minx") + F.col("w")).alias("maxx"), "miny",
                     (F.col("miny") + F.col("h")).alias("maxy"))
    near = J.nearest_road(p.select(F.col("vec_id").alias("stop_id"), "east", "north"), boxes)
    return near.select(F.col("stop_id").alias("vec_id"), "road", _r(F.col("d2"), 3).alias("d2"))


_UTC = "date_trunc('hour', (ts AT TIME ZONE 'Europe/Zurich') AT TIME ZONE 'UTC')"


@query("j05_hourly_weather", f"""
WITH w AS (SELECT event_type AS station_id, date_trunc('hour', ts) AS hour, round(avg(value), 6) AS temperature FROM events GROUP BY 1, 2),
s AS (SELECT user_id AS stop_id, arg_min(event_type, event_id) AS station FROM events GROUP BY user_id)
SELECT event_id, w.temperature FROM events LEFT JOIN s ON user_id = stop_id
LEFT JOIN w ON s.station = w.station_id AND w.hour = {_UTC}""")
def _(spark, d):
    e = _events(spark, d)
    weather = e.groupBy(F.col("event_type").alias("station_id"), P.hour_floor("ts").alias("timestamp")).agg(
        _r(F.avg("value")).alias("temperature"))
    stops = e.groupBy(F.col("user_id").alias("stop_id")).agg(F.min_by("event_type", "event_id").alias("weather_station"))
    obs = e.select("event_id", F.col("user_id").alias("stop_id"), "ts")
    return J.add_weather(obs, stops, weather, ts="ts", columns=["temperature"]).select("event_id", "temperature")


@query("j06_traffic_inner", """
WITH t AS (SELECT s_suppkey, s_acctbal AS dtv, s_acctbal * 0.1 AS msp, s_acctbal * 0.2 AS asp FROM supplier WHERE s_acctbal > 1000)
SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, dtv AS traffic_dtv,
  round(CASE WHEN l_linenumber < 4 THEN msp ELSE asp END, 6) AS traffic_peak FROM lineitem JOIN t ON l_suppkey = s_suppkey""")
def _(spark, d):
    t = table(spark, d, "supplier").filter("s_acctbal > 1000").selectExpr(
        "s_suppkey as stop_id", "s_acctbal as traffic_dtv", "s_acctbal * 0.1D as traffic_msp", "s_acctbal * 0.2D as traffic_asp")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_suppkey")
    # Line numbers stand in for the hour, so both halves of the day occur.
    out = J.add_traffic(li, t, hour=F.when(F.col("l_linenumber") < 4, 8).otherwise(17), stop_id="l_suppkey")
    return out.drop("l_suppkey").withColumn("traffic_peak", _r(F.col("traffic_peak")))


@query("j07_region_filter", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  WHERE n_name IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_5', 'NATION_8', 'NATION_13', 'NATION_21', 'NATION_24'))""")
def _(spark, d):
    stops = J.lookup(table(spark, d, "customer"), table(spark, d, "nation"), {"c_nationkey": "n_nationkey"}, {"n_name": "municipalityname"}).select(
        F.col("c_custkey").cast("string").alias("number"), "municipalityname")
    wanted = [f"NATION_{i}" for i in (1, 2, 3, 5, 8, 13, 21, 24)]
    return J.in_region(table(spark, d, "orders"), stops, wanted, stop_id="o_custkey").select("o_orderkey", "o_custkey")


@query("j08_coordinates_left", """
SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, s_acctbal AS east FROM lineitem
LEFT JOIN (SELECT * FROM supplier WHERE s_nationkey <> 3) s ON l_suppkey = s_suppkey""")
def _(spark, d):
    s = table(spark, d, "supplier").filter("s_nationkey <> 3")
    return J.lookup(table(spark, d, "lineitem"), s, {"l_suppkey": "s_suppkey"}, {"s_acctbal": "east"}).select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "east")


@query("j11_last_per_key", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS rn FROM lineitem)
SELECT l_orderkey, l_shipdate, l_linenumber, l_quantity FROM r WHERE rn = 1""")
def _(spark, d):
    return J.last_per_key(table(spark, d, "lineitem"), ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey", "l_extendedprice"]).select(
        "l_orderkey", "l_shipdate", "l_linenumber", "l_quantity")


@query("j12_unmatched", """
SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment <> 'BUILDING')""")
def _(spark, d):
    return J.unmatched(table(spark, d, "orders"), table(spark, d, "customer").filter("c_mktsegment <> 'BUILDING'"), {"o_custkey": "c_custkey"}).select("o_orderkey")


# --- aggregates -----------------------------------------------------------------------------------

@query("a01_counts", """
SELECT count(*) AS rows, count(*) FILTER (WHERE value > 60) AS late, count(*) FILTER (WHERE event_type = 'click') AS clicks FROM events""")
def _(spark, d):
    return A.counts(_events(spark, d), {"late": F.col("value") > 60, "clicks": F.col("event_type") == "click"})


@query("a02_null_counts", f"""WITH o AS ({OBS_SQL}), n AS (SELECT count(*) AS n, count(arr) AS a, count(dep) AS b, count(price) AS p FROM o)
SELECT 'arr' AS "column", n - a AS nulls, round((n - a) / n, 6) AS null_rate FROM n UNION ALL SELECT 'dep', n - b, round((n - b) / n, 6) FROM n
UNION ALL SELECT 'price', n - p, round((n - p) / n, 6) FROM n""")
def _(spark, d):
    return A.null_counts(observations(spark, d), ["arr", "dep", "price"]).withColumn("null_rate", _r(F.col("null_rate")))


@query("a03_min_max", "SELECT min(l_shipdate) AS first_day, max(l_shipdate) AS last_day, min(l_quantity) AS lo, max(l_extendedprice) AS hi FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").agg(
        F.min("l_shipdate").alias("first_day"), F.max("l_shipdate").alias("last_day"), F.min("l_quantity").alias("lo"), F.max("l_extendedprice").alias("hi"))


@query("a04_true_share", f"""WITH o AS ({OBS_SQL}) SELECT operator, round(avg(CAST(additional_trip AS DOUBLE)), 6) AS share FROM o GROUP BY operator""")
def _(spark, d):
    return observations(spark, d).groupBy("operator").agg(_r(A.true_share("additional_trip")).alias("share"))


@query("a05_stddev", "SELECT l_returnflag, round(stddev_samp(l_extendedprice), 3) AS sd FROM lineitem GROUP BY l_returnflag")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(_r(F.stddev_samp("l_extendedprice"), 3).alias("sd"))


@query("a06_count_distinct", "SELECT l_linestatus, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS stops FROM lineitem GROUP BY l_linestatus")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("stops"))


@query("a07_share_by_month", """
SELECT CAST(month(l_shipdate) AS INTEGER) AS m, count(*) AS n, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS share FROM lineitem GROUP BY month(l_shipdate)""")
def _(spark, d):
    return A.share_of_total(table(spark, d, "lineitem"), {"m": F.month("l_shipdate")}).withColumn("share", _r(F.col("share")))


@query("a07_share_by_hour", """
SELECT CAST(hour(ts) AS INTEGER) AS h, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY hour(ts)""")
def _(spark, d):
    return A.share_of_total(_events(spark, d), {"h": F.hour("ts")}).withColumn("share", _r(F.col("share")))


@query("a08_group_and_global_mean", """
SELECT event_type, CAST(hour(ts) AS INTEGER) AS hour, round(avg(value), 6) AS group_mean, count(*) AS n, round((SELECT avg(value) FROM events), 6) AS global_mean
FROM events GROUP BY event_type, hour(ts)""")
def _(spark, d):
    g = A.group_and_global_mean(_events(spark, d).withColumn("hour", F.hour("ts")), ["event_type", "hour"], "value")
    return g.withColumns({"group_mean": _r(F.col("group_mean")), "global_mean": _r(F.col("global_mean"))})


@query("a09_median_global", "SELECT round(median(l_quantity), 6) AS l_quantity, round(median(l_extendedprice), 6) AS l_extendedprice FROM lineitem")
def _(spark, d):
    m = Q.medians(table(spark, d, "lineitem"), [], ["l_quantity", "l_extendedprice"])
    return m.select(*[_r(F.col(c)).alias(c) for c in m.columns])


_MEDS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("a09_median_by_key", "SELECT l_returnflag, l_linestatus, " + ", ".join(f"round(median({c}), 6) AS {c}" for c in _MEDS)
       + " FROM lineitem GROUP BY l_returnflag, l_linestatus")
def _(spark, d):
    m = Q.medians(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], _MEDS)
    return m.select("l_returnflag", "l_linestatus", *[_r(F.col(c)).alias(c) for c in _MEDS])


@query("a10_quantile_edges", "SELECT " + ", ".join(f"round(quantile_cont(o_totalprice, {i / 10}), 4) AS e{i}" for i in range(11)) + " FROM orders")
def _(spark, d):
    q = Q.exact_quantiles(table(spark, d, "orders"), [], "o_totalprice", [i / 10 for i in range(11)], [f"e{i}" for i in range(11)])
    return q.select(*[_r(F.col(c), 4).alias(c) for c in q.columns])


@query("a11_bucket_counts", """
WITH b AS (SELECT CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_totalprice <= 100000 THEN 0 WHEN o_totalprice > 300000 THEN 2 ELSE 1 END AS stratum FROM orders)
SELECT stratum, count(*) AS n FROM b GROUP BY stratum HAVING stratum IS NOT NULL""")
def _(spark, d):
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    o = table(spark, d, "orders").select(X.stratum_of(price, [0.0, 100000.0, 300000.0, 1e9]).alias("stratum"))
    return o.groupBy("stratum").agg(F.count("*").alias("n")).filter(F.col("stratum").isNotNull())


_PRECIP = [-1.0, 5.0, 15.0, 40.0, 90.0, 100000.0]
_LABELS = ["lowest", "low", "middle", "high", "highest"]
_PICK = {n: f"avg(user_id) FILTER (WHERE bin = '{n}')" for n in _LABELS}


@query("a13_pivot_mean_filled", "WITH b AS (SELECT CAST(hour(ts) * 31 + day(ts) AS INTEGER) AS cell, user_id, CASE "
       + " ".join(f"WHEN value > {a} AND value <= {b} THEN '{n}'" for a, b, n in zip(_PRECIP, _PRECIP[1:], _LABELS))
       + " END AS bin FROM events), p AS (SELECT cell, " + ", ".join(f'{v} AS "{k}"' for k, v in _PICK.items())
       + " FROM b WHERE bin IS NOT NULL GROUP BY cell) SELECT cell, " + ", ".join(
           f"round(coalesce({', '.join(_LABELS[i::-1] + _LABELS[i + 1:])}), 6) AS {n}" for i, n in enumerate(_LABELS)) + " FROM p")
def _(spark, d):
    e = _events(spark, d).select((F.hour("ts") * 31 + F.day("ts")).alias("cell"), "user_id", A.binned_label("value", _PRECIP, _LABELS).alias("bin"))
    p = A.pivot_mean(e, "cell", "bin", _LABELS, "user_id")
    return p.select("cell", *[_r(F.col(n)).alias(n) for n in _LABELS])


@query("a14_class_distribution", f"""
SELECT {_CLS.format(x='value')} AS cls, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1""")
def _(spark, d):
    return A.class_distribution(_events(spark, d), "value", BINS).withColumn("share", _r(F.col("share")))


@query("a15_row_with_max", """
SELECT event_id, user_id, event_type, value FROM events ORDER BY value DESC, event_id LIMIT 1""")
def _(spark, d):
    return A.row_with_max(_events(spark, d), "value", ["event_id"]).select("event_id", "user_id", "event_type", "value")


_PAIR = f"""WITH o AS ({OBS_SQL}), m AS (SELECT arr AS y, dep + quantity AS p FROM o WHERE arr IS NOT NULL AND dep IS NOT NULL)"""


@query("a16_regression_metrics", _PAIR + """
SELECT count(*) AS n, round(avg((y - p) * (y - p)), 4) AS mse, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse,
  round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2 FROM m""")
def _(spark, d):
    o = observations(spark, d).select(F.col("arr").alias("label"), (F.col("dep") + F.col("quantity")).alias("prediction"))
    m = M.regression_metrics(o)
    return m.select("n", *[_r(F.col(c), k).alias(c) for c, k in (("mse", 4), ("rmse", 4), ("r2", 6))])


# Class of a value against class of the previous value of the same user.
_YP = f"""WITH l AS (SELECT value, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events),
yp AS (SELECT {_CLS.format(x='value')} AS y, {_CLS.format(x='prev')} AS p FROM l WHERE prev IS NOT NULL)"""


def _classes(spark, d):
    l = W.previous_value(_events(spark, d), ["user_id"], ["ts"], "value", "prev", chunk=F.unix_date(F.to_date("ts")))
    l = l.filter(F.col("prev").isNotNull())
    return l.select(D.delay_class("value", BINS).alias("label"), D.delay_class("prev", BINS).alias("prediction"))


@query("a17_confusion", _YP + " SELECT y AS actual, " + ", ".join(f"count(*) FILTER (WHERE p = {i}) AS pred_{i}" for i in range(4)) + " FROM yp GROUP BY y")
def _(spark, d):
    return M.confusion(_classes(spark, d), [0, 1, 2, 3])


_REPORT = _YP + """, k AS (SELECT unnest([0, 1, 2, 3]) AS cls), c AS (SELECT cls, (SELECT count(*) FROM yp WHERE y = cls AND p = cls) AS tp,
  (SELECT count(*) FROM yp WHERE y = cls) AS support, (SELECT count(*) FROM yp WHERE p = cls) AS predicted FROM k),
r AS (SELECT cls, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
  CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END AS f1, support FROM c)"""


@query("a18_class_report", _REPORT + " SELECT cls, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM r")
def _(spark, d):
    r = M.class_report(_classes(spark, d))
    return r.select("cls", *[_r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("a18_class_summary", _REPORT + """
SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(recall * support) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1,
  round(avg(precision), 6) AS macro_precision, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM r""")
def _(spark, d):
    s = M.class_summary(_classes(spark, d))
    return s.select("n", *[_r(F.col(c)).alias(c) for c in ("accuracy", "macro_f1", "macro_precision", "weighted_f1")])


@query("a18_label_metrics", """
WITH k AS (SELECT unnest([0, 1]) AS cls), c AS (SELECT cls, (SELECT count(*) FROM labels WHERE quality = cls AND toxic = cls) AS tp,
  (SELECT count(*) FROM labels WHERE quality = cls) AS support, (SELECT count(*) FROM labels WHERE toxic = cls) AS predicted FROM k)
SELECT cls, round(tp / predicted, 6) AS precision, round(tp / support, 6) AS recall, support FROM c""")
def _(spark, d):
    r = M.class_report(table(spark, d, "labels"), "quality", "toxic")
    return r.select("cls", _r(F.col("precision")).alias("precision"), _r(F.col("recall")).alias("recall"), "support")


_WEIGHTS = "WITH n AS (SELECT event_type, count(*) AS n FROM events WHERE value > 20 OR event_type <> 'view' GROUP BY event_type) "


@query("a19_class_weights", _WEIGHTS + "SELECT event_type, n, round((SELECT sum(n) FROM n) / ((SELECT count(*) FROM n) * n), 6) AS weight FROM n")
def _(spark, d):
    e = _events(spark, d).filter("value > 20 or event_type <> 'view'")
    return M.class_weights(e, "event_type").withColumn("weight", _r(F.col("weight")))


@query("a19b_sqrt_class_weights", _WEIGHTS + "SELECT event_type, n, round(sqrt((SELECT sum(n) FROM n) / ((SELECT count(*) FROM n) * n)), 6) AS weight FROM n")
def _(spark, d):
    e = _events(spark, d).filter("value > 20 or event_type <> 'view'")
    return M.class_weights(e, "event_type", "sqrt_balanced").withColumn("weight", _r(F.col("weight")))


@query("a20_distinct_days", "SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem")
def _(spark, d):
    return A.ordered_distinct(table(spark, d, "lineitem").select(P.service_date("l_shipdate").alias("day")), "day")


@query("a21_late_share", "SELECT event_type, round(avg(CAST(value >= 90 AS DOUBLE)), 6) AS late FROM events GROUP BY event_type")
def _(spark, d):
    return _events(spark, d).groupBy("event_type").agg(_r(A.true_share(D.is_late("value"))).alias("late"))


@query("a22_hour_summary", """
SELECT CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS dow, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(value) AS n
FROM events GROUP BY hour(ts), isodow(ts)""")
def _(spark, d):
    s = A.group_summary(_events(spark, d), [F.hour("ts").alias("hour"), P.day_of_week("ts").alias("dow")], "value")
    return s.withColumns({"mean": _r(F.col("mean")), "std": _r(F.col("std"))})


@query("a23_correlation", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").agg(_r(F.corr("l_quantity", "l_extendedprice")).alias("r"))


@query("a24_leaderboard", """
WITH m AS (SELECT event_type AS name, CAST(isodow(ts) AS INTEGER) AS run, round(avg(value), 6) AS score FROM events GROUP BY event_type, isodow(ts)),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC) AS rn FROM m) SELECT name, run, score FROM r WHERE rn = 1""")
def _(spark, d):
    m = _events(spark, d).groupBy(F.col("event_type").alias("name"), (P.day_of_week("ts") + 1).alias("run")).agg(_r(F.avg("value")).alias("score"))
    return M.leaderboard(m, "score")


# --- windows --------------------------------------------------------------------------------------

_DAYTRIP = "PARTITION BY CAST(ts AS DATE), user_id ORDER BY ts"


def _daily(spark, d, **kw):
    e = _events(spark, d).select("event_id", "ts", "user_id", "value", P.service_date("ts").alias("service_date"))
    return W.with_previous(e, ["service_date", "user_id"], ["ts"], lags={"prev": "value"}, index="pos", base=1, chunk=W.MEASURED, **kw)


@query("w01_lag_by_day_trip", f"SELECT event_id, lag(value) OVER ({_DAYTRIP}) AS prev FROM events")
def _(spark, d):
    return _daily(spark, d).select("event_id", "prev")


@query("w01_lag_hot_keys", """
SELECT event_id, lag(value) OVER w AS prev, CAST(row_number() OVER w AS INTEGER) AS pos FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""")
def _(spark, d):
    # Five keys hold all rows, so every key is cut.
    return W.with_previous(_events(spark, d), ["event_type"], ["ts", "event_id"], lags={"prev": "value"}, index="pos", base=1,
                           chunk=W.MEASURED, hot_rows=500, chunk_rows=2000).select("event_id", "prev", "pos")


@query("w01_class_profile", f"""
WITH l AS (SELECT value, lag(value) OVER w AS prev, row_number() OVER w AS pos FROM events WINDOW w AS ({_DAYTRIP}))
SELECT {_CLS.format(x='value')} AS cls, count(*) AS n, count(prev) AS with_prev, round(avg(prev), 6) AS mean_prev, CAST(max(pos) AS INTEGER) AS longest FROM l GROUP BY 1""")
def _(spark, d):
    return _daily(spark, d).groupBy(D.delay_class("value", BINS).alias("cls")).agg(
        F.count("*").alias("n"), F.count("prev").alias("with_prev"), _r(F.avg("prev")).alias("mean_prev"), F.max("pos").alias("longest"))


@query("w02_lag_filled", f"""
SELECT event_id, round(CAST(CAST(coalesce(lag(value) OVER ({_DAYTRIP}), (SELECT median(value) FROM events)) AS FLOAT) AS DOUBLE), 3) AS prev FROM events""")
def _(spark, d):
    e = _events(spark, d).select("event_id", "ts", "user_id", "value", P.service_date("ts").alias("service_date"))
    default = Q.medians(e, [], ["value"]).first()[0]
    out = W.previous_value_filled(e, ["service_date", "user_id"], ["ts"], "value", "prev", default, chunk=W.MEASURED)
    return out.select("event_id", _r(F.col("prev").cast("double"), 3).alias("prev"))


_POS = "PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_POS_ORDER = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query("w03_position_zero_based", f"SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, CAST(row_number() OVER ({_POS}) - 1 AS INTEGER) AS pos FROM lineitem")
def _(spark, d):
    return W.position(table(spark, d, "lineitem"), ["l_orderkey"], _POS_ORDER, "pos", 0, chunk=W.MEASURED).select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "pos")


@query("w04_position_one_based", f"SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, CAST(row_number() OVER ({_POS}) AS SMALLINT) AS pos FROM lineitem")
def _(spark, d):
    out = W.position(table(spark, d, "lineitem"), ["l_orderkey"], _POS_ORDER, "pos", 1, chunk=W.MEASURED)
    return out.select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", F.col("pos").cast("smallint").alias("pos"))


@query("w05_distance_in_trip", f"""
WITH l AS (SELECT l_orderkey, l_partkey, l_linenumber, l_quantity AS x, l_extendedprice AS y, lag(l_quantity) OVER w AS px, lag(l_extendedprice) OVER w AS py
FROM lineitem WINDOW w AS ({_POS})), g AS (SELECT *, sqrt(pow(x - px, 2) + pow(y - py, 2)) AS dist FROM l)
SELECT l_orderkey, l_partkey, l_linenumber, round(dist, 4) AS dist FROM g WHERE dist > 0""")
def _(spark, d):
    out = W.distance_to_previous(table(spark, d, "lineitem"), ["l_orderkey"], _POS_ORDER, "l_quantity", "l_extendedprice", "dist",
                                 chunk=W.MEASURED)
    return out.filter("dist > 0").select("l_orderkey", "l_partkey", "l_linenumber", _r(F.col("dist"), 4).alias("dist"))


@query("w06_distance_in_file_order", """
WITH l AS (SELECT event_id, user_id, value AS x, CAST(event_id % 97 AS DOUBLE) AS y, lag(user_id) OVER w AS pu, lag(value) OVER w AS px, lag(CAST(event_id % 97 AS DOUBLE)) OVER w AS py
FROM events WINDOW w AS (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id))
SELECT event_id, CASE WHEN pu = user_id THEN round(sqrt(pow(x - px, 2) + pow(y - py, 2)), 6) END AS dist FROM l""")
def _(spark, d):
    e = _events(spark, d).select("event_id", "ts", "user_id", "value", (F.col("event_id") % 97).cast("double").alias("y"), P.service_date("ts").alias("day"))
    # A day is the hot key here, so it is always cut.
    out = W.distance_to_previous(e, ["day"], ["ts", "event_id"], "value", "y", "dist", same="user_id", chunk=W.MEASURED, hot_rows=0, chunk_rows=1000)
    return out.select("event_id", _r(F.col("dist")).alias("dist"))


def _md5(key: str, seed: int = 42) -> str:
    return f"md5(concat_ws('|', '{seed}', {key}))"


_EK = _md5("CAST(event_id AS VARCHAR)")


@query("w07_exact_per_stratum", f"""
WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {_EK}, event_id) AS rn FROM events)
SELECT event_id, event_type FROM r WHERE rn <= 150""")
def _(spark, d):
    return X.first_by_hash(_events(spark, d), 42, ["event_id"], ["event_type"], F.lit(150)).select("event_id", "event_type")


# --- sorts and set operations ----------------------------------------------------------------------

@query("t01_trip_order", "SELECT user_id, ts, event_id FROM events ORDER BY user_id, ts")
def _(spark, d):
    return _events(spark, d).select("user_id", "ts", "event_id").repartitionByRange("user_id", "ts").sortWithinPartitions("user_id", "ts")


@query("t02_top_rows", "SELECT event_id, value FROM events WHERE value IS NOT NULL ORDER BY value DESC, event_id LIMIT 20")
def _(spark, d):
    return A.top_rows(_events(spark, d).select("event_id", "value"), "value", 20, ["event_id"])


@query("t03_first_rows", "SELECT event_id, event_type FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 100")
def _(spark, d):
    return _events(spark, d).filter("event_type = 'click'").select("event_id", "event_type").orderBy("event_id").limit(100)


@query("t04_ordered_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem ORDER BY 1, 2")
def _(spark, d):
    return A.ordered_distinct(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("u01_union_all", """
SELECT 'cheap' AS part, o_orderkey FROM orders WHERE o_totalprice <= 100000 UNION ALL SELECT 'dear', o_orderkey FROM orders WHERE o_totalprice > 300000""")
def _(spark, d):
    o = table(spark, d, "orders")
    a = o.filter("o_totalprice <= 100000").select(F.lit("cheap").alias("part"), "o_orderkey")
    return a.unionByName(o.filter("o_totalprice > 300000").select("o_orderkey", F.lit("dear").alias("part")))


@query("u02_missing_columns", "SELECT count(*) AS n, 'timestamp' AS missing FROM orders")
def _(spark, d):
    from ..operators.rows import missing_columns
    o = table(spark, d, "orders")
    return o.agg(F.count("*").alias("n")).withColumn("missing", F.lit(", ".join(missing_columns(o, ["o_orderkey", "timestamp"]))))


# --- samples and splits ----------------------------------------------------------------------------

@query("x01_sample_exact", f"SELECT event_id, value FROM events ORDER BY {_EK}, event_id LIMIT 2500")
def _(spark, d):
    return X.sample_exact(_events(spark, d), 2500, 42, ["event_id"]).select("event_id", "value")


_X02 = f"""WITH q AS (SELECT {", ".join(f"quantile_cont(o_totalprice, {i / 10}) AS e{i}" for i in range(1, 10))} FROM orders),
s AS (SELECT o_orderkey, o_totalprice, {" + ".join(f"CAST(o_totalprice > e{i} AS INTEGER)" for i in range(1, 10))} AS stratum FROM orders, q),
c AS (SELECT stratum, count(*) AS n, greatest(1, CAST(round_even(count(*) / (SELECT count(*) FROM s) * 777, 0) AS BIGINT)) AS k FROM s GROUP BY stratum),
t AS (SELECT 777 - sum(k) AS diff, arg_min(stratum, (-k, stratum)) AS big, arg_min(stratum, (k, stratum)) AS small FROM c),
a AS (SELECT stratum, k + CASE WHEN diff > 0 AND stratum = big THEN diff WHEN diff < 0 AND stratum = small THEN diff ELSE 0 END AS k FROM c, t),
r AS (SELECT s.*, row_number() OVER (PARTITION BY stratum ORDER BY {_md5('CAST(o_orderkey AS VARCHAR)')}, o_orderkey) AS rn FROM s)"""


@query("a12_proportional_allocation", _X02 + " SELECT stratum, CAST(k AS BIGINT) AS k FROM a")
def _(spark, d):
    o = table(spark, d, "orders")
    picked = X.sample_stratified(o, 777, "o_totalprice", 42, ["o_orderkey"], exact=True)
    edges = Q.exact_edges(o, "o_totalprice", 10)
    return picked.groupBy(X.stratum_of("o_totalprice", edges).alias("stratum")).agg(F.count("*").alias("k"))


@query("x02_sample_stratified", _X02 + " SELECT o_orderkey, o_totalprice FROM r JOIN a USING (stratum) WHERE rn <= k")
def _(spark, d):
    return X.sample_stratified(table(spark, d, "orders"), 777, "o_totalprice", 42, ["o_orderkey"], exact=True).select("o_orderkey", "o_totalprice")


@query("x03_sample_fraction", f"""
WITH r AS (SELECT event_id, row_number() OVER (ORDER BY {_EK}, event_id) AS rn, count(*) OVER () AS n FROM events) SELECT event_id FROM r WHERE rn <= floor(n * 0.123)""")
def _(spark, d):
    return X.sample_fraction(_events(spark, d), 0.123, 42, ["event_id"]).select("event_id")


@query("x04_train_test_exact", f"""
WITH r AS (SELECT event_id, row_number() OVER (ORDER BY {_EK}, event_id) AS rn, count(*) OVER () AS n FROM events)
SELECT event_id, CASE WHEN rn <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS part FROM r""")
def _(spark, d):
    train, test = X.train_test(_events(spark, d).select("event_id"), 42, ["event_id"], 0.2)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("x04_train_test_hash", f"""
SELECT event_id, CASE WHEN CAST('0x' || substr({_EK}, 1, 8) AS BIGINT) / 4294967296.0 < 0.2 THEN 'test' ELSE 'train' END AS part FROM events""")
def _(spark, d):
    train, test = X.train_test(_events(spark, d).select("event_id"), 42, ["event_id"], 0.2, exact=False)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("x05_stratified_split", f"""
WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {_EK}, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_id, event_type, CASE WHEN rn <= round(n * 0.2) THEN 'test' ELSE 'train' END AS part FROM r""")
def _(spark, d):
    train, test = X.stratified_train_test(_events(spark, d).select("event_id", "event_type"), "event_type", 42, ["event_id"], 0.2)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("x06_folds", f"SELECT event_id, CAST(CAST('0x' || substr({_EK}, 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold FROM events")
def _(spark, d):
    return X.with_fold(_events(spark, d), 5, 42, ["event_id"]).select("event_id", "fold")


@query("x07_stratified_folds", f"""
SELECT event_id, event_type, CAST((row_number() OVER (PARTITION BY event_type ORDER BY {_EK}, event_id) - 1) % 5 AS INTEGER) AS fold FROM events""")
def _(spark, d):
    return X.with_stratified_fold(_events(spark, d), "event_type", 5, 42, ["event_id"], hot_rows=0).select("event_id", "event_type", "fold")


@query("x08_sample_before_projection", f"SELECT vec_id, label FROM embeddings ORDER BY {_md5('CAST(vec_id AS VARCHAR)', 7)}, vec_id LIMIT 300")
def _(spark, d):
    return X.sample_exact(table(spark, d, "embeddings"), 300, 7, ["vec_id"]).select("vec_id", "label")
