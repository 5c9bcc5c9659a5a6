"""The whole build against a direct reading of the rules on a small hand-made day."""
import datetime as dt
import math
import random

from pyspark.sql import functions as F

from lateline.operators import joins as J
from lateline.operators.quality import build_rules, has_failures, validate
from lateline.plans import dataset as B
from lateline.schema import ACTUALS_COLUMNS

RAW = ["PRODUCT_ID", *ACTUALS_COLUMNS]


def stamp(t, seconds=False):
    return t.strftime("%d.%m.%Y %H:%M:%S" if seconds else "%d.%m.%Y %H:%M")


def make_rows(seed=5):
    rng = random.Random(seed)
    day = dt.datetime(2025, 8, 1)
    rows = []
    for trip in range(12):
        at = day + dt.timedelta(minutes=rng.randrange(60 * 22, 60 * 24 + 30) if trip % 4 == 0 else rng.randrange(300, 1200))
        for stop in range(rng.randrange(2, 9)):
            at += dt.timedelta(minutes=rng.randrange(1, 4))
            delay = rng.choice([-121, -120, 0, 30, 95, 1800, 1801, None])
            dep = rng.choice([None, 10, 1799, 1900])
            rows.append(dict(
                PRODUCT_ID=rng.choice(["BUS", "bus", "Bus", "Zug"]) if stop == 3 else "Bus", DATE=day.strftime("%d.%m.%Y"), TRIP_ID=f"t{trip}",
                OPERATOR_ABB="MBC", LINE_NAME="705", BPUIC=str(100 + rng.randrange(8)), STOP_NAME=f"s{stop}",
                ARRIVAL_TIME=stamp(at), DEPARTURE_TIME=stamp(at + dt.timedelta(minutes=1)),
                ARRIVAL_FORECAST=stamp(at + dt.timedelta(seconds=delay), True) if delay is not None else "bad",
                ARRIVAL_FORECAST_STATUS=rng.choice(["REAL", "REAL", "REAL", "PROGNOSE"]),
                DEPARTURE_FORECAST=stamp(at + dt.timedelta(seconds=60 + dep), True) if dep is not None else None,
                DEPARTURE_FORECAST_STATUS="REAL", ADDITIONAL_TRIP="false", CANCELLED=rng.choice(["false", "false", "false", "true"]), PASS_THROUGH="0"))
    return rows


def expected(rows, stops):
    kept = []
    for r in rows:
        if r["PRODUCT_ID"].lower() != "bus" or r["CANCELLED"] == "true":
            continue
        arr = dep = None
        sched = dt.datetime.strptime(r["ARRIVAL_TIME"], "%d.%m.%Y %H:%M")
        dsched = dt.datetime.strptime(r["DEPARTURE_TIME"], "%d.%m.%Y %H:%M")
        if r["ARRIVAL_FORECAST_STATUS"] == "REAL" and r["ARRIVAL_FORECAST"] != "bad":
            arr = int((dt.datetime.strptime(r["ARRIVAL_FORECAST"], "%d.%m.%Y %H:%M:%S") - sched).total_seconds())
        if r["DEPARTURE_FORECAST"]:
            dep = int((dt.datetime.strptime(r["DEPARTURE_FORECAST"], "%d.%m.%Y %H:%M:%S") - dsched).total_seconds())
        ok = (arr is not None or dep is not None) and all(d is None or -120 <= d <= 1800 for d in (arr, dep))
        if ok:
            kept.append((sched, r["TRIP_ID"], int(r["BPUIC"]), arr, dep))
    out, groups = set(), {}
    for k in kept:
        groups.setdefault((k[0].date(), k[1]), []).append(k)
    for rows_ in groups.values():
        rows_.sort(key=lambda k: k[0])
        for i, k in enumerate(rows_):
            if i == 0 or rows_[i - 1][3] is None:
                continue
            a, b = stops.get(rows_[i - 1][2]), stops.get(k[2])
            dist = math.dist(a, b) if a and b else None
            if dist == 0:
                continue
            out.add((k[0], k[1], k[2], k[3], k[4], rows_[i - 1][3], i, None if dist is None else round(dist, 1)))
    return out


def dims(spark):
    stops = {100 + i: (2600000.0 + 300 * i, 1200000.0 + 100 * (i % 3)) for i in range(7)}  # 107 is unknown
    rows = [(str(k), e, n, "VD" if k % 2 else "ZH", "Lausanne") for k, (e, n) in stops.items()] + [("x1", 0.0, 0.0, "BE", "x")]
    rows += [("0100", 1.0, 1.0, "BE", "old")]  # same id spelled differently, earlier in order
    return stops, spark.createDataFrame(rows, "number string, lv95east double, lv95north double, cantonabbreviation string, municipalityname string")


def test_trip_features_match_rules(spark):
    rows = make_rows()
    stops, table = dims(spark)
    raw = spark.createDataFrame([tuple(r[c] for c in RAW) for r in rows], ", ".join(f"{c} string" for c in RAW))
    for hot in (1, 10**6):
        out = B.with_trip(B.base_features(B.with_delays(B.clean(raw))), B.stop_dim(table), hot_rows=hot)
        got = {(r.timestamp, r.trip_id, r.stop_id, r.arrival_delay_s, r.departure_delay_s, r.prev_stop_delay, r.trip_stop_index,
                None if r.dist_to_prev_stop is None else round(r.dist_to_prev_stop, 1)) for r in out.collect()}
        assert got == expected(rows, stops) and got


def test_full_build_has_all_columns(spark):
    stops, table = dims(spark)
    raw = spark.createDataFrame([tuple(r[c] for c in RAW) for r in make_rows(9)], ", ".join(f"{c} string" for c in RAW))
    holidays = J.holiday_dim(spark.createDataFrame([(2025,)], "year int"))
    roads = spark.createDataFrame([(1, 2600000.0, 2600500.0, 1200000.0, 1200100.0, 1000.0, 900.0, 80.0, 120.0, 800.0, 50.0, 30.0, 20.0),
                                   (2, 2601500.0, 2601900.0, 1200000.0, 1200100.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)],
                                  "id long, minx double, maxx double, miny double, maxy double, dtv_fzg double, dwv_fzg double, msp_fzg double, asp_fzg double, dtv_pw double, dtv_lw double, dtv_lz double, dtv_li double")
    stations = spark.createDataFrame([("A", 46.95, 7.44), ("B", 47.5, 8.5)], "station_id string, lat double, lon double")
    hours = spark.range(0, 72).selectExpr("timestamp_ntz'2025-07-31 00:00:00' + make_dt_interval(0, cast(id as int)) as timestamp", "cast(id as float) as v")
    from lateline.schema import WEATHER
    weather = hours.select(F.explode(F.array(F.lit("A"), F.lit("B"))).alias("station_id"), "timestamp", *[F.col("v").alias(c) for c in WEATHER])
    out = B.build_features(raw, table, holidays, roads, stations, weather)
    rows = out.collect()
    assert rows
    for r in rows:
        hour_utc = (r.timestamp - dt.timedelta(hours=2)).replace(minute=0) - dt.datetime(2025, 7, 31)
        assert r.temperature == hour_utc.total_seconds() / 3600
        assert r.is_public_holiday == (r.stop_id != 107)  # 1 August in every canton; unknown stop has none
        assert r.traffic_dtv in (0.0, 1000.0) and r.traffic_heavy_share in (0.0, 0.08)
        if r.traffic_dtv:
            assert r.traffic_peak == (80.0 if r.timestamp.hour < 12 else 120.0)
    assert not has_failures(validate(out, build_rules()))


def test_holidays(spark):
    dim = {(r.date.isoformat(), r.canton) for r in J.holiday_dim(spark.createDataFrame([(2026,)], "year int")).collect()}
    vaud = {d for d, c in dim if c == "VD"}
    assert vaud == {"2026-01-01", "2026-01-02", "2026-04-03", "2026-04-05", "2026-04-06", "2026-05-14", "2026-05-24", "2026-05-25",
                    "2026-08-01", "2026-09-21", "2026-12-25"}


def test_duplicate_dimension_rows_do_not_multiply(spark):
    _, table = dims(spark)
    dim = B.stop_dim(table.unionByName(table))
    assert dim.count() == dim.select("stop_id").distinct().count() == 7


def test_semi_and_anti(spark):
    fact = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    dim = spark.createDataFrame([(1,), (1,)], "k int")
    assert [r.k for r in J.matched(fact, dim, {"k": "k"}).collect()] == [1]
    assert sorted((r.k or 0) for r in J.unmatched(fact, dim, {"k": "k"}).collect()) == [0, 2]


def test_no_text_is_parsed_in_a_filter(spark):
    # There each use of a delay is its whole expression again: every text was formatted and parsed dozens of times.
    raw = spark.createDataFrame([], ", ".join(f"{c} string" for c in RAW)).withColumns({c: F.concat(c, F.lit("")) for c in RAW if "TIME" in c or "FORECAST" in c})
    plan = B.with_delays(B.clean(raw))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_make_timestamp_ntz") == 4
    assert not [line for line in plan.splitlines() if "Filter" in line and "try_make_timestamp_ntz" in line]
