import datetime as dt

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lateline.functions import conditions as C
from lateline.functions import delays as D
from lateline.functions import timeparts as P


def wrapped(gap):
    if gap <= -43200:
        gap += 86400
    if gap > 43200:
        gap -= 86400
    return gap


def test_delay_wraps_around_midnight(spark):
    day = dt.datetime(2025, 3, 1)
    cases = [(h, m, s) for h in range(0, 86400, 3660) for m, s in ((0, 0),) ]
    rows = []
    for scheduled in (0, 60, 43200, 43260, 86340):
        for seen in (0, 1, 43199, 43200, 43201, 86399, *[c[0] for c in cases]):
            rows.append((day + dt.timedelta(seconds=scheduled), day + dt.timedelta(seconds=seen), wrapped(seen - scheduled)))
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz, want int")
    got = df.select(D.time_of_day_delay("a", "b").alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)
    assert all(-43200 < r.got <= 43200 for r in got)


def test_band_keeps_one_sided_nulls(spark):
    rows = [(1, None, None), (2, -121, None), (3, -120, 1800), (4, None, 1801), (5, 1800, None), (6, 0, 1801)]
    df = spark.createDataFrame(rows, "id int, a int, b int")
    keep = lambda c: [r.id for r in df.filter(c).orderBy("id").collect()]
    assert keep(D.in_band_or_null("a", "b")) == [3, 5]
    assert keep(D.both_at_least("a", "b")) == [3, 6]
    assert keep(D.both_at_most("a", "b")) == [3]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-200, 2000), min_size=1, max_size=200), st.sets(st.integers(-100, 900), min_size=1, max_size=4))
def test_classes_are_right_closed(spark, values, edges):
    bins = sorted(edges)
    df = spark.createDataFrame([(v,) for v in values], "v int")
    for r in df.select("v", D.delay_class("v", bins).alias("c")).collect():
        assert r.c == sum(1 for b in bins if r.v > b)


def test_class_names_and_centres():
    assert D.class_names([60, 120, 300]) == ["≤60s", "60–120s", "120–300s", ">300s"]
    assert D.class_centres([60, 120, 300]) == [30.0, 90.0, 210.0, 350.0]
    assert D.class_centres([180]) == [150.0, 230.0]


def test_null_delay_has_no_class(spark):
    df = spark.createDataFrame([(None,)], "v int")
    assert df.select(D.delay_class("v", [60]).alias("c")).first().c is None


def test_parsing_never_raises(spark):
    rows = [("01.02.2025 08:30", "01.02.2025 08:30:15"), ("31.02.2025 08:30", "bad"), ("2025-02-01", ""), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(P.parse_local("a").alias("a"), P.parse_local("b", seconds=True).alias("b"), P.text_month("a").alias("m"),
                    P.text_minute_of_day("a").alias("t")).collect()
    assert got[0].a == dt.datetime(2025, 2, 1, 8, 30) and got[0].b == dt.datetime(2025, 2, 1, 8, 30, 15)
    assert [r.a for r in got[1:]] == [None] * 3 and [r.b for r in got[1:]] == [None] * 3
    assert (got[0].m, got[3].m) == (2, 1) and (got[0].t, got[3].t) == (510, 0)


def test_flags(spark):
    df = spark.createDataFrame([("True", 1, True), ("1", 0, False), ("no", None, None), (None, 5, True)], "s string, n int, b boolean")
    got = df.select(C.flag("s", "string").alias("s"), C.flag("n", "int").alias("n"), C.flag("b", "boolean").alias("b")).collect()
    assert [r.s for r in got] == [True, True, False, False]
    assert [r.n for r in got] == [True, False, False, True]
    assert [r.b for r in got] == [True, False, False, True]


def test_local_time_to_utc_hour(spark):
    cases = [  # winter, summer, skipped hour, repeated hour (second occurrence)
        (dt.datetime(2025, 1, 10, 8, 59), dt.datetime(2025, 1, 10, 7)), (dt.datetime(2025, 7, 10, 8, 1), dt.datetime(2025, 7, 10, 6)),
        (dt.datetime(2025, 3, 30, 2, 30), dt.datetime(2025, 3, 30, 1)), (dt.datetime(2025, 10, 26, 2, 30), dt.datetime(2025, 10, 26, 1)),
    ]
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            df = spark.createDataFrame(cases, "a timestamp_ntz, want timestamp_ntz")
            assert all(r.got == r.want for r in df.select(P.utc_hour("a").alias("got"), "want").collect())
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_easter(spark):
    known = {2024: (3, 31), 2025: (4, 20), 2026: (4, 5), 2027: (3, 28), 2038: (4, 25)}
    df = spark.createDataFrame([(y,) for y in known], "y int")
    for r in df.select("y", P.easter_sunday("y").alias("e")).collect():
        assert (r.e.month, r.e.day) == known[r.y]


def test_calendar_case(spark):
    rows = [(dt.datetime(2025, 3, 10, 8, 30),), (dt.datetime(2025, 3, 15, 17, 45),), (dt.datetime(2025, 7, 4, 0, 15),)]
    from lateline.learn.features import CalendarParts
    got = CalendarParts(timeCol="t").transform(spark.createDataFrame(rows, "t timestamp_ntz")).collect()
    assert [(r.hour, r.dow, r.month) for r in got] == [(8, 0, 3), (17, 5, 3), (0, 4, 7)]


def test_weekday_survives_the_circle(spark):
    df = spark.range(7).select(F.col("id").cast("int").alias("d"))
    s, c = P.cyclic("d", 7)
    assert all(r.d == r.back for r in df.select("d", P.weekday_from_cycle(s, c).alias("back")).collect())


def test_soft_classes_and_range(spark):
    df = spark.createDataFrame([(30.0,), (500.0,), (10.4,)], "v double")
    for r in df.select(*[p.alias(f"p{i}") for i, p in enumerate(D.soft_classes("v"))]).collect():
        assert abs(sum(r) - 1) < 1e-9
    low, high = D.likely_range("v")
    assert [tuple(r) for r in df.select(low, high).collect()] == [(0, 94), (436, 564), (0, 74)]


def test_serving_defaults(spark):
    df = spark.createDataFrame([(None, None), (4.0, None), (None, 5.0), (4.0, 6.0)], "s double, g double")
    assert [r[0] for r in df.select(C.serving_wind("s", "g")).collect()] == [3.0, 4.0, 4.0, 5.0]


def test_grid_reference_point(spark):
    # The projection centre lies at 46°57'03.9" N, 7°26'19.1" E (observatory of Bern).
    df = spark.createDataFrame([(2600000.0, 1200000.0)], "e double, n double")
    lat, lon = C.swiss_grid_to_wgs84("e", "n")
    r = df.select(lat.alias("lat"), lon.alias("lon")).first()
    assert abs(r.lat - 46.9511) < 1e-3 and abs(r.lon - 7.4386) < 1e-3
