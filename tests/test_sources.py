import datetime as dt
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from lateline.schema import FEATURES, RAW_HEADERS
from lateline.sources import actuals, tables, weather

GERMAN = list(RAW_HEADERS)


def lines(rows, headers=GERMAN):
    return "\n".join([";".join(headers), *[";".join(r.get(h, "") for h in headers) for r in rows]]) + "\n"


def row(**kw):
    return {"PRODUKT_ID": "Bus", "FAHRT_BEZEICHNER": "t1", "BPUIC": "8500", "FAELLT_AUS_TF": "false", **kw}


def test_semicolon_scan(spark, folder):
    with open(f"{folder}/a.csv", "w") as f:
        f.write(lines([row(HALTESTELLEN_NAME="Bern, Bahnhof"), row(BPUIC="NA")]) + "short;row\n")
    df = actuals.read_actuals(spark, folder)
    assert set(df.columns) == set(RAW_HEADERS.values())
    got = df.orderBy(F.col("BPUIC").desc_nulls_last(), "DATE").collect()
    assert got[0].STOP_NAME == "Bern, Bahnhof" and got[0].CANCELLED == "false" and got[0].DATE is None
    assert [r.BPUIC for r in got] == ["8500", None, None] and got[2].DATE == "short"


def test_archives(spark, folder):
    with zipfile.ZipFile(f"{folder}/m1.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("d1.csv", lines([row(FAHRT_BEZEICHNER="a"), row(FAHRT_BEZEICHNER="b", LINIEN_TEXT='x "quoted"')]))
        z.writestr("readme.txt", "no")
        z.writestr("d2.csv", lines([row(FAHRT_BEZEICHNER="c", LINIEN_TEXT="9")], list(reversed(GERMAN))))
    with open(f"{folder}/broken.zip", "wb") as f:
        f.write(b"not a zip")
    rows, errors = actuals.read_archives(spark, folder)
    got = {r.TRIP_ID: r for r in rows.collect()}
    assert set(got) == {"a", "b", "c"} and got["c"].LINE_NAME == "9" and got["c"].PRODUCT_ID == "Bus"
    bad = errors.collect()
    assert len(bad) == 1 and bad[0].archive.endswith("broken.zip")


def test_guarded_write_and_merge(spark, folder):
    df = spark.range(1000).withColumn("service_date", F.lit(dt.date(2025, 1, 1)))
    assert tables.write_table(df, f"{folder}/t", partition_by=["service_date"]) == 1000
    assert tables.write_table(df, f"{folder}/z", codec="zstd", rows_per_file=300) == 1000
    files = [f for f in os.listdir(f"{folder}/z") if f.endswith(".parquet")]
    assert files and all(".zstd." in f for f in files)
    with pytest.raises(Exception):
        tables.write_table(df, f"{folder}/t")
    part = tables.read_table(spark, f"{folder}/t").filter("service_date = date'2025-01-01'")
    assert "PartitionFilters: [isnotnull(service_date" in part._jdf.queryExecution().toString()
    both = tables.merge_tables([df, spark.createDataFrame([(1, "x")], "id long, extra string")])
    assert both.columns == ["id", "service_date", "extra"] and both.count() == 1001


def test_declared_scan_fills_absent_columns(spark, folder):
    spark.range(3).selectExpr("cast(id as int) as stop_id").write.parquet(f"{folder}/p")
    df = tables.read_table(spark, f"{folder}/p", FEATURES)
    assert df.columns == FEATURES.names and df.filter("stop_id is not null and line is null").count() == 3


def test_results_log(spark, folder):
    for name, v in (("a", 0.123456), ("b", 2.0)):
        tables.log_results(spark.createDataFrame([(name, v)], "name string, rmse double"), f"{folder}/log")
    got = {r.name: r.rmse for r in tables.read_results(spark, f"{folder}/log").collect()}
    assert got == {"a": 0.1235, "b": 2.0}


def test_prediction_sinks_and_keyed_json(spark, folder):
    df = spark.createDataFrame([("A", "1", 2.0, None)], "operator string, line string, x double, y double")
    tables.write_predictions(df, f"{folder}/p.csv")
    tables.write_predictions(df, f"{folder}/p.parquet")
    assert spark.read.option("header", True).csv(f"{folder}/p.csv").first().x == "2.0"
    with pytest.raises(ValueError):
        tables.write_predictions(df, f"{folder}/p.xls")
    tables.write_keyed_json(df, ["operator", "line"], ["x", "y"], f"{folder}/k")
    r = spark.read.json(f"{folder}/k").first()
    assert r.key == "A|1" and json.loads(r.body) == {"x": 2.0, "y": 0.0}


def test_station_features(spark):
    body = json.dumps({"features": [
        {"id": "s1", "geometry": {"coordinates": [7.0, 46.0, 500.0]}, "properties": {"title": "One"},
         "assets": {"x": {"href": "http://a/x.CSV"}, "data": {"href": "http://a/d"}}},
        {"id": "s2", "geometry": {"coordinates": [8.0, 47.0]}, "properties": {}, "assets": {"y": {"href": "u.csv"}}},
        {"id": "s3", "geometry": {"coordinates": [8.0]}, "properties": {}, "assets": {"y": {"href": "u.txt"}}}, {"id": "s4"}]})
    df = spark.createDataFrame([(body,)], "b string")
    got = {r.station_id: (r.name, r.lon, r.lat, r.alt, r.asset_url) for r in weather.stations_from_json(df, "b").collect()}
    assert got == {"s1": ("One", 7.0, 46.0, 500.0, "http://a/d"), "s2": ("s2", 8.0, 47.0, None, "u.csv")}
    need = {r.station_id for r in weather.stations_from_json(df, "b", need_asset=True).collect()}
    assert need == {"s1", "s2"}


def test_hourly_payload_with_missing_variable(spark):
    body = json.dumps({"hourly": {"time": ["2025-01-01T00:00", "2025-01-01T01:00"], "temperature_2m": [1.5, None],
                                  "sunshine_duration": [1800, 3600], "wind_speed_10m": [36.0, 7.2]}})
    got = weather.hourly_rows(spark.createDataFrame([("s", body)], "id string, b string"), "b", "id").orderBy("timestamp").collect()
    assert [(r.timestamp.hour, r.temperature, r.sunshine, round(r.wind_speed, 4), r.pressure) for r in got] == [(0, 1.5, 0.5, 10.0, None), (1, None, 1.0, 2.0, None)]


def test_station_csv(spark, folder):
    with open(f"{folder}/KLO.csv", "w") as f:
        f.write(" STN ;Time;tre200d0;rre150d0;zzz\nKLO;202501010000;3.5;-;1\nKLO;2025-01-01T02:00;–;0.1;1\nKLO;01.01.2025 03:00;NA;na;1\nKLO;202401010000;9;9;9\nKLO;junk;1;1;1\n")
    got = weather.read_station_csv(spark, folder, 2025).orderBy("timestamp").collect()
    assert [(r.station_id, r.timestamp.hour, r.temperature) for r in got] == [("KLO", 0, 3.5), ("KLO", 2, None), ("KLO", 3, None)]
    assert got[0].precipitation is None and round(got[1].precipitation, 3) == 0.1 and got[0].pressure is None


def test_station_csv_finds_unnamed_time_column(spark, folder):
    with open(f"{folder}/ABC.csv", "w") as f:
        f.write("x;when;tre200d0\nABC;2025010105;1\n")
    r = weather.read_station_csv(spark, folder).first()
    assert r.station_id == "ABC" and r.timestamp == dt.datetime(2025, 1, 1, 5)


def test_archive_data_source(spark, folder):
    from lateline.sources import archives

    with zipfile.ZipFile(f"{folder}/m1.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("d1.csv", "a;BPUIC\n1;8\n2;NA\n\n")
        z.writestr("d2.csv", "BPUIC;a\r\n9;3\r\nshort\r\n")
        z.writestr("d3.csv", "other\nx\n")
        z.writestr("empty.csv", "")
        z.writestr("readme.txt", "no")
    with zipfile.ZipFile(f"{folder}/m2.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("d1.csv", "a;BPUIC\nbroken payload;7\n")
        z.writestr("d9.csv", "a;BPUIC\n4;7\n")
    data = open(f"{folder}/m2.zip", "rb").read()
    with open(f"{folder}/m2.zip", "wb") as f:
        f.write(data.replace(b"broken payload", b"broken PAYLOAD", 1))
    with open(f"{folder}/m3.zip", "wb") as f:
        f.write(b"not a zip")
    rows, errors = archives.scan_archives(spark, folder, ["a;BPUIC", "BPUIC;a"])
    assert sorted((r.a, r.BPUIC) for r in rows.filter("a is not null").collect()) == [("1", "8"), ("2", None), ("3", "9"), ("4", "7")]
    assert rows.filter("a is null").count() == 1
    bad = sorted((r.archive.rsplit("/", 1)[1], r.member, r.error) for r in errors.collect())
    assert [b[:2] for b in bad] == [("m1.zip", "d3.csv"), ("m2.zip", "d1.csv"), ("m3.zip", None)] and "CRC" in bad[1][2] and bad[0][2] == "unknown header: other"
    lines = archives.archive_lines(spark, folder)
    assert lines.rdd.getNumPartitions() == 7          # six members and the broken archive
    one = lines.filter("member = 'd9.csv'")
    assert one.rdd.getNumPartitions() == 1 and [r.line for r in one.collect()] == ["4;7"]
    picked, _ = archives.scan_archives(spark, folder, ["a;BPUIC", "BPUIC;a"], members=["d2.csv", "d9.csv"])
    assert sorted(r.a or "" for r in picked.collect()) == ["", "3", "4"]
