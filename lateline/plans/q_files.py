"""Registered queries that write a table as files below the session's shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import actuals, archives, tables, weather
from ..streaming import jobs
from .q_streaming import scratch
from .registry import query, table


def _csv(df, path: str) -> str:
    df.write.options(header=True, sep=";").csv(path)
    return path


def _cells(spark, d):
    """Events as text cells; some kinds are NA and some users are empty."""
    return table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.when(F.col("event_id") % 7 == 0, "NA").otherwise(F.col("event_type")).alias("kind"),
        F.when(F.col("event_id") % 11 == 0, "").otherwise(F.col("user_id").cast("string")).alias("BPUIC"))


_CELLS = """SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS kind,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS bpuic FROM events"""


def _plain(df):
    return df.select("event_id", "kind", F.col("BPUIC").alias("bpuic"))


@query("s01_mixed_headers", _CELLS)
def _(spark, d):
    cells, at = _cells(spark, d), scratch(spark)
    half = F.col("event_id").cast("long") % 2
    a = _csv(cells.filter(half == 0).select("event_id", "kind", "BPUIC"), f"{at}/a")
    b = _csv(cells.filter(half == 1).select("BPUIC", "event_id", "kind"), f"{at}/b")
    return _plain(actuals.read_actuals(spark, [a, b]))


# Events of a kind are an archive with a member per day; a file that is no archive and members with another header are errors.
@query("s02_archives", """
WITH e AS (SELECT event_type || '.zip' AS archive, 'd' || day(ts) || '.csv' AS member, event_id, user_id FROM events)
SELECT archive, member, CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS bpuic, NULL AS error FROM e WHERE member <> 'd7.csv'
UNION ALL SELECT DISTINCT archive, member, NULL, NULL, 'unknown header: other' FROM e WHERE member = 'd7.csv'
UNION ALL SELECT 'broken.zip', NULL, NULL, NULL, 'File is not a zip file'""")
def _(spark, d):
    at = scratch(spark)
    day, user = F.dayofmonth("ts"), F.col("user_id").cast("string")
    missing = F.col("event_id") % 11 == 0
    e = table(spark, d, "events").select(
        F.concat("event_type", F.lit(".zip")).alias("archive"), F.concat(F.lit("d"), day, F.lit(".csv")).alias("member"), F.col("event_id").alias("place"),
        F.when(day % 2 == 0, F.concat_ws(";", "event_id", F.when(missing, "NA").otherwise(user)))
        .otherwise(F.concat_ws(";", F.when(missing, "").otherwise(user), "event_id")).alias("line"))
    even, odd = "event_id;BPUIC", "BPUIC;event_id"
    head = F.when(F.col("member") == "d7.csv", "other").when(F.expr("cast(regexp_extract(member, '[0-9]+', 0) as int) % 2 = 0"), even).otherwise(odd)
    heads = e.select("archive", "member").distinct().select("archive", "member", F.lit(-1).cast("bigint").alias("place"), head.alias("line"))
    archives.write_archives(e.unionByName(heads), f"{at}/in", "archive", "member").write.parquet(f"{at}/names")
    archives.put_bytes(f"{at}/in/broken.zip", b"no archive")
    rows, errors = archives.scan_archives(spark, f"{at}/in", [even, odd])
    name = F.element_at(F.split("archive", "/"), -1)
    return rows.select(name.alias("archive"), "member", "event_id", F.col("BPUIC").alias("bpuic"), F.lit(None).cast("string").alias("error")).unionByName(
        errors.select(name.alias("archive"), "member", F.lit(None).cast("string").alias("event_id"), F.lit(None).cast("string").alias("bpuic"), "error"))


@query("r01_csv_ingest", _CELLS)
def _(spark, d):
    at = scratch(spark)
    _csv(_cells(spark, d).repartition(3), f"{at}/in")
    stream = jobs.new_actuals(spark, f"{at}/in", ["event_id", "kind", "BPUIC"], files=1)
    jobs.ingest_new(stream, _plain, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/out").drop("batch")


@query("s11_station_layouts", """
SELECT CAST(user_id AS VARCHAR) AS station_id, date_trunc('minute', ts) AS timestamp, CAST(CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS FLOAT) AS humidity,
  CAST(user_id AS FLOAT) AS wind_speed FROM events""")
def _(spark, d):
    at = scratch(spark)
    e = table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("stn"), F.date_format("ts", "yyyyMMddHHmm").alias("time"),
        F.when(F.col("event_id") % 5 == 0, "-").otherwise(F.col("value").cast("string")).alias("ure200d0"), F.col("user_id").alias("fu3010d0"))
    half = F.col("event_id") % 2
    a = _csv(e.filter(half == 0).select("stn", "time", "ure200d0", "fu3010d0"), f"{at}/a")
    b = _csv(e.filter(half == 1).select("stn", "fu3010d0", "time", "ure200d0"), f"{at}/b")
    return weather.read_station_csv(spark, [a, b]).select("station_id", "timestamp", "humidity", "wind_speed")


@query("s04_guarded_sink", "SELECT event_id, event_type, value FROM events WHERE value > 20")
def _(spark, d):
    at = scratch(spark)
    tables.write_table(table(spark, d, "events").filter("value > 20").select("event_id", "event_type", "value"), at)
    return tables.read_table(spark, at)


@query("s05_zstd_parts", "SELECT event_id, value, event_type FROM events")
def _(spark, d):
    at = scratch(spark)
    rows = table(spark, d, "events").select("event_id", "value", "event_type")
    tables.write_table(rows, at, codec="zstd", partition_by=["event_type"], rows_per_file=1000)
    return tables.read_table(spark, at)


@query("s12_predictions_file", "SELECT event_id, value AS prediction FROM events")
def _(spark, d):
    at = f"{scratch(spark)}/told.csv"
    tables.write_predictions(table(spark, d, "events").select("event_id", F.col("value").alias("prediction")), at)
    return spark.read.option("header", True).schema("event_id long, prediction double").csv(at)


@query("s13_result_log", "SELECT event_type AS name, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY 1")
def _(spark, d):
    at = scratch(spark)
    tables.log_results(table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"), F.avg("value").alias("mean")), at)
    return tables.read_results(spark, at).select("name", "n", "mean")
