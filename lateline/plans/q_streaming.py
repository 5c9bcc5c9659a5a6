"""Registered queries that run the incremental jobs over a table's file and read the result back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import timeparts as P
from ..learn.experiment import vectors
from ..learn.models import Ridge
from ..streaming import jobs
from ..streaming.state import previous_value_state
from .registry import query, table


def scratch(spark) -> str:
    """A new folder below the shared checkpoint folder of the session."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        raise ValueError("spark.checkpoint.dir names no shared folder")
    return f"{root}/{uuid.uuid4().hex}"


def _stream(spark, d, name):
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


@query("r01_incremental_ingest", "SELECT event_id, CAST(ts AS DATE) AS day, value FROM events WHERE event_type <> 'error'")
def _(spark, d):
    at = scratch(spark)
    clean = lambda b: b.filter("event_type <> 'error'").select("event_id", P.service_date("ts").alias("day"), "value")
    jobs.ingest_new(_stream(spark, d, "events"), clean, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/out").drop("batch")


@query("r02_incremental_scoring", """
WITH s AS (SELECT regr_sxy(value, CAST(user_id AS DOUBLE)) / (regr_sxx(value, CAST(user_id AS DOUBLE)) + 1.0) AS w, avg(user_id) AS mx, avg(value) AS my FROM events)
SELECT event_id, round(my + w * (user_id - mx), 6) AS prediction FROM events, s""")
def _(spark, d):
    at = scratch(spark)
    rows = lambda t: vectors(["user_id"]).transform(t)
    model = Ridge(alpha=1.0, labelCol="value").fit(rows(table(spark, d, "events")))
    jobs.score_new(rows(_stream(spark, d, "events")), model, f"{at}/out", f"{at}/checkpoint", ["event_id", "prediction"]).awaitTermination()
    return spark.read.parquet(f"{at}/out").select("event_id", F.round("prediction", 6).alias("prediction"))


@query("r03_incremental_lag", "SELECT event_id, lag(value) OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY ts) AS previous FROM events")
def _(spark, d):
    at = scratch(spark)
    s = _stream(spark, d, "events").select("event_id", "ts", "user_id", "value", P.service_date("ts").alias("day"))
    jobs.previous_value_job(
        s, ["day", "user_id"], ["ts", "event_id"], "value", out=f"{at}/out", state=f"{at}/state", checkpoint=f"{at}/checkpoint",
        chunk=F.hour("ts") * 60 + F.minute("ts")).awaitTermination()
    return spark.read.parquet(f"{at}/out").select("event_id", "previous")


# Arrivals: three stretches of time that cut days in two, then the rows that were held back (every 97th). Of these, the ones
# older than what their key has seen get no previous value; the others follow on it.
_ARRIVE = "CASE WHEN event_id % 97 = 0 THEN 3 WHEN day(ts) * 24 + hour(ts) < 252 THEN 0 WHEN day(ts) * 24 + hour(ts) < 492 THEN 1 ELSE 2 END"


@query("r03_state_store_lag", f"""
WITH e AS (SELECT event_id, user_id, value, epoch_us(ts) AS due, CAST(ts AS DATE) AS day, {_ARRIVE} AS part FROM events),
seen AS (SELECT *, max(due) OVER (PARTITION BY user_id ORDER BY part RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM e),
f AS (SELECT *, newest IS NULL OR due >= newest AS fresh FROM seen)
SELECT event_id, CASE WHEN fresh THEN lag(value) OVER (PARTITION BY user_id, day, fresh ORDER BY part, due, event_id) END AS previous FROM f""")
def _(spark, d):
    at = scratch(spark)
    rows = table(spark, d, "events").select(
        "event_id", "user_id", "value", F.expr("unix_micros(cast(ts as timestamp))").alias("at"), F.unix_date(P.service_date("ts")).alias("day"), F.expr(_ARRIVE).alias("part"))
    for batch in range(4):
        # Each arrival is a run of its own, so state crosses restarts.
        rows.where(F.col("part") == batch).drop("part").write.mode("append").parquet(f"{at}/in")
        s = spark.readStream.schema(rows.drop("part").schema).parquet(f"{at}/in")
        previous_value_state(s, ["user_id"], "day", ["at", "event_id"], "value", out=f"{at}/out", checkpoint=f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("event_id", "previous")
