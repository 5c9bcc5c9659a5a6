"""Catalogue of registered queries, each with the plain SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Trip observations as the tables can supply them: a line item is a stop of the trip "order",
# its ship date plus a minute of day the scheduled time. Delays lie on both sides of the accepted
# band and are NULL for some classes of rows.
OBS_SQL = """
SELECT l_orderkey AS trip_id, l_suppkey AS stop_id, l_partkey AS part_id, l_linenumber AS line_no,
  l_shipdate + to_minutes((l_partkey * 7) % 1440) AS ts,
  CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN NULL ELSE CAST(l_quantity * 45 - 180 AS INTEGER) END AS arr,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN NULL
       WHEN l_returnflag = 'N' AND l_linestatus = 'O' AND l_quantity > 40 THEN NULL
       ELSE CAST(l_quantity * 45 - 150 AS INTEGER) END AS dep,
  l_discount > 0.085 AS additional_trip, CAST(l_tax * 100 AS INTEGER) % 4 AS pass_code,
  CASE WHEN l_discount < 0.015 THEN 'True' WHEN l_discount < 0.025 THEN NULL ELSE 'false' END AS cancelled,
  l_returnflag AS operator, l_linestatus AS line, l_extendedprice AS price, l_quantity AS quantity
FROM lineitem
"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as trip_id", "l_suppkey as stop_id", "l_partkey as part_id", "l_linenumber as line_no",
        "l_shipdate + make_dt_interval(0, 0, cast((l_partkey * 7) % 1440 as int)) as ts",
        "case when l_returnflag = 'N' and l_linestatus = 'O' then null else cast(l_quantity * 45 - 180 as int) end as arr",
        """case when l_returnflag = 'R' and l_linestatus = 'F' then null
                when l_returnflag = 'N' and l_linestatus = 'O' and l_quantity > 40 then null
                else cast(l_quantity * 45 - 150 as int) end as dep""",
        "l_discount > 0.085 as additional_trip", "cast(round(l_tax * 100) as int) % 4 as pass_code",
        "case when l_discount < 0.015 then 'True' when l_discount < 0.025 then null else 'false' end as cancelled",
        "l_returnflag as operator", "l_linestatus as line", "l_extendedprice as price", "l_quantity as quantity",
    )
