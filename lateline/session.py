"""Session settings the jobs expect; every one can be overridden by the cluster."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Only settings that change plans. Executor sizing belongs to the cluster.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app: str = "lateline", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint(df, fallback_dir: str | None = None):
    """Cut lineage through the reliable checkpoint folder the cluster names.

    A folder is only set here when the session names none. Without one only a local master may use a folder of its own,
    because a machine-local folder does not survive the loss of an executor; a cluster must name one.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or fallback_dir
        if named is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir names no shared folder")
            named = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(named)
    return df.checkpoint(eager=True)
