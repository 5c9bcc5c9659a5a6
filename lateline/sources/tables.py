"""Parquet, CSV and JSON tables: declared reads, guarded writes, result logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.aggregates import keyed_json


def read_table(spark: SparkSession, path, schema: StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_table(
    df: DataFrame, path: str, *, partition_by: Sequence[str] = (), codec: str = "snappy",
    mode: str = "errorifexists", rows_per_file: int = 0,
) -> int:
    """Write parquet and return the row count, counted while writing.

    The commit protocol makes the write all-or-nothing. The count read back from the footers must
    equal the count observed on the way out, or the write is reported as failed.
    """
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).option("compression", codec)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    n = seen.get["n"]
    stored = df.sparkSession.read.parquet(path).count() if n else 0
    if mode != "append" and stored != n:
        raise RuntimeError(f"{path}: wrote {n} rows, found {stored}")
    return n


def merge_tables(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all parts by column name, in the column order of the first."""
    first, *rest = parts
    for p in rest:
        first = first.unionByName(p, allowMissingColumns=True)
    return first


def with_column_once(df: DataFrame, name: str, add) -> DataFrame:
    """Add a column by ``add(df)`` unless the table already has it."""
    return df if name in df.columns else add(df)


def write_predictions(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV or parquet by the ending of the path."""
    if path.endswith(".csv"):
        df.write.mode(mode).option("header", True).csv(path)
    elif path.endswith(".parquet"):
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError("path must end in .csv or .parquet")


def log_results(results: DataFrame, path: str, digits: int = 4) -> None:
    """Append metric rows as JSON lines, floating values rounded."""
    rounded = {n: F.round(n, digits) for n, t in results.dtypes if t in ("float", "double")}
    stamped = results.withColumns({**rounded, "timestamp": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")})
    stamped.write.mode("append").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def write_keyed_json(df: DataFrame, keys: Sequence[str], values: Sequence[str], path: str, mode: str = "overwrite") -> None:
    keyed_json(df, keys, values).write.mode(mode).json(path)


def stream_chunks(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """Bounded-memory scan: a stream that takes a few files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
