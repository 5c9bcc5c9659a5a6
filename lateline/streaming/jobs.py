"""Incremental ingest, scoring and previous-stop delay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.rows import rename_known
from ..operators.windows import with_previous
from ..schema import RAW_HEADERS, raw_schema
from ..sources.actuals import null_cells


def new_actuals(spark: SparkSession, path: str, headers: list[str] | None = None, files: int = 100) -> DataFrame:
    """Stream of daily files that have not been read before, all with the stated header.

    A stream cannot look at files that are yet to come: one whose header differs fails the batch instead of putting its
    cells into other columns. Read it with a stream of its own.
    """
    raw = (
        spark.readStream.schema(raw_schema(headers)).options(sep=";", header=True, mode="PERMISSIVE", enforceSchema=False)
        .option("maxFilesPerTrigger", files).csv(path)
    )
    return null_cells(rename_known(raw, RAW_HEADERS))


def ingest_new(
    stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
    partition_by: str | None = None,
) -> StreamingQuery:
    """Convert everything new and stop; the checkpoint remembers which files are done."""
    def write(batch: DataFrame, batch_id: int) -> None:
        # Folder per batch, so a batch that is replayed after a failure overwrites itself.
        w = transform(batch).write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(partition_by)
        w.parquet(f"{out}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def score_new(stream: DataFrame, model, out: str, checkpoint: str, columns=None) -> StreamingQuery:
    """Score rows as they arrive with a fitted model and append the predictions."""
    scored = model.transform(stream)
    if columns:
        scored = scored.select(*columns)
    return (
        scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def previous_value_job(
    stream: DataFrame, keys: list[str], order: list[str], value: str, *, out: str, state: str,
    checkpoint: str, name: str = "previous", chunk: Column | None = None, expire: Column | None = None,
) -> StreamingQuery:
    """Previous value per key over an endless input, in micro-batches.

    The state is one row per key (newest order value and its value), kept as a table per batch.
    Each batch puts those rows in front of its own and runs the ordinary window operator, so hot
    keys are chunked here as well. A row older than the newest one already seen for its key gets no
    previous value, because the row that follows it has been written already. ``expire`` is a
    condition on the keys that drops finished ones (for example days that have passed).

    The output of a batch goes to a folder named after it and its state to one of two slots in turn: a
    replayed batch overwrites itself and reads the state of the batch before, so every row is written
    exactly once and no older state is left behind.
    """
    first = order[0]

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist(StorageLevel.DISK_ONLY)  # read for the output and again for the state
        try:
            advance(spark, batch, batch_id)
        finally:
            batch.unpersist()

    def advance(spark: SparkSession, batch: DataFrame, batch_id: int) -> None:
        shape = T.StructType([f for f in batch.schema.fields if f.name in {*keys, first, value}])
        if batch_id == 0:
            seen = spark.createDataFrame([], shape)
        else:
            seen = spark.read.schema(shape).parquet(f"{state}/slot={(batch_id - 1) % 2}")
        newest = seen.select(*[F.col(k).alias(f"__k{k}") for k in keys], F.col(first).alias("__newest"))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__k{k}"))
        marked = batch.join(newest, same, "left").drop(*[f"__k{k}" for k in keys])
        is_late = F.coalesce(F.col(first) < F.col("__newest"), F.lit(False))
        fresh = marked.filter(~is_late).drop("__newest").withColumn("__old", F.lit(False))
        late = marked.filter(is_late).drop("__newest")
        both = fresh.unionByName(seen.withColumn("__old", F.lit(True)), allowMissingColumns=True)
        # The remembered row comes first among rows of the same time.
        ranked = both.withColumn("__rank", F.when(F.col("__old"), 0).otherwise(1))
        lagged = with_previous(ranked, keys, [first, "__rank", *order[1:]], lags={name: value}, chunk=chunk)
        kept = lagged.filter(~F.col("__old")).drop("__old", "__rank")
        whole = kept.unionByName(late.withColumn(name, F.lit(None).cast(dict(kept.dtypes)[name])))
        whole.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        last = both.groupBy(*keys).agg(
            F.max_by(F.struct(first, value), F.struct(first, ~F.col("__old"), *order[1:])).alias("r"))
        last = last.select(*keys, "r.*")
        if expire is not None:
            last = last.filter(~expire)
        last.select(*shape.names).write.mode("overwrite").parquet(f"{state}/slot={batch_id % 2}")

    return (
        stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
