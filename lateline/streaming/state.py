"""Previous value per key kept in Spark's state store, over micro-batches and restarts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Read when a query starts: the store, and no batches without rows, which a time to live would ask for without end.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
BUCKETS = 1024            # groups of keys that share a call
KEY, BUCKET = "lateline_key", "lateline_bucket"      # frames of a processor lose names that begin with an underscore


class PreviousValue(StatefulProcessor):
    """State of a key: its period, the newest order value in it and the value that came with it.

    A row of the same period and not older than the newest gets the value before it. A row that comes too late (older than
    the newest of its period, or of an earlier period) gets none, because the row after it has been given out already; it
    changes nothing. A row of a later period expires what is remembered. ``ttl`` drops keys that have not moved for so long
    even if no row ever comes for them again.

    A call sees the rows of all keys of one bucket, so what a call costs is shared by them; state is read and written per key.
    """

    def __init__(self, period: str, order: list[str], value: str, name: str, ttl: int, state: T.StructType):
        self.period, self.order, self.value, self.name, self.ttl, self.state = period, order, value, name, ttl, state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", T.StructType([T.StructField(KEY, T.StringType())]), self.state, self.ttl or None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values([KEY, self.period, *self.order], kind="stable", na_position="first", ignore_index=True)
        who, period, at = batch[KEY].to_numpy(), batch[self.period].to_numpy(), batch[self.order[0]].to_numpy()
        value = batch[self.value].astype(object)
        value = value.where(batch[self.value].notna(), None).to_numpy()
        first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
        out = np.empty(len(batch), object)
        for start, end in zip(first, np.append(first[1:], len(batch))):
            mine = (who[start],)
            now = self.last.getValue(mine) if self.last.containsKey(mine) else None
            if now is not None:
                # Rows that come too late are the first ones of their key.
                late = (period[start:end] < now[0]) | ((period[start:end] == now[0]) & (at[start:end] < now[1]))
                start += int(late.sum())
                if start == end:
                    continue
                if period[start] == now[0]:
                    out[start] = now[2]
            follows = np.flatnonzero(period[start + 1:end] == period[start:end - 1]) + start
            out[follows + 1] = value[follows]
            self.last.updateValue(mine, (period[end - 1], at[end - 1], value[end - 1]))
        yield batch.drop(columns=[KEY, BUCKET]).assign(**{self.name: pd.Series(out, index=batch.index, dtype=object)})

    def close(self) -> None:
        pass


def _text(stream: DataFrame, keys: list[str]):
    """The key as one text, with NULLs left out; both zeros are one key, as in a grouping."""
    kinds = dict(stream.dtypes)
    plain = [F.when(F.col(k) == 0, F.lit(0).cast(kinds[k])).otherwise(F.col(k)).alias(k) if kinds[k] in ("float", "double") else F.col(k) for k in keys]
    return F.to_json(F.struct(*plain))


def previous_value_state(
    stream: DataFrame, keys: list[str], period: str, order: list[str], value: str, *, out: str, checkpoint: str,
    name: str = "previous", ttl_hours: float = 72.0, buckets: int = BUCKETS,
) -> StreamingQuery:
    """Append every row of ``stream`` with the previous value of its key in its period, exactly once.

    The store holds one row per key, whatever the number of periods: only their keys' newest rows are in memory or on the
    executors' disks, with a changelog in the checkpoint folder, from which a lost executor's part is rebuilt. ``period`` and the
    first of ``order`` are numbers (days, microseconds) without NULLs. A key's rows of one micro-batch meet in one task, so
    the trigger's file limit bounds what a hot key can bring at once; ``jobs.previous_value_job`` cuts hot keys instead.
    Keys are handled together by ``buckets`` of their hash, which must stay the same over restarts.
    """
    kinds = {f.name: f.dataType for f in stream.schema.fields}
    state = T.StructType([T.StructField("period", kinds[period]), T.StructField("at", kinds[order[0]]), T.StructField("value", kinds[value])])
    shape = T.StructType([*stream.schema.fields, T.StructField(name, kinds[value])])
    processor = PreviousValue(period, order, value, name, round(ttl_hours * 3_600_000), state)
    keyed = stream.withColumn(KEY, _text(stream, keys)).withColumn(BUCKET, F.pmod(F.xxhash64(KEY), F.lit(buckets)).cast("int"))
    lagged = keyed.groupBy(BUCKET).transformWithStateInPandas(processor, shape, "Append", "ProcessingTime" if ttl_hours else "None")
    spark = stream.sparkSession
    before = {k: spark.conf.get(k) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        return (lagged.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
                .outputMode("append").trigger(availableNow=True).start())
    finally:
        for k, v in before.items():         # other queries keep theirs
            spark.conf.set(k, v)
