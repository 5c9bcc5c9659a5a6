"""What several operators share: written intermediate tables, word hashes, connected components.

Intermediate tables go to the folder the cluster names in ``spark.checkpoint.dir``; the driver and all
executors see it, so a lost executor only repeats its own tasks.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
# The white space of the word rule [^\x20\x09-\x0D]+.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
TEXTS = 2000              # whole texts that go to a Python worker at a time
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local one is set only where none is named (tests, notebooks)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        named = tempfile.mkdtemp(prefix="spark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def importable(spark: SparkSession) -> None:
    """Let workers import this package from where the driver did, besides what the cluster installs."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


@contextlib.contextmanager
def _setting(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of one write, put back after it."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write the rows once to the shared folder and read them back: lineage ends here.

    Spark removes the shuffle files of the write at its end, as nothing reads them any more; else they stay until the
    driver happens to collect its garbage, and those of many writes add up.

    ``rows``: most rows that go to a Python worker at a time. Whole texts go in small batches, because both the executor
    and its worker hold a batch several times over.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    values = {_FREED: "true"}
    if rows is not None and not 0 < int(spark.conf.get(_BATCH)) <= rows:
        values[_BATCH] = str(rows)
    with _setting(spark, values):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_KEPT: dict = {}


def kept(key, make: Callable):
    """What a worker process keeps for its next tasks, made where there is none; it keeps one such table at a time."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def let_go() -> None:
    """Free what this worker process keeps: the task at hand is of another kind."""
    _KEPT.clear()


# ---------------------------------------------------------------- word hashes

def _mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, longer on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                x = np.full(size, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_CHARS, _WORDS = _Powers(0xD6E8FEB86659FD93), _Powers(0xA0761D6478BD642F)
_BLOCK = 1 << 20


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of ``data``, with first and past-the-end byte of each.

    A word's hash is a polynomial over random byte values, so it is read off one running sum. Long data is
    taken in blocks that end at white space, which keeps the tables of powers small.
    """
    a = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(a) + 2, np.int8)
    inside[1:-1] = ~WHITE[a]
    edge = np.diff(inside)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out = np.empty(len(first), np.uint64)
    w = 0
    while w < len(first):
        at = int(first[w])
        to = max(w + 1, int(np.searchsorted(last, at + _BLOCK, "right")))
        n = int(last[to - 1]) - at
        up, down = _CHARS.get(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[a[at:at + n]] * up[:n], out=total[1:])
        f, e = first[w:to] - at, last[w:to] - at
        out[w:to] = (total[e] - total[f]) * down[f]
        w = to
    return _mixed(out), first, last


def text_hashes(texts, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of many texts in a row, and the offset of each text's first word (one more at the end)."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([0] + [len(p) + 1 for p in parts])
    data = b"\n".join(parts)
    h, first, _ = word_hashes(data.translate(LOWER) if lower else data)
    return h, np.searchsorted(first, ends)


def slices(lengths, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts that hold about ``size`` characters (a longer text is a run of its own), so that working
    memory follows the size and not the batch."""
    at = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > size:
            yield at, i
            at, total = i, 0
        total += n + 1
    if at < len(lengths):
        yield at, len(lengths)


def run_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` hashes that starts at a position; the caller drops runs over a text's end."""
    n = len(h)
    if n < length:
        return np.empty(0, np.uint64)
    out = np.zeros(n - length + 1, np.uint64)
    k = int(_WORDS.base)
    if length <= 4:
        for i in range(length):
            out = out * np.uint64(k) + h[i:n - length + 1 + i]
        return _mixed(out)
    for at in range(0, len(out), _BLOCK):  # blocks bound the tables of powers
        to = min(len(out), at + _BLOCK)
        m = to - at + length
        up, down = _WORDS.get(m)
        total = np.zeros(m, np.uint64)
        np.cumsum(h[at:to + length - 1] * up[:m - 1], out=total[1:])
        out[at:to] = (total[length:length + to - at] - total[:to - at]) * down[:to - at]
    return _mixed(out)


# ---------------------------------------------------------------- components

def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest id reachable from every linked id: rows (id, component). NULL ids link nothing.

    Alternating star contraction: each round ties the larger neighbours of an id, then its smaller ones, to the
    smallest. Every round is a grouped minimum (combined before the shuffle, so a hub costs no more than its
    tasks) and an equality join; the rounds end when every id hangs on one root.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (both.where("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(near.unionAll(low.toDF("u", "v")).distinct(), "edges")
        ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
            edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        open_ = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up * down > 0")
        if open_.isEmpty():
            break
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(
        roots.select("id", F.col("id").alias("component")))
