"""Queries against rows of one key, in blocks of bounded size.

A key (a bucket, a tree node) may hold a third of all rows. Its rows are cut into blocks by a hash, its queries as well, and
each block of queries meets each block of rows in a group of its own: what one task holds is bounded, whatever the key.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES, ROWS = 512, 4096


def usable(vector: Column) -> Column:
    """Whether a vector has elements, and none that is null, NaN or infinite."""
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def sized(queries: DataFrame, rows: DataFrame, key: str, q_size: int, r_size: int) -> DataFrame:
    """Blocks of queries (qs) and of rows (rs) of each key that has both."""
    return (queries.groupBy(key).agg(F.ceil(F.count("*") / q_size).alias("qs"))
            .join(rows.groupBy(key).agg(F.ceil(F.count("*") / r_size).alias("rs")), key))


def paired(queries: DataFrame, rows: DataFrame, key: str, query: str, row: str, sizes: DataFrame | None = None, *,
           q_size: int = QUERIES, r_size: int = ROWS):
    """Cogrouped blocks (queries, rows) of equal ``key``; ``query`` and ``row`` number what is dealt to blocks.

    ``sizes``: the blocks of each key, counted before (``sized``); a small written table saves a shuffle of both sides."""
    if sizes is None:
        sizes = sized(queries, rows, key, q_size, r_size)
    left = (queries.join(sizes, key).withColumn("qb", F.pmod(F.xxhash64(query), "qs"))
            .withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("rs") - 1))).drop("qs", "rs"))
    right = (rows.join(sizes, key).withColumn("rb", F.pmod(F.xxhash64(row), "rs"))
             .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qs") - 1))).drop("qs", "rs"))
    return left.groupBy(key, "rb", "qb").cogroup(right.groupBy(key, "rb", "qb"))


def matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v) for v in vectors])


def first(group: np.ndarray, n: int) -> np.ndarray:
    """Marks the first ``n`` places of each run of equal values."""
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.empty(0, np.int64)
    length = np.diff(np.append(start, len(group)))
    return np.arange(len(group)) - np.repeat(start, length) < n
