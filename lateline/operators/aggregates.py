"""Grouped summaries, shares, pivots and distinct sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import col
from ..functions.delays import delay_class


def counts(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """All rows and the rows meeting each condition, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in conditions.items()])


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, nulls, null_rate) for many columns from one aggregate row."""
    one = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns])
    return one.select("__n", F.inline(pairs)).select(
        "column", "nulls", (F.col("nulls") / F.col("__n")).alias("null_rate"))


def true_share(flag) -> Column:
    return F.avg(col(flag).cast("double"))


def share_of_total(df: DataFrame, by: Mapping[str, Column]) -> DataFrame:
    """Rows per group and their share of all rows; the groups are few (months, hours, classes)."""
    grouped = df.groupBy(*[c.alias(n) for n, c in by.items()]).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("t")).scalar()
    return grouped.withColumn("share", F.col("n") / total)


def class_distribution(df: DataFrame, value: str, bins: Sequence[float]) -> DataFrame:
    known = df.filter(F.col(value).isNotNull())
    return share_of_total(known, {"cls": delay_class(value, bins)})


def group_summary(df: DataFrame, by: Sequence, value: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))


def group_and_global_mean(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean per key plus the global mean on every row."""
    overall = df.agg(F.avg(value).alias("m")).scalar()
    return df.groupBy(*keys).agg(F.avg(value).alias("group_mean"), F.count(value).alias("n")).withColumn(
        "global_mean", overall)


def row_with_max(df: DataFrame, value: str, tie: Sequence[str]) -> DataFrame:
    """The row with the largest value; the lowest tie key wins among equals."""
    low_tie = [F.struct(*[F.col(c) for c in df.columns])]
    best = df.filter(F.col(value).isNotNull()).agg(F.max(value).alias("m")).scalar()
    top = df.filter(F.col(value) == best)
    picked = top.agg(F.min_by(low_tie[0], F.struct(*tie)).alias("r"))
    return picked.select("r.*")


def standard_score(df: DataFrame, value: str, out: str) -> DataFrame:
    """(x - mean) / sample std of the whole table, through one scalar aggregate."""
    stats = df.agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    return df.withColumn(out, (F.col(value) - stats.select("m").scalar()) / stats.select("s").scalar())


def binned_label(value, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the right-closed bin (edges[i], edges[i + 1]]; NULL outside the edges."""
    value = col(value)
    out = F.lit(None).cast("string")
    for low, high, name in zip(edges, edges[1:], labels):
        out = F.when((value > low) & (value <= high), F.lit(name)).otherwise(out)
    return out


def pivot_mean(df: DataFrame, row: str, column: str, labels: Sequence[str], value: str) -> DataFrame:
    """Mean per (row, label); gaps take the label to the left, then the label to the right."""
    table = df.filter(F.col(column).isNotNull()).groupBy(row).pivot(column, list(labels)).agg(F.avg(value))
    filled = {}
    for i, name in enumerate(labels):
        left = [F.col(f"`{n}`") for n in reversed(labels[: i + 1])]
        right = [F.col(f"`{n}`") for n in labels[i + 1:]]
        filled[name] = F.coalesce(*left, *right)
    return table.select(row, *[c.alias(n) for n, c in filled.items()])


def top_rows(df: DataFrame, by: str, n: int, tie: Sequence[str]) -> DataFrame:
    """The n rows with the largest non-null value (a top-k report)."""
    return df.filter(F.col(by).isNotNull()).orderBy(F.col(by).desc(), *tie).limit(n)


def keyed_json(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(key, body): keys joined by "|", NULL values written as 0.0."""
    return df.select(
        F.concat_ws("|", *keys).alias("key"),
        F.to_json(F.struct(*[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values])).alias("body"),
    )


def ordered_distinct(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct().orderBy(*columns)


def before_after(df: DataFrame, kept: Column, by: Sequence[str] = ()) -> DataFrame:
    """Row accounting of a filter: before, after, dropped and the dropped share in percent."""
    n = F.count(F.lit(1))
    k = F.count_if(kept)
    return df.groupBy(*by).agg(
        n.alias("before"), k.alias("after"), (n - k).alias("dropped"), ((n - k) * 100.0 / n).alias("dropped_pct"))
