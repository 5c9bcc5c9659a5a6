"""Regression and classification metrics, class weights and leaderboards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


MOST_CLASSES = 1000


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(n, mse, rmse, r2) in one pass.

    Unknown pairs are left out inside the aggregates: a filter on the prediction would be pushed
    below the projection and evaluate the model twice per row.
    """
    pairs = df.select(F.col(label).cast("double").alias("y"), F.col(prediction).cast("double").alias("p"))
    known = pairs.select((F.col("y") - F.col("p")).alias("e"), "y")
    y = F.when(F.col("e").isNotNull(), F.col("y"))
    agg = known.agg(
        F.count("e").alias("n"), F.sum(F.col("e") * F.col("e")).alias("sse"),
        (F.var_pop(y) * F.count("e")).alias("sst"),
    )
    mse = F.col("sse") / F.col("n")
    return agg.select(
        "n", mse.alias("mse"), F.sqrt(mse).alias("rmse"),
        F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).alias("r2"),
    )


def confusion(df: DataFrame, labels: Sequence[int], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Actual × predicted counts over all labels, zeros kept; columns ``pred_<label>``."""
    spine = df.sparkSession.createDataFrame([(int(x),) for x in labels], "actual int")
    table = (
        df.select(F.col(label).cast("int").alias("actual"), F.col(prediction).cast("int").alias("p"))
        .groupBy("actual").agg(*[F.count_if(F.col("p") == x).alias(f"pred_{x}") for x in labels])
    )
    return spine.join(table, "actual", "left").na.fill(0).select("actual", *[f"pred_{x}" for x in labels])


def _per_class(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(cls, tp, support, predicted) for every class seen on either side."""
    both = F.col("y").isNotNull() & F.col("p").isNotNull()
    # Filtering on the count keeps the condition above the aggregate and off the model's output.
    pairs = (
        df.select(F.col(label).cast("int").alias("y"), F.col(prediction).cast("int").alias("p"))
        .groupBy("y", "p").agg(F.count_if(both).alias("n")).filter(F.col("n") > 0)
    )
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("y").alias("cls"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("tp"),
                 F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("p").alias("cls"), F.lit(0).cast("bigint").alias("tp"),
                 F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")),
    )).alias("s")).select("s.*")
    return sides.groupBy("cls").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(cls, precision, recall, f1, support) per class; empty denominators give 0."""
    t = _per_class(df, label, prediction)
    return t.select(
        "cls", _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"), "support",
    )


def class_summary(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy, macro and support-weighted precision, recall and F1."""
    r = class_report(df, label, prediction)
    hit = F.sum(F.col("recall") * F.col("support")) / F.sum("support")
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    return r.agg(
        F.sum("support").alias("n"), hit.alias("accuracy"),
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        *[weighted(c).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")],
    )


def class_weights(df: DataFrame, label: str, mode: str | None = "balanced") -> DataFrame:
    """(label, n, weight): n_total / (classes * n_class), its square root, or 1."""
    per = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = per.agg((F.sum("n") / F.count(F.lit(1))).alias("t")).scalar()
    w = total / F.col("n")
    weight = {"balanced": w, "sqrt_balanced": F.sqrt(w), None: F.lit(1.0)}[mode]
    return per.withColumn("weight", weight)


def class_values(df: DataFrame, label: str) -> list:
    """The label's values in order; more than ``MOST_CLASSES`` of them are an error, not a list."""
    rows = df.select(label).distinct().limit(MOST_CLASSES + 1).collect()
    if len(rows) > MOST_CLASSES:
        raise ValueError(f"{label} has more than {MOST_CLASSES} values: no class")
    return sorted(r[0] for r in rows)


def with_class_weight(df: DataFrame, label: str, mode: str | None = "balanced", out: str = "weight") -> DataFrame:
    """Weight on every row. A literal map, because the class list is as short as the bin list."""
    if mode is None:
        return df.withColumn(out, F.lit(1.0))
    rows = class_weights(df, label, mode).limit(MOST_CLASSES + 1).collect()
    if len(rows) > MOST_CLASSES:
        raise ValueError(f"{label} has more than {MOST_CLASSES} values: no class")
    table = {r[label]: r["weight"] for r in rows}
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return df.withColumn(out, F.element_at(F.create_map(*pairs), F.col(label)))


def leaderboard(results: DataFrame, metric: str, descending: bool = True, name: str = "name") -> DataFrame:
    """Best run per name, best first."""
    pick = F.max_by if descending else F.min_by
    best = results.filter(F.col(metric).isNotNull()).groupBy(name).agg(
        pick(F.struct(*[c for c in results.columns if c != name]), F.col(metric)).alias("r")
    ).select(name, "r.*")
    return best.orderBy(F.col(metric).desc() if descending else F.col(metric).asc(), name)
