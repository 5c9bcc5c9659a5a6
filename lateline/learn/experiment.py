"""Experiments: prepare, fit, score, measure, compare, search."""

from __future__ import annotations

import random
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import class_report, class_summary, leaderboard, regression_metrics
from ..operators.rows import drop_columns, fill_constant
from ..operators.sampling import hash_fraction, sample_exact, sample_stratified, stratified_train_test, train_test
from ..session import checkpoint
from .features import DelayClass
from .models import fit_all


def load(
    df: DataFrame, target: str, drop: Sequence[str], key: Sequence[str], *, test_size: float = 0.2,
    seed: int = 42, sample: int | None = None, exact: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(train, test): optional sample, dropped columns, known target, zero-filled distance, split."""
    rows = sample_exact(df, sample, seed, key) if sample else df
    rows = drop_columns(rows, [c for c in drop if c not in key]).filter(F.col(target).isNotNull())
    rows = fill_constant(rows, {"dist_to_prev_stop": 0.0})
    return train_test(rows, seed, key, test_size, exact)


def vectors(columns: Sequence[str], out: str = "features") -> VectorAssembler:
    """Assembler for numeric and boolean columns; a row with a NULL feature is kept as invalid NaN."""
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="keep")


def run_regression(name: str, train: DataFrame, test: DataFrame, stages: Sequence, label: str = "label") -> DataFrame:
    """One metric row (name, kind, n, mse, rmse, r2)."""
    model = Pipeline(stages=list(stages)).fit(train)
    scored = model.transform(test)
    return regression_metrics(scored, label).select(
        F.lit(name).alias("name"), F.lit("regression").alias("kind"), "*")


def run_classification(
    name: str, train: DataFrame, test: DataFrame, stages: Sequence, label: str = "label"
) -> DataFrame:
    """One metric row (name, kind, n, accuracy, macro_f1, ...); the label is already a class."""
    scored = Pipeline(stages=list(stages)).fit(train).transform(test)
    return class_summary(scored, label).select(
        F.lit(name).alias("name"), F.lit("classification").alias("kind"), "*")


def encode_then_classify(name, train, test, stages, target: str, bins: Sequence[float]) -> DataFrame:
    enc = DelayClass(inputCol=target, outputCol="label", bins=[float(b) for b in bins])
    return run_classification(name, enc.transform(train), enc.transform(test), stages)


def run_suite(runs: Mapping[str, Callable[[], DataFrame]], metric: str, descending: bool = True) -> DataFrame:
    """Run named experiments and rank them."""
    rows = None
    for job in runs.values():
        one = job()
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    return leaderboard(rows, metric, descending)


def ablation(
    train: DataFrame, test: DataFrame, sets: Mapping[str, Sequence[str]], model: Callable[[], Estimator],
    label: str = "label",
) -> DataFrame:
    """The same model on different column sets: one metric row per set."""
    rows = None
    for name, columns in sets.items():
        one = run_regression(name, train, test, [vectors(columns), model()], label)
        rows = one if rows is None else rows.unionByName(one)
    return rows


def draw(space: Mapping[str, tuple], rng: random.Random) -> dict:
    """One setting: ("int", a, b), ("float", a, b), ("log", a, b) or ("choice", [..]) per name."""
    out = {}
    for name, (kind, *spec) in space.items():
        if kind == "int":
            out[name] = rng.randint(*spec)
        elif kind == "float":
            out[name] = rng.uniform(*spec)
        elif kind == "log":
            import math
            out[name] = math.exp(rng.uniform(math.log(spec[0]), math.log(spec[1])))
        else:
            out[name] = rng.choice(spec[0])
    return out


def search(
    train: DataFrame, test: DataFrame, build: Callable[[dict], Estimator], space: Mapping[str, tuple], *,
    key: Sequence[str], label: str = "label", trials: int = 10, sample: int | None = None, seed: int = 42,
    classify: bool = False,
) -> tuple[dict, DataFrame, object]:
    """(best setting, test metrics, model): trials, and the best one refitted on all rows.

    Trials use all rows unless the caller states a ``sample``, which keeps the label's distribution; every trial has its
    own inner split.
    """
    if sample is None:
        small = train
    elif classify:
        small = sample_exact(train, sample, seed, key)
    else:
        small = sample_stratified(train, sample, label, seed, key)
    small = small.cache()
    try:
        best, best_score = None, None
        rng = random.Random(seed)
        for t in range(trials):
            setting = draw(space, rng)
            if classify:
                inner, held = stratified_train_test(small, label, seed + t, key)
                scored = build(setting).fit(inner).transform(held)
                score = class_summary(scored, label).first()["macro_f1"]
            else:
                inner, held = train_test(small, seed + t, key)
                scored = build(setting).fit(inner).transform(held)
                score = -regression_metrics(scored, label).first()["rmse"]
            if best_score is None or score > best_score:
                best, best_score = setting, score
    finally:
        small.unpersist()
    model = build(best).fit(train)
    scored = model.transform(test)
    metrics = class_summary(scored, label) if classify else regression_metrics(scored, label)
    return best, metrics, model


def race(
    train: DataFrame, test: DataFrame, build: Callable[[dict], Estimator], space: Mapping[str, tuple], *,
    key: Sequence[str], label: str = "label", trials: int = 9, rungs: Sequence[float] = (1 / 9, 1 / 3, 1.0), keep: float = 1 / 3,
    seed: int = 42, classify: bool = False, parallelism: int = 4,
) -> tuple[dict, DataFrame, object, list[tuple[float, int, float]]]:
    """(best setting, test metrics, model, [(share, trial, score)]): all trials side by side on a little of the data, the better ones on more.

    All settings are drawn first and share one inner split. A rung trains every trial left on the rows whose hash lies below its
    share, so a larger rung holds the smaller one, and judges all on the same held rows; ``keep`` of them (at least one, ties
    to the earlier) go on. Trials of a rung run at the same time and do not see each other: ``parallelism`` changes the
    time, never the winner. The winner is fitted on all rows.
    """
    rng = random.Random(seed)
    settings = [draw(space, rng) for _ in range(trials)]
    split = stratified_train_test(train, label, seed, key) if classify else train_test(train, seed, key)
    inner, held = (checkpoint(part) for part in split)

    def judge(trial: int, rows: DataFrame) -> float:
        scored = build(settings[trial]).fit(rows).transform(held)
        return class_summary(scored, label).first()["macro_f1"] if classify else -regression_metrics(scored, label).first()["rmse"]

    left, told = list(range(trials)), []
    for share in rungs:
        rows = inner if share >= 1 else inner.filter(hash_fraction(f"{seed}/rung", key) < share)
        scores = fit_all([lambda t=t: judge(t, rows) for t in left], parallelism)
        told += [(share, t, s) for t, s in zip(left, scores)]
        ranked = sorted(zip(scores, left), key=lambda x: (-x[0], x[1]))
        left = sorted(t for _, t in ranked[:max(1, int(len(ranked) * keep))]) if share < rungs[-1] else [ranked[0][1]]
    best = settings[left[0]]
    model = build(best).fit(train)
    scored = model.transform(test)
    return best, class_summary(scored, label) if classify else regression_metrics(scored, label), model, told


def score(spark: SparkSession, model_path: str, df: DataFrame) -> DataFrame:
    """Apply a saved model to a table."""
    return PipelineModel.load(model_path).transform(df)


def importance(spark: SparkSession, model, columns: Sequence[str]) -> DataFrame:
    """(feature, importance) of a fitted tree model, largest first."""
    rows = list(zip(columns, [float(x) for x in model.featureImportances.toArray()]))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")


def per_class(df: DataFrame, label: str = "label") -> DataFrame:
    return class_report(df, label)
