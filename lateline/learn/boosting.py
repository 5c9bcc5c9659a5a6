"""Boosted trees on real rows: missing features take a learnt side, classes are boosted jointly.

Spark's tree learners refuse missing features and boost one class against the rest. ``MissingSides`` learns per feature on
which side of a split rows without a value lose least and puts them there; ``BoostedClasses`` fits one tree per class and round
to the softmax gradient and stops when a held-out loss does.
"""

from __future__ import annotations

import math
import uuid

from pyspark import SparkContext
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressionModel
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import MOST_CLASSES, with_class_weight
from ..session import checkpoint
from .base import Keywords, Saved, boolean, floats, integer, number, string, strings
from .experiment import vectors
from .features import Plain
from .models import MODEL_COLUMNS, Learner, fit_all, held_out, predict_as

SMALLEST = 1e-9           # least curvature of a class's loss


def known(c: str) -> Column:
    """The value as double; NaN counts as missing."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


class MissingSidesModel(Plain):
    """Missing values become ``fills``; ``<column>_missing`` tells where, if ``flags`` is set."""

    inputCols = strings("inputCols", "columns completed")
    fills = floats("fills", "value per column")
    flags = boolean("flags", "add a 0/1 column per input")
    defaults = {"flags": True}

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = self["inputCols"]
        flags = {f"{c}_missing": F.isnull(known(c)).cast("double") for c in cols} if self["flags"] else {}
        marked = df.withColumns(flags) if flags else df
        return marked.withColumns({c: F.coalesce(known(c), F.lit(v)) for c, v in zip(cols, self["fills"])})


class MissingSides(Keywords, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Learns what missing values of a column become, from the training rows only.

    ``how="side"`` is for trees: the best split of the known values is searched with the missing rows on its left, on its
    right and on their own; the side that loses least decides whether they get a value below or above all known ones, so
    every tree keeps them together and can still part them from the rest. ``how="median"`` is for other learners. A column
    without missing values in training gets its median for those met later, one without any value gets 0.

    The loss is the squared error of the label, or of the indicators of ``classes`` classes. One pass finds the cuts of all
    columns, a second one sums the label per column and interval; the driver receives ``cuts`` rows per column at most.
    """

    inputCols = strings("inputCols", "columns completed")
    labelCol = string("labelCol", "label")
    how = string("how", "side or median")
    classes = integer("classes", "number of classes of the label; 0 for a number")
    cuts = integer("cuts", "cut points tried per column")
    flags = boolean("flags", "add a 0/1 column per input")
    defaults = {"labelCol": "label", "how": "side", "classes": 0, "cuts": 64, "flags": True}

    def _fit(self, df: DataFrame) -> MissingSidesModel:
        cols, n = self["inputCols"], self["cuts"]
        rows = df.where(F.col(self["labelCol"]).isNotNull()) if self["how"] == "side" else df
        points = F.array(*[F.lit(i / n) for i in range(n + 1)])
        row = rows.agg(*[F.approx_percentile(known(c), points, F.lit(100 * n)).alias(f"q{i}") for i, c in enumerate(cols)],
                       *[F.count_if(F.isnull(known(c))).alias(f"m{i}") for i, c in enumerate(cols)]).first()
        edges = [sorted(set(row[f"q{i}"] or [])) for i in range(len(cols))]
        middle = [(row[f"q{i}"] or [0.0] * (n + 1))[n // 2] for i in range(len(cols))]
        fills = list(middle)
        open_ = [i for i in range(len(cols)) if row[f"m{i}"] and edges[i]] if self["how"] == "side" else []
        if open_:
            sums = self._sums(rows, {i: edges[i] for i in open_})
            for i in open_:
                low, high = edges[i][0], edges[i][-1]
                gap = max(1.0, high - low)
                fills[i] = low - gap if left_loses_least(sums[i], len(edges[i])) else high + gap
        return MissingSidesModel(inputCols=cols, fills=[float(f) for f in fills], flags=self["flags"])

    def _sums(self, rows: DataFrame, edges: dict[int, list[float]]) -> dict[int, dict[int, list[float]]]:
        """Per column and interval: rows, then label sums. Interval -1 holds the missing rows, b the values up to edge b."""
        y = F.col(self["labelCol"])
        told = [(y == k).cast("double") for k in range(self["classes"])] or [y.cast("double")]

        def interval(c, cuts):
            fixed = F.array(*[F.lit(e) for e in cuts[:-1]])
            return F.when(F.isnull(known(c)), -1).otherwise(F.size(F.filter(fixed, lambda e: e < known(c))))

        cells = F.array(*[F.struct(F.lit(i).alias("i"), interval(self["inputCols"][i], cuts).alias("b")) for i, cuts in edges.items()])
        out = (rows.select(F.inline(cells), *[t.alias(f"t{k}") for k, t in enumerate(told)]).groupBy("i", "b")
               .agg(F.count("*").alias("n"), *[F.sum(f"t{k}").alias(f"t{k}") for k in range(len(told))]).collect())
        sums: dict[int, dict[int, list[float]]] = {i: {} for i in edges}
        for r in out:
            sums[r["i"]][r["b"]] = [float(x) for x in r[2:]]
        return sums


def left_loses_least(sums: dict[int, list[float]], intervals: int) -> bool:
    """Whether the best split with the missing rows on the left beats all with them on the right or alone.

    The squared error of a side is what its sums do not explain, so the side's share S²/n is compared."""
    width = len(next(iter(sums.values())))
    none = [0.0] * width
    add = lambda a, b: [x + y for x, y in zip(a, b)]
    explained = lambda s: sum(t * t for t in s[1:]) / s[0] if s[0] else 0.0
    missing = sums.get(-1, none)
    best = {True: float("-inf"), False: float("-inf")}
    below, all_ = none, none
    for b in range(intervals):
        all_ = add(all_, sums.get(b, none))
    for b in range(intervals):
        below = add(below, sums.get(b, none))
        above = [x - y for x, y in zip(all_, below)]
        if above[0] > 0:
            best[True] = max(best[True], explained(add(below, missing)) + explained(above))
        best[False] = max(best[False], explained(below) + explained(add(above, missing)))
    return best[True] > best[False]


def with_missing(columns: list[str], model: Estimator, *, label: str = "label", classes: int = 0, flags: bool = True, features: str = "features") -> Pipeline:
    """``model`` on ``columns`` of which any may be missing: sides learnt, vector built, model fitted."""
    sides = MissingSides(inputCols=list(columns), labelCol=label, classes=classes, flags=flags)
    inputs = [*columns, *([f"{c}_missing" for c in columns] if flags else [])]
    return Pipeline(stages=[sides, vectors(inputs, features), model])


# --- classes boosted jointly ------------------------------------------------------------------------

def softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    parts = [F.exp(s - top) for s in scores]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return [p / total for p in parts]


def weighted_trees(trees: list, step: float) -> GBTRegressionModel:
    """Fitted trees as one native model, each counted with ``step``; it scores in the JVM and is saved as any other."""
    sc = SparkContext._active_spark_context
    of = sc._jvm.org.apache.spark.ml.regression
    array = sc._gateway.new_array(of.DecisionTreeRegressionModel, len(trees))
    weights = sc._gateway.new_array(sc._jvm.double, len(trees))
    for i, t in enumerate(trees):
        array[i] = t._java_obj
        weights[i] = float(step)
    return GBTRegressionModel(of.GBTRegressionModel(f"rounds_{uuid.uuid4().hex[:12]}", array, weights))


class BoostedClassesModel(Keywords, Saved, Model):
    """Probability per class and the likeliest one (ties to the smaller). ``parts["classes"]``: one boosted model per class."""

    featuresCol = string("featuresCol", "feature vector")
    start = floats("start", "score of each class before the first tree")
    rounds = integer("rounds", "trees per class")
    losses = floats("losses", "held-out loss after each round that was tried")

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df.drop(*MODEL_COLUMNS)
        names = [f"__score{k}" for k in range(len(self["start"]))]
        for name, booster in zip(names, self.parts["classes"]):
            out = predict_as(booster.setFeaturesCol(self["featuresCol"]), out, name)
        told = F.array(*softmax([F.lit(s) + F.col(c) for s, c in zip(self["start"], names)]))
        out = out.withColumn("probability", told).drop(*names)
        return out.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))


class BoostedClasses(Learner):
    """Boosted trees for classes 0..K-1 with a joint softmax loss.

    Every round fits one regression tree per class to the gradient over the curvature, weighted by the curvature: a leaf then
    holds the Newton step. Scores are a column of the training rows that each round rewrites through the session's checkpoint
    folder, so plans stay as long as one round and a lost executor repeats no earlier one. A hash of the row key holds a slice
    out; boosting ends after ``patience`` rounds without a loss lower by ``tolerance`` (relative) and keeps the best number
    of rounds. ``slice=0`` fits exactly ``rounds``. Missing features belong to ``MissingSides``.
    """

    keyCols = strings("keyCols", "row key that picks the slice")
    slice = number("slice", "share held out")
    seed = integer("seed", "seed of the slice and the trees")
    rounds = integer("rounds", "most trees per class")
    depth = integer("depth", "depth of a tree")
    leaf = integer("leaf", "least rows in a leaf")
    step = number("step", "share of each Newton step taken")
    patience = integer("patience", "rounds without improvement before stopping")
    tolerance = number("tolerance", "least relative improvement that counts")
    mode = string("mode", "row weights: balanced, sqrt_balanced or none")
    parallelism = integer("parallelism", "trees fitted at the same time")
    defaults = {"slice": 0.1, "seed": 42, "rounds": 100, "depth": 4, "leaf": 1, "step": 0.1, "patience": 5, "tolerance": 1e-4,
                "mode": "balanced", "parallelism": 2}

    def _fit(self, df: DataFrame) -> BoostedClassesModel:
        x, y = self["featuresCol"], self["labelCol"]
        count = int(df.agg(F.max(y)).first()[0] or 0) + 1
        if count > MOST_CLASSES:
            raise ValueError(f"{y} has more than {MOST_CLASSES} values: no class")
        weighted = with_class_weight(df, y, None if self["mode"] == "none" else self["mode"], "__w")
        held = held_out(self["seed"], self["keyCols"]) < self["slice"] if self["slice"] > 0 else F.lit(False)
        rows = checkpoint(weighted.select(F.col(x).alias("x"), F.col(y).cast("int").alias("y"), F.col("__w").alias("w"), held.alias("held")))
        shares = {r["y"]: r["s"] for r in rows.where(~F.col("held")).groupBy("y").agg(F.sum("w").alias("s")).collect()}
        total = sum(shares.values())
        start = [float(math.log(max(shares.get(k, 0.0) / total, SMALLEST))) for k in range(count)]
        state = rows.withColumn("f", F.array(*[F.lit(s) for s in start]))
        steps, losses, best, waited = [], [], None, 0
        for _ in range(self["rounds"]):
            trees = self._round(state.where(~F.col("held")), count)
            steps.append(trees)
            state = self._advanced(state, trees)
            if self["slice"] <= 0:
                continue
            losses.append(self._loss(state.where("held"), count))
            if best is None or losses[-1] < losses[best] * (1 - self["tolerance"]):
                best, waited = len(losses) - 1, 0
            else:
                waited += 1
                if waited >= self["patience"]:
                    break
        kept = steps if best is None else steps[:best + 1]
        boosters = [weighted_trees([trees[k] for trees in kept], self["step"]) for k in range(count)]
        return BoostedClassesModel(featuresCol=x, start=start, rounds=len(kept), losses=losses).owning(parts={"classes": boosters})

    def _round(self, rows: DataFrame, count: int) -> list:
        p = softmax([F.get("f", F.lit(k)) for k in range(count)])
        tree = DecisionTreeRegressor(featuresCol="x", labelCol="t", weightCol="h", maxDepth=self["depth"], minInstancesPerNode=self["leaf"], seed=self["seed"])

        def fit(k):
            bend = F.greatest(p[k] * (1 - p[k]), F.lit(SMALLEST))
            return tree.fit(rows.select("x", (((F.col("y") == k).cast("double") - p[k]) / bend).alias("t"), (F.col("w") * bend).alias("h")))

        return fit_all([lambda k=k: fit(k) for k in range(count)], self["parallelism"])

    def _advanced(self, state: DataFrame, trees: list) -> DataFrame:
        out = state
        for k, tree in enumerate(trees):
            out = predict_as(tree, out, f"p{k}")
        f = F.array(*[F.get("f", F.lit(k)) + F.lit(self["step"]) * F.col(f"p{k}") for k in range(len(trees))])
        return checkpoint(out.select("x", "y", "w", "held", f.alias("f")))

    def _loss(self, rows: DataFrame, count: int) -> float:
        p = F.get(F.array(*softmax([F.get("f", F.lit(k)) for k in range(count)])), F.col("y"))
        row = rows.agg(F.sum(-F.log(F.greatest(p, F.lit(SMALLEST))) * F.col("w")), F.sum("w")).first()
        return row[0] / row[1] if row[1] else 0.0
