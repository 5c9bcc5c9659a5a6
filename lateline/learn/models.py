"""Delay models: ridge, boosted trees, forests, and the wrappers built around any of them."""

from __future__ import annotations

from contextlib import contextmanager
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import shifted_exp, shifted_log
from ..functions.delays import class_centres, delay_class
from ..operators.metrics import class_values, with_class_weight
from ..operators.sampling import hash_fraction, with_fold, with_stratified_fold
from ..session import checkpoint
from .base import Keywords, Saved, boolean, floats, integer, number, string, strings

MODEL_COLUMNS = ["prediction", "rawPrediction", "probability"]


def fit_all(jobs, parallelism: int) -> list:
    """Run independent fits as concurrent Spark jobs."""
    if parallelism <= 1 or len(jobs) <= 1:
        return [job() for job in jobs]
    with ThreadPool(min(parallelism, len(jobs))) as pool:
        return pool.map(lambda job: job(), jobs)


def held_out(seed: int, key: list[str]):
    """Uniform number per row for an inner slice.

    The tag keeps it independent of an outer split drawn with the same seed and key, which would
    otherwise have taken exactly the rows this slice asks for.
    """
    return hash_fraction(f"{seed}/slice", key)


def predict_as(model, df: DataFrame, name: str, source: str = "prediction") -> DataFrame:
    """Append one column of a model's output under a new name and drop the rest of it."""
    keep = df.columns
    out = model.transform(df.drop(*MODEL_COLUMNS))
    value = F.col(source)
    if source == "probability":
        value = vector_to_array(value)
    scored = out.withColumn(name, value)
    return scored.select(*[c for c in keep if c not in MODEL_COLUMNS], name)


class Learner(Keywords, Estimator):
    featuresCol = string("featuresCol", "feature vector")
    labelCol = string("labelCol", "label")
    base = {"featuresCol": "features", "labelCol": "label"}

    def __init__(self, **kw):
        self.defaults = {**Learner.base, **self.defaults}
        super().__init__(**kw)

    def fit(self, dataset: DataFrame, params=None):
        """Rows without a label teach nothing; every learner sees only the others."""
        return super().fit(dataset.filter(F.col(self["labelCol"]).isNotNull()), params)


class Ridge(Learner, DefaultParamsReadable, DefaultParamsWritable):
    """L2-penalised least squares: minimise |y - Xw - b|² + alpha |w|².

    The normal-equation solver of LinearRegression aggregates the Gram matrix in one pass. Its
    regParam is scaled by rows and label spread, so alpha is converted with one small aggregate.
    """

    alpha = number("alpha", "penalty")
    defaults = {"alpha": 1.0}

    def _fit(self, df: DataFrame):
        y = self["labelCol"]
        n, spread = df.filter(F.col(y).isNotNull()).agg(F.count(F.lit(1)), F.stddev_pop(y)).first()
        reg = self["alpha"] * (spread or 0.0) / n if n else 0.0
        return LinearRegression(
            featuresCol=self["featuresCol"], labelCol=y, solver="normal", regParam=reg, elasticNetParam=0.0,
            standardization=False).fit(df.filter(F.col(y).isNotNull()))


class EarlyStopped(Learner):
    """Boosted trees that stop adding rounds when a held-out slice stops improving."""

    keyCols = strings("keyCols", "row key that picks the slice")
    slice = number("slice", "share held out")
    seed = integer("seed", "seed of the slice")
    defaults = {"slice": 0.1, "seed": 42}

    def __init__(self, booster=None, **kw):
        super().__init__(**kw)
        self.booster = booster

    def _fit(self, df: DataFrame):
        held = df.withColumn("__held", held_out(self["seed"], self["keyCols"]) < self["slice"])
        est = self.booster.copy()
        est.setFeaturesCol(self["featuresCol"]).setLabelCol(self["labelCol"]).setValidationIndicatorCol("__held")
        return est.fit(held)


class GrowingForest(Learner):
    """Forest whose size is chosen on a held-out slice, then refitted on all rows."""

    keyCols = strings("keyCols", "row key that picks the slice")
    slice = number("slice", "share held out")
    seed = integer("seed", "seed of the slice")
    sizes = floats("sizes", "tree counts to try, rising")
    patience = integer("patience", "sizes without improvement before stopping")
    tolerance = number("tolerance", "least relative improvement that counts")
    defaults = {"slice": 0.1, "seed": 42, "sizes": [10.0, 20.0, 40.0, 80.0], "patience": 1, "tolerance": 1e-3}

    def __init__(self, forest=None, **kw):
        super().__init__(**kw)
        self.forest = forest

    def _fit(self, df: DataFrame):
        u = held_out(self["seed"], self["keyCols"])
        train, held = df.filter(u >= self["slice"]), df.filter(u < self["slice"])
        classify = isinstance(self.forest, RandomForestClassifier)
        judge = (MulticlassClassificationEvaluator(metricName="f1", labelCol=self["labelCol"]) if classify
                 else RegressionEvaluator(metricName="rmse", labelCol=self["labelCol"]))
        sign = 1.0 if judge.isLargerBetter() else -1.0
        est = self.forest.copy().setFeaturesCol(self["featuresCol"]).setLabelCol(self["labelCol"])
        best, best_size, waited = None, int(self["sizes"][0]), 0
        for size in self["sizes"]:
            score = sign * judge.evaluate(est.copy({est.numTrees: int(size)}).fit(train).transform(held))
            if best is None or score > best + self["tolerance"] * abs(best):
                best, best_size, waited = score, int(size), 0
            else:
                waited += 1
                if waited >= self["patience"]:
                    break
        return est.copy({est.numTrees: best_size}).fit(df)


def boosted_classifier(weighted: bool = True, parallelism: int = 1, **kw) -> Estimator:
    """One boosted model per class against the rest, with balanced row weights."""
    inner = GBTClassifier(**kw)
    ovr = OneVsRest(classifier=inner, parallelism=parallelism)
    return Balanced(model=ovr) if weighted else ovr


class Balanced(Learner):
    """Adds balanced (or square-root balanced) class weights before fitting a classifier."""

    mode = string("mode", "balanced or sqrt_balanced")
    defaults = {"mode": "balanced"}

    def __init__(self, model=None, **kw):
        super().__init__(**kw)
        self.model = model

    def _fit(self, df: DataFrame):
        weighted = with_class_weight(df, self["labelCol"], self["mode"], "__w")
        est = self.model.copy().setFeaturesCol(self["featuresCol"]).setLabelCol(self["labelCol"]).setWeightCol("__w")
        return est.fit(weighted)


def logistic(l1_share: float = 0.0, strength: float = 0.0, balanced: bool = True, max_iter: int = 50) -> Estimator:
    est = LogisticRegression(elasticNetParam=l1_share, regParam=strength, maxIter=max_iter)
    return Balanced(model=est) if balanced else est


def forest_classifier(balanced: bool = True, **kw) -> Estimator:
    est = RandomForestClassifier(**kw)
    return Balanced(model=est) if balanced else est


def perceptron(inputs: int, classes: int, hidden=(128, 64, 32), **kw) -> Estimator:
    return MultilayerPerceptronClassifier(layers=[inputs, *hidden, classes], **kw)


class StoppingPerceptron(Learner):
    """Perceptron trained in blocks of iterations, each from the weights of the last, until a held-out slice stops improving.

    ``hidden`` are the layer sizes between inputs and classes. A block that does not lower the held-out log loss by ``tolerance``
    (relative) counts against ``patience``; the best block's weights are kept. The rows are written once for all blocks.
    """

    keyCols = strings("keyCols", "row key that picks the slice")
    slice = number("slice", "share held out")
    seed = integer("seed", "seed of the slice and the first weights")
    hidden = floats("hidden", "sizes of the hidden layers")
    block = integer("block", "iterations between two looks")
    most = integer("most", "iterations in all")
    patience = integer("patience", "blocks without improvement before stopping")
    tolerance = number("tolerance", "least relative improvement that counts")
    defaults = {"slice": 0.1, "seed": 42, "hidden": [128.0, 64.0, 32.0], "block": 10, "most": 200, "patience": 2, "tolerance": 1e-3}

    def _fit(self, df: DataFrame) -> StoppedPerceptronModel:
        x, y = self["featuresCol"], self["labelCol"]
        rows = checkpoint(df.select(x, F.col(y).cast("double").alias(y), held_out(self["seed"], self["keyCols"]).alias("__u")))
        train, held = rows.filter(F.col("__u") >= self["slice"]), rows.filter(F.col("__u") < self["slice"])
        width, classes = train.select(F.size(vector_to_array(x)), F.lit(0)).first()[0], int(train.agg(F.max(y)).first()[0]) + 1
        judge = MulticlassClassificationEvaluator(metricName="logLoss", labelCol=y)
        layers = [width, *[int(h) for h in self["hidden"]], max(2, classes)]
        best, losses, weights, waited = None, [], None, 0
        for _ in range(0, self["most"], self["block"]):
            est = MultilayerPerceptronClassifier(featuresCol=x, labelCol=y, layers=layers, maxIter=self["block"], seed=self["seed"])
            if weights is not None:
                est.setInitialWeights(weights)
            model = est.fit(train)
            weights = model.weights
            losses.append(float(judge.evaluate(model.transform(held))))
            if best is None or losses[-1] < min(losses[:-1]) * (1 - self["tolerance"]):
                best, waited = (model, len(losses)), 0
            else:
                waited += 1
                if waited >= self["patience"]:
                    break
        return StoppedPerceptronModel(iterations=len(losses) * self["block"], kept=best[1] * self["block"], losses=losses).owning(parts={"inner": best[0]})


class StoppedPerceptronModel(Keywords, Model, Saved):
    iterations = integer("iterations", "iterations run")
    kept = integer("kept", "iterations behind the weights kept")
    losses = floats("losses", "held-out log loss after each block")

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.parts["inner"].transform(df.drop(*MODEL_COLUMNS))


# --- ensembles ------------------------------------------------------------------------------------

class Ensemble(Learner):
    keyCols = strings("keyCols", "row key that picks the fold")
    folds = integer("folds", "number of folds")
    seed = integer("seed", "seed of the folds")
    parallelism = integer("parallelism", "fits running at the same time")
    defaults = {"folds": 5, "seed": 42, "parallelism": 2}


@contextmanager
def kept(df: DataFrame):
    """The rows of ``df``, written once and cached while several fits pass over them; what a cache loses is read again."""
    rows = checkpoint(df).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield rows
    finally:
        rows.unpersist()


def out_of_fold(df: DataFrame, estimators: list, folds: int, names: list[str], source: str, parallelism: int) -> DataFrame:
    """Rows with the predictions of models that did not see them. ``df`` has a fold column.

    Every fold's rows run through that fold's models one after the other, so no join by row is
    needed and each row appears exactly once.
    """
    jobs = [
        (lambda e=e, f=f: e.fit(df.filter(F.col("fold") != f))) for f in range(folds) for e in estimators
    ]
    models = fit_all(jobs, parallelism)
    parts = []
    for f in range(folds):
        part = df.filter(F.col("fold") == f)
        for i, name in enumerate(names):
            part = predict_as(models[f * len(estimators) + i], part, name, source)
        parts.append(part)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class StackedRegressor(Ensemble):
    """Meta model on out-of-fold predictions of the base models; bases refitted on all rows."""

    def __init__(self, bases=None, meta=None, **kw):
        super().__init__(**kw)
        self.bases, self.meta = bases or [], meta

    def _fit(self, df: DataFrame) -> StackedRegressorModel:
        names = [f"__p{i}" for i in range(len(self.bases))]
        with kept(with_fold(df, self["folds"], self["seed"], self["keyCols"])) as folded:
            return self._stacked(folded, names)

    def _stacked(self, folded: DataFrame, names: list[str]) -> StackedRegressorModel:
        df = folded.drop("fold")
        oof = out_of_fold(folded, self.bases, self["folds"], names, "prediction", self["parallelism"])
        stacked = oof.withColumn("__meta", array_to_vector(F.array(*names))).drop(self["featuresCol"]).withColumnRenamed(
            "__meta", self["featuresCol"])
        with kept(stacked.select(self["featuresCol"], self["labelCol"])) as few:
            meta = self.meta.fit(few)
        full = fit_all([(lambda e=e: e.fit(df)) for e in self.bases], self["parallelism"])
        return StackedRegressorModel(featuresCol=self["featuresCol"]).owning(parts={"bases": full, "meta": meta})


class StackedRegressorModel(Keywords, Model, Saved):
    featuresCol = string("featuresCol", "feature vector")
    defaults = {"featuresCol": "features"}

    def _transform(self, df: DataFrame) -> DataFrame:
        names = []
        scored = df
        for i, m in enumerate(self.parts["bases"]):
            names.append(f"__p{i}")
            scored = predict_as(m, scored, names[-1])
        f = self["featuresCol"]
        swapped = scored.withColumn("__own", F.col(f)).withColumn(f, array_to_vector(F.array(*names)))
        return predict_as(self.parts["meta"], swapped, "__y").withColumn(f, F.col("__own")).drop(
            "__own", *names).withColumnRenamed("__y", "prediction")


class ResidualStack(Ensemble):
    """Second model fitted on the first one's out-of-fold errors; the predictions add up."""

    def __init__(self, first=None, second=None, **kw):
        super().__init__(**kw)
        self.first, self.second = first, second

    def _fit(self, df: DataFrame) -> ResidualStackModel:
        y = self["labelCol"]
        # The rows are read once per fold and model: keep them instead of recomputing their plan.
        folded = checkpoint(with_fold(df, self["folds"], self["seed"], self["keyCols"]))
        df = folded.drop("fold")
        oof = out_of_fold(folded, [self.first], self["folds"], ["__p"], "prediction", self["parallelism"])
        errors = oof.withColumn(y, F.col(y) - F.col("__p")).drop("__p")
        one, two = fit_all([lambda: self.first.fit(df), lambda: self.second.fit(errors)], self["parallelism"])
        return ResidualStackModel().owning(parts={"first": one, "second": two})


class ResidualStackModel(Keywords, Model, Saved):
    def _transform(self, df: DataFrame) -> DataFrame:
        one = predict_as(self.parts["first"], df, "__p1")
        two = predict_as(self.parts["second"], one, "__p2")
        return two.withColumn("prediction", F.col("__p1") + F.col("__p2")).drop("__p1", "__p2")


class LogTarget(Learner):
    """Fits on log(y + offset); the offset rises when the smallest label would not allow it."""

    offset = number("offset", "smallest shift")
    defaults = {"offset": 1.0}

    def __init__(self, model=None, **kw):
        super().__init__(**kw)
        self.model = model

    def _fit(self, df: DataFrame) -> LogTargetModel:
        y = self["labelCol"]
        low = df.agg(F.min(y)).first()[0]
        shift = self["offset"] if low is None or low > -self["offset"] else 1.0 - float(low)
        return LogTargetModel(offset=shift).owning(
            parts={"inner": self.model.fit(df.withColumn(y, shifted_log(y, shift)))})


class LogTargetModel(Keywords, Model, Saved):
    offset = number("offset", "shift used in the fit")

    def _transform(self, df: DataFrame) -> DataFrame:
        out = predict_as(self.parts["inner"], df, "__p")
        return out.withColumn("prediction", shifted_exp("__p", self["offset"])).drop("__p")


class ByClass(Learner):
    """Predict the delay class, then use the regressor fitted on that class's rows."""

    bins = floats("bins", "class edges")
    least = integer("least", "rows a class needs for its own regressor")
    parallelism = integer("parallelism", "fits running at the same time")
    defaults = {"bins": [180.0], "least": 10, "parallelism": 2}

    def __init__(self, classifier=None, regressor=None, **kw):
        super().__init__(**kw)
        self.classifier, self.regressor = classifier, regressor

    def _fit(self, df: DataFrame) -> ByClassModel:
        y = self["labelCol"]
        coded = df.withColumn("__cls", delay_class(y, self["bins"]))
        # As many rows as there are classes.
        sizes = {r["__cls"]: r["count"] for r in coded.groupBy("__cls").count().collect()}
        classes = sorted(sizes)
        own = lambda c: coded.filter(F.col("__cls") == c) if sizes[c] >= self["least"] else coded
        jobs = [lambda: self.classifier.fit(coded.withColumn(y, F.col("__cls").cast("double")))]
        jobs += [(lambda c=c: self.regressor.fit(own(c))) for c in classes]
        clf, *regs = fit_all(jobs, self["parallelism"])
        return ByClassModel(classes=[float(c) for c in classes]).owning(parts={"classifier": clf, "regressors": regs})


class ByClassModel(Keywords, Model, Saved):
    classes = floats("classes", "class numbers seen in training")

    def _transform(self, df: DataFrame) -> DataFrame:
        out = predict_as(self.parts["classifier"], df, "__cls")
        pick = F.lit(0.0)
        for i, (c, reg) in enumerate(zip(self["classes"], self.parts["regressors"])):
            out = predict_as(reg, out, f"__r{i}")
            pick = F.when(F.col("__cls") == c, F.col(f"__r{i}")).otherwise(pick)
        drop = [f"__r{i}" for i in range(len(self["classes"]))]
        return out.withColumn("prediction", pick).drop("__cls", *drop)


class Ordinal(Learner):
    """K - 1 models for "at least class k"; probabilities are differences of the clipped chain.

    ``expected`` gives the probability-weighted class centre instead of the likeliest class; the
    label is then a delay that is cut at ``bins`` first.
    """

    bins = floats("bins", "class edges; only for a delay label")
    expected = boolean("expected", "predict a delay instead of a class")
    parallelism = integer("parallelism", "fits running at the same time")
    defaults = {"expected": False, "parallelism": 2}

    def __init__(self, model=None, **kw):
        super().__init__(**kw)
        self.model = model

    def _fit(self, df: DataFrame) -> OrdinalModel:
        y = self["labelCol"]
        coded = df.withColumn(y, delay_class(y, self["bins"]).cast("double")) if self["expected"] else df
        classes = class_values(coded, y)
        jobs = [
            (lambda c=c: self.model.fit(coded.withColumn(y, (F.col(y) >= c).cast("double")))) for c in classes[1:]
        ]
        models = fit_all(jobs, self["parallelism"])
        centres = []
        if self["expected"]:
            all_centres = class_centres(self["bins"])
            centres = [all_centres[int(c)] for c in classes]
        return OrdinalModel(classes=[float(c) for c in classes], centres=centres).owning(parts={"steps": models})


def chain_probabilities(at_least: list) -> list:
    """Class probabilities from P(at least k): clip to a falling chain, take differences, normalise."""
    chain = []
    for p in at_least:
        chain.append(F.least(p, chain[-1]) if chain else p)
    raw = [1.0 - chain[0], *[a - b for a, b in zip(chain, chain[1:])], chain[-1]]
    clipped = [F.greatest(r, F.lit(0.0)) for r in raw]
    total = clipped[0]
    for c in clipped[1:]:
        total = total + c
    return [c / total for c in clipped]


class OrdinalModel(Keywords, Model, Saved):
    classes = floats("classes", "class numbers in order")
    centres = floats("centres", "delay of each class; empty for a class prediction")

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df
        names = []
        for i, m in enumerate(self.parts["steps"]):
            names.append(f"__s{i}")
            out = predict_as(m, out, names[-1], "probability")
        if not names:
            only = self["centres"][0] if self["centres"] else self["classes"][0]
            return out.withColumn("prediction", F.lit(only))
        probs = chain_probabilities([F.get(n, F.lit(1)) for n in names])
        out = out.withColumn("__prob", F.array(*probs)).drop(*names)
        if self["centres"]:
            value = F.lit(0.0)
            for i, c in enumerate(self["centres"]):
                value = value + F.get("__prob", F.lit(i)) * F.lit(c)
        else:
            best = F.array_position("__prob", F.array_max("__prob")).cast("int") - 1
            value = F.get(F.array(*[F.lit(c) for c in self["classes"]]), best)
        return out.withColumns({"prediction": value, "probability": array_to_vector(F.col("__prob"))}).drop("__prob")


class StackedClassifier(Ensemble):
    """Meta classifier on the out-of-fold class probabilities of the base models."""

    def __init__(self, bases=None, meta=None, **kw):
        if bases is not None and not bases:
            raise ValueError("at least one base model is needed")
        super().__init__(**kw)
        self.bases, self.meta = bases or [], meta

    def _fit(self, df: DataFrame) -> StackedClassifierModel:
        names = [f"__p{i}" for i in range(len(self.bases))]
        folded = checkpoint(with_stratified_fold(df, self["labelCol"], self["folds"], self["seed"], self["keyCols"]))
        df = folded.drop("fold")
        oof = out_of_fold(folded, self.bases, self["folds"], names, "probability", self["parallelism"])
        f = self["featuresCol"]
        meta = self.meta.fit(oof.withColumn(f, array_to_vector(F.concat(*names))))
        full = fit_all([(lambda e=e: e.fit(df)) for e in self.bases], self["parallelism"])
        return StackedClassifierModel(featuresCol=f).owning(parts={"bases": full, "meta": meta})


class StackedClassifierModel(Keywords, Model, Saved):
    featuresCol = string("featuresCol", "feature vector")
    defaults = {"featuresCol": "features"}

    def _transform(self, df: DataFrame) -> DataFrame:
        names = []
        out = df
        for i, m in enumerate(self.parts["bases"]):
            names.append(f"__p{i}")
            out = predict_as(m, out, names[-1], "probability")
        f = self["featuresCol"]
        swapped = out.withColumn("__own", F.col(f)).withColumn(f, array_to_vector(F.concat(*names))).drop(*names)
        return self.parts["meta"].transform(swapped).withColumn(f, F.col("__own")).drop("__own")


def default_regressors(keys: list[str]) -> dict[str, Estimator]:
    """Named regressors of the comparison suite, on a ``features`` vector and a ``label``."""
    gbt = GBTRegressor(maxIter=20, maxDepth=5, seed=42)
    return {
        "ridge": Ridge(alpha=1.0),
        "boosted": EarlyStopped(booster=gbt, keyCols=keys),
        "forest": RandomForestRegressor(numTrees=20, maxDepth=8, seed=42),
        "log_ridge": LogTarget(model=Ridge(alpha=1.0)),
        "stack": StackedRegressor(bases=[Ridge(alpha=1.0), RandomForestRegressor(numTrees=10, seed=42)],
                                  meta=Ridge(alpha=1.0), keyCols=keys),
        "residual": ResidualStack(first=Ridge(alpha=1.0), second=gbt, keyCols=keys),
    }
