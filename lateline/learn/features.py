"""Feature stages. State is fitted on the training table only and applied as column expressions."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import direction_parts, is_adverse, is_rush_hour, mean_of_two, wind_chill
from ..functions.delays import class_centres, class_names, delay_class, pick
from ..operators.joins import lookup
from ..operators.quantiles import medians
from ..operators.sampling import sample_exact
from ..operators.windows import position, previous_value, sampled_chunks
from ..session import checkpoint
from .base import Keywords, Saved, boolean, floats, integer, number, string, strings


class Plain(Keywords, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A stage without state."""


class CalendarParts(Plain):
    """timestamp → hour, dow, month (integers); the timestamp is dropped."""

    timeCol = string("timeCol", "zone-less timestamp column")
    defaults = {"timeCol": "timestamp"}

    def _transform(self, df: DataFrame) -> DataFrame:
        ts = F.col(self["timeCol"])
        return df.withColumns({"hour": F.hour(ts), "dow": F.weekday(ts), "month": F.month(ts)}).drop(self["timeCol"])


class WindMean(Plain):
    """Two wind columns → their mean; both inputs are dropped."""

    inputCols = strings("inputCols", "speed and gust")
    outputCol = string("outputCol", "name of the mean")
    defaults = {"inputCols": ["wind_speed", "wind_gust"], "outputCol": "wind"}

    def _transform(self, df: DataFrame) -> DataFrame:
        a, b = self["inputCols"]
        return df.withColumn(self["outputCol"], mean_of_two(a, b)).drop(a, b)


class WindDirection(Plain):
    """Degrees → sin and cos; the source is dropped."""

    inputCol = string("inputCol", "direction in degrees")
    defaults = {"inputCol": "wind_dir"}

    def _transform(self, df: DataFrame) -> DataFrame:
        c = self["inputCol"]
        sin, cos = direction_parts(c)
        return df.withColumns({f"{c}_sin": sin, f"{c}_cos": cos}).drop(c)


class WeatherSigns(Plain):
    """Adds wind_chill and adverse_weather."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            "wind_chill": wind_chill("temperature", "wind_speed"),
            "adverse_weather": is_adverse("precipitation", "snow_depth").cast("tinyint"),
        })


class RushHourStress(Plain):
    """Adds is_rush_hour and weather_rush_hour_stress from ``hour``, else from the timestamp."""

    timeCol = string("timeCol", "used when there is no hour column")
    defaults = {"timeCol": "timestamp"}

    def _transform(self, df: DataFrame) -> DataFrame:
        if "hour" in df.columns:
            hour = F.col("hour")
        elif self["timeCol"] in df.columns:
            hour = F.hour(self["timeCol"])
        else:
            raise ValueError("need an hour or a timestamp column")
        rush = F.coalesce(is_rush_hour(hour), F.lit(False))
        return df.withColumns({
            "is_rush_hour": rush.cast("tinyint"),
            "weather_rush_hour_stress": (rush & is_adverse("precipitation", "snow_depth")).cast("tinyint"),
        })


class CategoryCodes(Keywords, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Text → code in order of first appearance (by ``orderCol``), or alphabetical without one.

    Unknown and NULL values get one code past the last.
    """

    inputCols = strings("inputCols", "columns replaced by their code")
    orderCol = string("orderCol", "numeric column that defines appearance")

    def _fit(self, df: DataFrame) -> CategoryCodesModel:
        tables, sizes = {}, []
        for c in self["inputCols"]:
            known = df.filter(F.col(c).isNotNull())
            value = F.col(c).cast("string").alias("value")
            if self.has("orderCol"):
                seen = known.groupBy(value).agg(F.min(self["orderCol"]).alias("first"))
                codes = position(seen, [], ["first", "value"], "code", chunk=sampled_chunks(seen, "first"), hot_rows=0)
            else:
                seen = known.select(value).distinct()
                codes = position(seen, [], ["value"], "code", chunk=sampled_chunks(seen, "value"), hot_rows=0)
            tables[c] = checkpoint(codes.select("value", "code"))  # fitted once, whatever the files become
            sizes.append(tables[c].count())
        return CategoryCodesModel(inputCols=self["inputCols"], sizes=[float(s) for s in sizes]).owning(tables)


class CategoryCodesModel(Keywords, Model, Saved):
    inputCols = strings("inputCols", "columns replaced by their code")
    sizes = floats("sizes", "number of known values per column")

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c, n in zip(self["inputCols"], self["sizes"]):
            keyed = out.withColumn("__text", F.col(c).cast("string"))
            coded = lookup(keyed, self.tables[c], {"__text": "value"}, {"code": "__code"},
                           default={"__code": F.lit(int(n))})
            out = coded.withColumn(c, F.col("__code")).select(*df.columns)
        return out


class HistoricalMean(Keywords, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Mean of the label per key of the training rows; unseen keys get the global mean."""

    keyCols = strings("keyCols", "grouping columns")
    labelCol = string("labelCol", "label")
    outputCol = string("outputCol", "new column")
    defaults = {"labelCol": "label", "outputCol": "hist_mean_delay"}

    def _fit(self, df: DataFrame) -> HistoricalMeanModel:
        y = self["labelCol"]
        if y not in df.columns:
            raise ValueError(f"label column {y} is required")
        overall = df.agg(F.avg(y)).first()[0]
        table = checkpoint(df.dropna(subset=self["keyCols"]).groupBy(*self["keyCols"]).agg(F.avg(y).alias("mean")))
        return HistoricalMeanModel(
            keyCols=self["keyCols"], outputCol=self["outputCol"], overall=float(overall)).owning({"means": table})


class HistoricalMeanModel(Keywords, Model, Saved):
    keyCols = strings("keyCols", "grouping columns")
    outputCol = string("outputCol", "new column")
    overall = number("overall", "global training mean")

    def _transform(self, df: DataFrame) -> DataFrame:
        out = self["outputCol"]
        return lookup(df, self.tables["means"], {k: k for k in self["keyCols"]}, {"mean": out},
                      default={out: F.lit(self["overall"])})


class Standardize(Keywords, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """(x - mean) / population std per column; a constant column is only centred."""

    inputCols = strings("inputCols", "columns scaled in place")

    def _fit(self, df: DataFrame) -> StandardizeModel:
        cols = self["inputCols"]
        row = df.agg(*[F.avg(c) for c in cols], *[F.stddev_pop(c) for c in cols]).first()
        return StandardizeModel(
            inputCols=cols, means=[float(v or 0.0) for v in row[: len(cols)]],
            scales=[float(v) if v else 1.0 for v in row[len(cols):]])


class StandardizeModel(Keywords, Model, DefaultParamsReadable, DefaultParamsWritable):
    inputCols = strings("inputCols", "columns scaled in place")
    means = floats("means", "training means")
    scales = floats("scales", "training population std")

    def _transform(self, df: DataFrame) -> DataFrame:
        parts = zip(self["inputCols"], self["means"], self["scales"])
        return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in parts})


def product_terms(columns: list[str], degree: int) -> dict[str, list[str]]:
    """Term name → factors: ``a``, ``a^2``, ``a b`` …, by rising degree, no constant."""
    out = {}
    for d in range(1, degree + 1):
        for factors in combinations_with_replacement(columns, d):
            powers = [(c, factors.count(c)) for c in dict.fromkeys(factors)]
            out[" ".join(c if n == 1 else f"{c}^{n}" for c, n in powers)] = list(factors)
    return out


def _product(factors: list[str]):
    total = F.col(factors[0]).cast("double")
    for f in factors[1:]:
        total = total * F.col(f)
    return total


class Products(Plain):
    """Polynomial terms of the chosen columns; the other columns pass through."""

    inputCols = strings("inputCols", "columns expanded")
    degree = integer("degree", "highest total degree")
    defaults = {"degree": 2}

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = self["inputCols"]
        rest = [F.col(c) for c in df.columns if c not in cols]
        terms = product_terms(cols, self["degree"])
        return df.select(*rest, *[_product(f).alias(n) for n, f in terms.items()])


class ProductsAndWaves(Plain):
    """Polynomial terms plus sin(kx) and cos(kx), k = 1..waves."""

    inputCols = strings("inputCols", "columns expanded")
    degree = integer("degree", "highest total degree")
    waves = integer("waves", "harmonics per column")
    defaults = {"degree": 2, "waves": 1}

    def _transform(self, df: DataFrame) -> DataFrame:
        cols, k = self["inputCols"], self["waves"]
        rest = [F.col(c) for c in df.columns if c not in cols]
        terms = [_product(f).alias(n) for n, f in product_terms(cols, self["degree"]).items()]
        tag = (lambda i: f"_{i}") if k > 1 else (lambda i: "")
        waves = [w for c in cols for i in range(1, k + 1) for w in (
            F.sin(i * F.col(c)).alias(f"{c}_sin{tag(i)}"), F.cos(i * F.col(c)).alias(f"{c}_cos{tag(i)}"))]
        return df.select(*rest, *terms, *waves)


class Waves(Plain):
    """Columns → sin(kx), cos(kx) for k = 1..waves; the columns are dropped."""

    inputCols = strings("inputCols", "columns expanded")
    waves = integer("waves", "harmonics per column")
    defaults = {"waves": 1}

    def _transform(self, df: DataFrame) -> DataFrame:
        new = {}
        for c in self["inputCols"]:
            for i in range(1, self["waves"] + 1):
                new[f"{c}_sin{i}"] = F.sin(i * F.col(c))
                new[f"{c}_cos{i}"] = F.cos(i * F.col(c))
        return df.withColumns(new).drop(*self["inputCols"])


class PrincipalParts(Keywords, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Columns → pc1..pcm of the centred data, m fixed or the fewest that reach ``variance``."""

    inputCols = strings("inputCols", "columns replaced")
    k = integer("k", "number of components")
    variance = number("variance", "share of the variance to keep")

    def _fit(self, df: DataFrame) -> PrincipalPartsModel:
        cols = self["inputCols"]
        means = [float(v or 0.0) for v in df.agg(*[F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in cols]).first()]
        filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
        vectors = VectorAssembler(inputCols=cols, outputCol="v").transform(filled)
        full = self["k"] if self.has("k") else len(cols)
        fitted = PCA(k=full, inputCol="v", outputCol="pc").fit(vectors)
        explained = [float(x) for x in fitted.explainedVariance.toArray()]
        m = full
        if not self.has("k") and self.has("variance"):
            m = int(np.searchsorted(np.cumsum(explained), self["variance"] - 1e-12) + 1)
            m = min(m, full)
        basis = fitted.pc.toArray()[:, :m]
        return PrincipalPartsModel(inputCols=cols, means=means, basis=[float(x) for x in basis.ravel()],
                                   explained=explained[:m])


class PrincipalPartsModel(Keywords, Model, DefaultParamsReadable, DefaultParamsWritable):
    inputCols = strings("inputCols", "columns replaced")
    means = floats("means", "training means")
    basis = floats("basis", "components, row by input column")
    explained = floats("explained", "share of the variance per component")

    def _transform(self, df: DataFrame) -> DataFrame:
        cols, m = self["inputCols"], len(self["explained"])
        basis = np.array(self["basis"]).reshape(len(cols), m)
        rest = [F.col(c) for c in df.columns if c not in cols]
        parts = []
        for j in range(m):
            total = F.lit(0.0)
            for i, (c, mean) in enumerate(zip(cols, self["means"])):
                total = total + (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(mean)) * F.lit(float(basis[i, j]))
            parts.append(total.alias(f"pc{j + 1}"))
        return df.select(*rest, *parts)


class KernelFeatures(Keywords, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Radial-basis kernel to a few landmark rows, whitened: columns → nys1..nysm."""

    inputCols = strings("inputCols", "columns replaced")
    keyCols = strings("keyCols", "row key used to draw the landmarks")
    landmarks = integer("landmarks", "number of landmark rows")
    gamma = number("gamma", "kernel width; default 1 / number of columns")
    seed = integer("seed", "seed of the draw")
    defaults = {"landmarks": 100, "seed": 42}

    def _fit(self, df: DataFrame) -> KernelFeaturesModel:
        cols = self["inputCols"]
        drawn = sample_exact(df, self["landmarks"], self["seed"], self["keyCols"])
        # At most ``landmarks`` rows reach the driver.
        points = np.array([[float(v or 0.0) for v in r] for r in drawn.select(*cols).collect()])
        gamma = self["gamma"] if self.has("gamma") else 1.0 / len(cols)
        u, s, vt = np.linalg.svd(_rbf(points, points, gamma))
        whiten = (u / np.sqrt(np.maximum(s, 1e-12))) @ vt
        return KernelFeaturesModel(inputCols=cols, gamma=gamma, points=[float(x) for x in points.ravel()],
                                   whiten=[float(x) for x in whiten.T.ravel()])


def _rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(d2, 0.0))


class KernelFeaturesModel(Keywords, Model, DefaultParamsReadable, DefaultParamsWritable):
    inputCols = strings("inputCols", "columns replaced")
    gamma = number("gamma", "kernel width")
    points = floats("points", "landmarks, row by row")
    whiten = floats("whiten", "whitening matrix")

    def _transform(self, df: DataFrame) -> DataFrame:
        cols, gamma = self["inputCols"], self["gamma"]
        points = np.array(self["points"]).reshape(-1, len(cols))
        m = len(points)
        whiten = np.array(self["whiten"]).reshape(m, m)

        @F.pandas_udf("array<double>")
        def kernel(*parts: pd.Series) -> pd.Series:
            x = np.column_stack([p.fillna(0.0).to_numpy(dtype=float) for p in parts])
            return pd.Series(list(_rbf(x, points, gamma) @ whiten))

        rest = [c for c in df.columns if c not in cols]
        mapped = df.withColumn("__k", kernel(*[F.col(c).cast("double") for c in cols]))
        return mapped.select(*rest, *[F.get("__k", F.lit(i)).alias(f"nys{i + 1}") for i in range(m)])


class PreviousDelay(Keywords, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fills the previous stop's delay with the training median, computing the lag if it is absent.

    Place it before a stage that drops the timestamp.
    """

    labelCol = string("labelCol", "delay column")
    tripCol = string("tripCol", "trip id")
    timeCol = string("timeCol", "timestamp")
    tieCols = strings("tieCols", "columns that order equal timestamps")
    outputCol = string("outputCol", "previous delay")
    dropInputs = boolean("dropInputs", "drop trip id and delay afterwards")
    defaults = {"labelCol": "arrival_delay_s", "tripCol": "trip_id", "timeCol": "timestamp", "tieCols": [],
                "outputCol": "prev_stop_delay", "dropInputs": True}

    def _fit(self, df: DataFrame) -> PreviousDelayModel:
        y = self["labelCol"]
        default = 0.0
        if y in df.columns:
            row = medians(df.select(y), [], [y]).first()
            default = float(row[0]) if row and row[0] is not None else 0.0
        keep = {p: self[p] for p in ("labelCol", "tripCol", "timeCol", "tieCols", "outputCol", "dropInputs")}
        return PreviousDelayModel(default=default, **keep)


class PreviousDelayModel(Keywords, Model, DefaultParamsReadable, DefaultParamsWritable):
    labelCol = string("labelCol", "delay column")
    tripCol = string("tripCol", "trip id")
    timeCol = string("timeCol", "timestamp")
    tieCols = strings("tieCols", "columns that order equal timestamps")
    outputCol = string("outputCol", "previous delay")
    dropInputs = boolean("dropInputs", "drop trip id and delay afterwards")
    default = number("default", "value where there is no previous stop")

    def _transform(self, df: DataFrame) -> DataFrame:
        y, trip, out = self["labelCol"], self["tripCol"], self["outputCol"]
        if y not in df.columns:
            return df
        if out not in df.columns and trip in df.columns:
            ts = self["timeCol"]
            dated = df.withColumn("__day", F.to_date(ts))
            lagged = previous_value(
                dated, ["__day", trip], [ts, *self["tieCols"]], y, out, chunk=F.hour(ts) * 60 + F.minute(ts)).drop("__day")
        elif out not in df.columns:
            lagged = df.withColumn(out, F.lit(None).cast("double"))
        else:
            lagged = df
        filled = lagged.withColumn(out, F.coalesce(F.col(out).cast("double"), F.lit(self["default"])).cast("float"))
        return filled.drop(trip, y) if self["dropInputs"] else filled


class DelayClass(Plain):
    """Delay → right-closed class number (the label of the class models)."""

    inputCol = string("inputCol", "delay in seconds")
    outputCol = string("outputCol", "class number as double")
    bins = floats("bins", "upper edges")
    defaults = {"inputCol": "arrival_delay_s", "outputCol": "label", "bins": [180.0]}

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self["outputCol"], delay_class(self["inputCol"], self["bins"]).cast("double"))

    @property
    def names(self) -> list[str]:
        return class_names(self["bins"])


class ClassToDelay(Plain):
    """Class number → the delay it stands for."""

    inputCol = string("inputCol", "class number")
    outputCol = string("outputCol", "delay in seconds")
    bins = floats("bins", "upper edges")
    defaults = {"inputCol": "prediction", "outputCol": "delay", "bins": [180.0]}

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self["outputCol"], pick(class_centres(self["bins"]), self["inputCol"]))
