"""Projections, filters and imputation."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import col
from ..functions.conditions import flag
from ..functions.delays import BAND, both_at_least, both_at_most, in_band_or_null


def rename_known(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename the columns that exist; the rest of the map is ignored."""
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def missing_columns(df: DataFrame, needed: Iterable[str]) -> list[str]:
    return sorted(set(needed) - set(df.columns))


def keep_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = missing_columns(df, names)
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*names)


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.drop(*[n for n in names if n in df.columns])


def only_product(df: DataFrame, column: str, product: str = "bus") -> DataFrame:
    return df.filter(F.lower(F.col(column)) == product.lower())


def drop_flagged(df: DataFrame, *columns: str) -> DataFrame:
    """Drop rows where any of the flag columns is set."""
    kinds = dict(df.dtypes)
    out = df
    for name in columns:
        out = out.filter(~flag(name, kinds[name]))
    return out


def keep_in_band(df: DataFrame, *delays: str, low: int = BAND[0], high: int = BAND[1]) -> DataFrame:
    return df.filter(in_band_or_null(*delays, low=low, high=high))


def drop_early(df: DataFrame, *delays: str, low: int = BAND[0]) -> DataFrame:
    return df.filter(both_at_least(*delays, low=low))


def drop_late(df: DataFrame, *delays: str, high: int = BAND[1]) -> DataFrame:
    return df.filter(both_at_most(*delays, high=high))


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(how="any", subset=[c for c in columns if c in df.columns])


def fill_constant(df: DataFrame, values: Mapping[str, float]) -> DataFrame:
    known = {k: v for k, v in values.items() if k in df.columns}
    return df.fillna(known) if known else df


def equals_all(df: DataFrame, **wanted) -> DataFrame:
    out = df
    for name, value in wanted.items():
        out = out.filter(F.col(name) == F.lit(value))
    return out


def after_first_stop(df: DataFrame, lag: str, distance: str) -> DataFrame:
    """Drop each trip's first row and repeated stops; an unknown distance is kept."""
    return df.filter(F.col(lag).isNotNull() & (F.coalesce(F.col(distance), F.lit(-1.0)) != 0.0))


def positive_distance(df: DataFrame, distance: str) -> DataFrame:
    """The stricter form: the distance must be known and above zero."""
    return df.filter(F.col(distance) > 0)


def text_matches(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.filter(F.col(column).rlike(pattern))


def cap(df: DataFrame, column: str, high: float) -> DataFrame:
    return df.filter(F.col(column) <= F.lit(high))


def numeric_matrix(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Columns as double with NULL (and NaN) as 0."""
    return df.select(
        *keep, *[F.coalesce(F.nanvl(col(c).cast("double"), F.lit(None)), F.lit(0.0)).alias(c) for c in columns]
    )


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating columns never carry NaN past ingest."""
    fixed = {
        n: F.when(~F.isnan(F.col(n)), F.col(n)) for n, t in df.dtypes if t in ("float", "double")
    }
    return df.withColumns(fixed) if fixed else df


def conform(df: DataFrame, schema) -> DataFrame:
    """Cast to a declared schema, in its column order, for the columns that are present."""
    have = set(df.columns)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields if f.name in have])
