"""Weather payloads: station features, hourly arrays and station CSV files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import col
from ..functions.conditions import kmh_to_ms, sunshine_fraction
from ..schema import HOURLY_NAMES, STATION_CODES, WEATHER
from .actuals import by_layout

_FEATURES = """struct<features: array<struct<
  id: string, geometry: struct<coordinates: array<double>>,
  properties: struct<title: string>, assets: map<string, struct<href: string>>>>>"""
# Asset names in order of preference.
ASSET_ORDER = ("historical", "smn", "data", "csv")


def stations_from_json(df: DataFrame, body: str, need_asset: bool = False) -> DataFrame:
    """One row per feature with at least two coordinates: id, name, lon, lat, alt, asset_url."""
    f = df.select(F.explode(F.from_json(body, _FEATURES)["features"]).alias("f")).select("f.*")
    xyz = F.col("geometry.coordinates")
    named = [F.when(F.map_contains_key("assets", k), F.col("assets")[k]["href"]) for k in ASSET_ORDER]
    chosen = F.coalesce(*[F.when(F.map_contains_key("assets", k), F.lit(k)) for k in ASSET_ORDER])
    any_csv = F.get(
        F.filter(F.transform(F.map_values("assets"), lambda a: a["href"]), lambda h: F.lower(h).endswith(".csv")), F.lit(0))
    # The first preferred asset decides, even if it has no link.
    url = F.when(chosen.isNotNull(), F.coalesce(*[F.when(chosen == k, n) for k, n in zip(ASSET_ORDER, named)]))
    out = f.select(
        F.col("id").alias("station_id"), F.coalesce("properties.title", "id").alias("name"),
        F.get(xyz, F.lit(0)).alias("lon"), F.get(xyz, F.lit(1)).alias("lat"), F.get(xyz, F.lit(2)).alias("alt"),
        F.coalesce(url, any_csv).alias("asset_url"), F.coalesce(F.size(xyz), F.lit(0)).alias("__n"),
    )
    wanted = F.col("asset_url").isNotNull() if need_asset else F.col("__n") >= 2
    return out.filter(wanted).drop("__n")


def hourly_rows(df: DataFrame, body: str, station_id: str, names: Mapping[str, str] = HOURLY_NAMES) -> DataFrame:
    """Parallel hourly arrays to rows; an absent variable gives NULLs, units are normalised."""
    fields = ", ".join(["time: array<string>"] + [f"{n}: array<double>" for n in names])
    h = df.select(F.col(station_id).alias("station_id"), F.from_json(body, f"struct<hourly: struct<{fields}>>")["hourly"].alias("h"))
    rows = h.select("station_id", "h", F.posexplode("h.time").alias("i", "t"))
    at = {new: F.get(F.col(f"h.{old}"), F.col("i")) for old, new in names.items()}
    at["sunshine"] = sunshine_fraction(at["sunshine"])
    at["wind_speed"] = kmh_to_ms(at["wind_speed"])
    at["wind_gust"] = kmh_to_ms(at["wind_gust"])
    return rows.select("station_id", iso_minute(F.col("t")).alias("timestamp"),
                       *[at[c].cast("float").alias(c) for c in WEATHER])


def iso_minute(text) -> Column:
    """ISO date-time text to a zone-less timestamp, NULL if unreadable."""
    return F.replace(col(text), F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz")


# Markers of a missing reading, and header names of the time column.
MISSING = ("-", "–", "", "NA", "na")
TIME_HEADERS = ("time", "date", "datum", "datetime", "reference_timestamp")


def station_time(text) -> Column:
    """Four layouts: yyyyMMddHHmm, dd.MM.yyyy HH:mm, ISO, and whatever a plain cast reads."""
    t = col(text)
    part = lambda start, n: F.substring(t, start, n).try_cast("int")
    zero = F.lit(0).cast("decimal(16,6)")
    packed = F.try_make_timestamp_ntz(part(1, 4), part(5, 2), part(7, 2), part(9, 2),
                                      F.coalesce(part(11, 2), F.lit(0)), zero)
    dotted = F.try_make_timestamp_ntz(part(7, 4), part(4, 2), part(1, 2), part(12, 2), part(15, 2), zero)
    return (
        F.when(t.rlike(r"^\d{10}(\d{2})?$"), packed).when(t.rlike(r"^\d{2}\.\d{2}\.\d{4} \d{2}:\d{2}"), dotted)
        .otherwise(iso_minute(t))
    )


def read_station_csv(spark: SparkSession, path: str, year: int | None = None) -> DataFrame:
    """Station files to hourly rows; unknown codes are dropped, absent ones become NULL columns.

    Files are read per header layout, so cells follow their own file's header, and so does the choice of the time column.
    """
    parts = [_station_rows(raw) for raw in by_layout(spark, path)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out if year is None else out.filter(F.year("timestamp") == year)


def _station_rows(raw: DataFrame) -> DataFrame:
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    known = [c for c in raw.columns if c in TIME_HEADERS]
    if known:
        time = known[0]
    else:
        # First column whose first value looks like a packed time: one row is enough to see it.
        sample = raw.agg(*[F.first(c, ignorenulls=True).alias(c) for c in raw.columns]).first()
        found = [c for c in raw.columns if sample[c] and len(sample[c]) >= 8 and sample[c][:8].isdigit()]
        if not found:
            raise ValueError(f"no time column among {raw.columns}")
        time = found[0]
    clean = raw.withColumns({c: F.when(~F.col(c).isin(*MISSING), F.col(c)) for c in raw.columns})
    station = F.col(raw.columns[0]) if raw.columns[0] in ("stn", "station", "station_id") else F.regexp_extract(
        F.input_file_name(), r"([^/]+)\.csv$", 1)
    return clean.select(
        station.alias("station_id"), station_time(F.col(time)).alias("timestamp"),
        *[(F.col(code).try_cast("float") if code in clean.columns else F.lit(None).cast("float")).alias(name)
          for code, name in STATION_CODES.items()],
    )
