"""Dimension joins.

No join here carries a broadcast hint: a dimension is broadcast when its measured size (scan
statistics, or the shuffle sizes adaptive execution sees) is below the session's threshold, and
joined by sort-merge with skew splitting beyond it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import col
from ..functions.conditions import peak_by_half_day, safe_id
from ..functions.timeparts import easter_sunday, service_date, utc_hour
from ..schema import WEATHER
from .nearest import nearest_box, nearest_point

# Search radii in metres.
ROAD_RADII = (500.0, 1000.0, 2000.0, 5000.0)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last in source order, as a dictionary built row by row would keep."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
        .select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])
    )


def lookup(
    fact: DataFrame, dim: DataFrame, on: Mapping[str, str], take: Mapping[str, str],
    default: Mapping[str, Column] | None = None, how: str = "left",
) -> DataFrame:
    """Add dimension columns. ``on`` maps fact to dimension keys, ``take`` dimension to new names."""
    slim = dim.select(*[F.col(d).alias(f"__k{i}") for i, d in enumerate(on.values())],
                      *[F.col(s).alias(n) for s, n in take.items()])
    cond = F.lit(True)
    for i, f in enumerate(on):
        cond = cond & (F.col(f) == F.col(f"__k{i}"))
    out = fact.join(slim, cond, how).drop(*[f"__k{i}" for i in range(len(on))])
    for name, value in (default or {}).items():
        out = out.withColumn(name, F.coalesce(F.col(name), value))
    return out


def unmatched(fact: DataFrame, dim: DataFrame, on: Mapping[str, str]) -> DataFrame:
    return _keyed(fact, dim, on, "left_anti")


def matched(fact: DataFrame, dim: DataFrame, on: Mapping[str, str]) -> DataFrame:
    return _keyed(fact, dim, on, "left_semi")


def _keyed(fact, dim, on, how):
    slim = dim.select(*[F.col(d).alias(f"__k{i}") for i, d in enumerate(on.values())])
    cond = F.lit(True)
    for i, f in enumerate(on):
        cond = cond & (F.col(f) == F.col(f"__k{i}"))
    return fact.join(slim, cond, how)


def in_region(fact: DataFrame, stops: DataFrame, municipalities: Sequence[str], stop_id: str = "stop_id") -> DataFrame:
    """Rows whose stop lies in one of the municipalities."""
    wanted = stops.filter(F.col("municipalityname").isin(list(municipalities)))
    return matched(fact, wanted.select(safe_id("number").alias("stop_id")), {stop_id: "stop_id"})


# --- public holidays --------------------------------------------------------------------------
# Fixed values: (name, month, day) or (name, days after Easter), and the cantons that observe it.
# Cantons that are not named for a rule do not observe it; "*" means all 26.
FIXED_DATE_RULES = [
    ("new_year", 1, 1, "*"),
    ("berchtold", 1, 2, "AG BE FR GL JU LU NE OW SH SO TG VD ZG ZH"),
    ("epiphany", 1, 6, "SZ TI UR"),
    ("republic_day", 3, 1, "NE"),
    ("saint_joseph", 3, 19, "NW SZ TI UR VS"),
    ("labour_day", 5, 1, "BL BS FR JU NE SH SO TG TI ZH"),
    ("independence_day", 6, 23, "JU"),
    ("peter_and_paul", 6, 29, "TI"),
    ("national_day", 8, 1, "*"),
    ("assumption", 8, 15, "AG AI FR JU LU NW OW SO SZ TI UR VS ZG"),
    ("brother_klaus", 9, 25, "OW"),
    ("all_saints", 11, 1, "AG AI FR GL JU LU NW OW SG SO SZ TI UR VS ZG"),
    ("immaculate", 12, 8, "AG AI FR LU NW OW SZ TI UR VS ZG"),
    ("christmas", 12, 25, "*"),
    ("stephen", 12, 26, "AG AI AR BE BL BS FR GL GR LU NW OW SG SH SO SZ TG TI UR ZG ZH"),
    ("restoration", 12, 31, "GE"),
]
EASTER_RULES = [
    ("easter_sunday", 0, "*"),
    ("whit_sunday", 49, "*"),
    ("good_friday", -2, "AG AI AR BE BL BS FR GE GL GR JU LU NE NW OW SG SH SO SZ TG UR VD ZG ZH"),
    ("easter_monday", 1, "AG AI AR BE BL BS FR GE GL GR JU LU NE NW OW SG SH SO SZ TG TI UR VD ZG ZH"),
    ("ascension", 39, "*"),
    ("whit_monday", 50, "AG AI AR BE BL BS FR GE GL GR JU LU NE NW OW SG SH SO SZ TG TI UR VD ZG ZH"),
    ("corpus_christi", 60, "AG AI FR JU LU NW OW SO SZ TI UR VS ZG"),
]
# (name, month, weekday, days after the first such weekday, cantons)
WEEKDAY_RULES = [
    ("fast_monday", 9, "SUN", 15, "VD"),
    ("geneva_fast", 9, "SUN", 4, "GE"),
]
CANTONS = "AG AI AR BE BL BS FR GE GL GR JU LU NE NW OW SG SH SO SZ TG TI UR VD VS ZG ZH"


def _first_weekday(year: Column, month: int, weekday: str) -> Column:
    return F.next_day(F.date_sub(F.make_date(year, F.lit(month), F.lit(1)), 1), weekday)


def holiday_dim(years: DataFrame, year: str = "year") -> DataFrame:
    """(date, canton, is_public_holiday) for every year in ``years`` from the rule tables."""
    def cantons(names: str) -> Column:
        return F.split(F.lit(CANTONS if names == "*" else names), " ")

    # Easter becomes a column first, so its arithmetic is not repeated in every rule.
    base = years.select(F.col(year).cast("int").alias("y")).withColumn("easter", easter_sunday("y"))
    y, sunday = F.col("y"), F.col("easter")
    dated = [
        F.struct(F.make_date(y, F.lit(m), F.lit(d)).alias("date"), cantons(c).alias("cantons"))
        for _, m, d, c in FIXED_DATE_RULES
    ] + [
        F.struct(F.date_add(sunday, offset).alias("date"), cantons(c).alias("cantons"))
        for _, offset, c in EASTER_RULES
    ] + [
        F.struct(F.date_add(_first_weekday(y, m, wd), offset).alias("date"), cantons(c).alias("cantons"))
        for _, m, wd, offset, c in WEEKDAY_RULES
    ]
    # Glarus: first Thursday of April, a week later when that is in Holy Week.
    april = _first_weekday(y, 4, "THU")
    moved = F.when(april == F.date_add(sunday, -3), F.date_add(april, 7)).otherwise(april)
    dated.append(F.struct(moved.alias("date"), cantons("GL").alias("cantons")))
    return (
        base.select(F.explode(F.array(*dated)).alias("r"))
        .select("r.date", F.explode("r.cantons").alias("canton"))
        .distinct().withColumn("is_public_holiday", F.lit(True))
    )


def add_holidays(
    fact: DataFrame, stop_canton: DataFrame, holidays: DataFrame, *, stop_id: str = "stop_id",
    day: Column | None = None, out: str = "is_public_holiday",
) -> DataFrame:
    """Flag rows whose stop's canton has a holiday on the row's day; no match gives False."""
    day = service_date("timestamp") if day is None else day
    with_canton = lookup(fact, stop_canton, {stop_id: "stop_id"}, {"canton": "__canton"}).withColumn("__day", day)
    flagged = lookup(
        with_canton, holidays, {"__canton": "canton", "__day": "date"}, {"is_public_holiday": out},
        default={out: F.lit(False)},
    )
    return flagged.drop("__canton", "__day")


# --- weather and roads --------------------------------------------------------------------------

def nearest_station(stops: DataFrame, stations: DataFrame) -> DataFrame:
    """(stop_id, weather_station): nearest in raw latitude/longitude, as the source measures it."""
    return nearest_point(
        stops, stations.dropna(subset=["lat", "lon"]), point_key="stop_id", x="lat", y="lon",
        target_key="station_id", tx="lat", ty="lon", out="weather_station",
    ).drop("d2")


def add_weather(
    fact: DataFrame, stop_station: DataFrame, weather: DataFrame, *, ts: str = "timestamp",
    zone: str = "Europe/Zurich", columns: Sequence[str] = tuple(WEATHER), required: bool = False,
) -> DataFrame:
    """Hourly weather of the stop's station at the row's UTC hour; ``required`` drops misses.

    Of repeated rows for a station and hour one whole row counts, the greatest by its columns in order (NULL lowest), so
    the fact never grows and no values of two rows are mixed.
    """
    one = F.max(F.struct(*columns)).alias("__row")
    weather = weather.groupBy("station_id", "timestamp").agg(one).select("station_id", "timestamp", "__row.*")
    keyed = lookup(fact, stop_station, {"stop_id": "stop_id"}, {"weather_station": "__station"})
    keyed = keyed.withColumn("__hour", utc_hour(ts, zone))
    out = lookup(
        keyed, weather, {"__station": "station_id", "__hour": "timestamp"}, {c: c for c in columns}
    ).drop("__station", "__hour")
    return out.filter(F.col(columns[0]).isNotNull()) if required else out


def nearest_road(stops: DataFrame, boxes: DataFrame, radii: Sequence[float] = ROAD_RADII) -> DataFrame:
    """(stop_id, road) by the widening-window rule; boxes must already carry their counts."""
    return nearest_box(
        stops, boxes, point_key="stop_id", x="east", y="north", box_key="id",
        bounds=("minx", "maxx", "miny", "maxy"), radii=radii, out="road",
    )


def add_traffic(fact: DataFrame, traffic: DataFrame, *, hour: Column, stop_id: str = "stop_id") -> DataFrame:
    """Inner join to the traffic map; the peak column follows the half of the day."""
    take = {c: c for c in traffic.columns if c != "stop_id"}
    out = lookup(fact, traffic, {stop_id: "stop_id"}, take, how="inner")
    return out.withColumn("traffic_peak", peak_by_half_day(hour, "traffic_msp", "traffic_asp")).drop(
        "traffic_msp", "traffic_asp")
