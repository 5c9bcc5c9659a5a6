"""From raw daily actuals to the enriched feature table, as one lazy plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import flag, heavy_share, guarded_ratio, safe_id, swiss_grid_to_wgs84
from ..functions.delays import in_band_or_null, observed_only, time_of_day_delay
from ..functions.timeparts import (
    day_of_week, parse_day, parse_local, text_minute_of_day, text_month, training_cycles,
)
from ..operators.joins import (
    add_holidays, add_weather, last_per_key, lookup, nearest_road, nearest_station,
)
from ..operators.rows import after_first_stop, conform, drop_flagged, keep_columns, only_product
from ..operators.windows import MEASURED, with_previous
from ..functions.conditions import peak_by_half_day, planar_distance
from ..schema import ACTUALS_COLUMNS, FULL, TRAFFIC_COUNTS


def clean(raw: DataFrame, product: str = "bus", drop=("CANCELLED", "PASS_THROUGH", "ADDITIONAL_TRIP")) -> DataFrame:
    """Translated raw rows → one product, wanted columns, no flagged rows.

    The looser variant of the source drops cancelled rows only: ``drop=("CANCELLED",)``.
    """
    return drop_flagged(keep_columns(only_product(raw, "PRODUCT_ID", product), ACTUALS_COLUMNS), *drop)


def _once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """``df`` with columns that are computed once per row: a later filter on them is pushed below a projection, where every use
    of a column is its whole expression again, but not below a generator."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def with_delays(df: DataFrame) -> DataFrame:
    """Parsed times, wrapped delays, and the band filter."""
    times = _once(df, {
        "arr_sched": parse_local("ARRIVAL_TIME"), "dep_sched": parse_local("DEPARTURE_TIME"),
        "arr_seen": parse_local(observed_only("ARRIVAL_FORECAST", "ARRIVAL_FORECAST_STATUS"), seconds=True),
        "dep_seen": parse_local(observed_only("DEPARTURE_FORECAST", "DEPARTURE_FORECAST_STATUS"), seconds=True),
    })
    delays = _once(times, {
        "arrival_delay_s": time_of_day_delay("arr_sched", "arr_seen"),
        "departure_delay_s": time_of_day_delay("dep_sched", "dep_seen"),
    })
    return delays.filter(in_band_or_null("arrival_delay_s", "departure_delay_s"))


def base_features(df: DataFrame) -> DataFrame:
    """Calendar encodings and typed identity columns."""
    day = parse_day("DATE")
    cycles = training_cycles(
        text_minute_of_day(F.coalesce("ARRIVAL_TIME", "DEPARTURE_TIME")), day_of_week(day), text_month("DATE"))
    return df.select(
        F.coalesce("arr_sched", "dep_sched").alias("timestamp"), day.alias("operating_day"),
        *[c.alias(n) for n, c in cycles.items()], (day_of_week(day) >= 5).alias("is_weekend"),
        F.col("OPERATOR_ABB").alias("operator"), F.col("LINE_NAME").alias("line"),
        safe_id("BPUIC").alias("stop_id"), F.col("STOP_NAME").alias("stop_name"),
        flag("ADDITIONAL_TRIP").alias("additional_trip"), flag("PASS_THROUGH").alias("pass_through"),
        "arrival_delay_s", "departure_delay_s", F.col("TRIP_ID").alias("trip_id"),
        F.coalesce("dep_sched", "arr_sched").alias("dep_order"),
    )


def stop_dim(stops: DataFrame, order: Sequence[str] = ("number", "lv95east", "lv95north")) -> DataFrame:
    """Typed stops, one per id, with WGS84 coordinates. The last row in ``order`` wins: name the source's own row numbers
    where it has them, since rows of a table have no order of their own."""
    lat, lon = swiss_grid_to_wgs84("lv95east", "lv95north")
    typed = stops.select(
        safe_id("number").alias("stop_id"), F.col("lv95east").alias("east"), F.col("lv95north").alias("north"),
        F.col("cantonabbreviation").alias("canton"), F.col("municipalityname").alias("municipality"),
        lat.alias("lat"), lon.alias("lon"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)],
    ).filter(F.col("stop_id").isNotNull())
    places = [f"__o{i}" for i in range(len(order))]
    return last_per_key(typed, ["stop_id"], places).drop(*places)


def with_trip(df: DataFrame, stops: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Previous delay, zero-based stop position and distance, then drop first stops and repeats.

    One window over (service date, trip) yields all three. Equal scheduled minutes are ordered by
    departure, then stop, so the result does not depend on file order.
    """
    located = lookup(df, stops, {"stop_id": "stop_id"}, {"east": "__e", "north": "__n"})
    keyed = located.withColumns({"service_date": F.to_date("timestamp"), "__id": F.xxhash64(
        "stop_id", "stop_name", "arrival_delay_s", "departure_delay_s", "operator", "line")})
    kw = {} if hot_rows is None else {"hot_rows": hot_rows}
    lagged = with_previous(
        keyed, ["service_date", "trip_id"], ["timestamp", "dep_order", "stop_id", "__id"],
        lags={"prev_stop_delay": "arrival_delay_s", "__pe": "__e", "__pn": "__n"},
        index="trip_stop_index", base=0,
        chunk=MEASURED, **kw,
    )
    out = lagged.withColumn("dist_to_prev_stop", planar_distance("__pe", "__pn", "__e", "__n").cast("float"))
    out = out.withColumn("trip_stop_index", F.col("trip_stop_index").cast("short"))
    return after_first_stop(out, "prev_stop_delay", "dist_to_prev_stop").drop(
        "__e", "__n", "__pe", "__pn", "__id", "dep_order")


def traffic_dim(stops: DataFrame, roads: DataFrame) -> DataFrame:
    """Stop → counts of its nearest road, with the two ratios."""
    near = nearest_road(stops.dropna(subset=["east", "north"]), roads)
    counts = {"dtv_fzg": "traffic_dtv", "dwv_fzg": "traffic_dwv", "msp_fzg": "traffic_msp", "asp_fzg": "traffic_asp",
              "dtv_pw": "traffic_pw", "dtv_lw": "traffic_lw", "dtv_lz": "traffic_lz", "dtv_li": "traffic_li"}
    t = lookup(near, roads, {"road": "id"}, counts, how="inner").drop("road", "d2")
    return t.withColumns({
        "traffic_heavy_share": heavy_share("traffic_lw", "traffic_lz", "traffic_dtv"),
        "traffic_peak_ratio": guarded_ratio("traffic_asp", "traffic_dtv"),
    })


def build_features(
    raw: DataFrame, stops: DataFrame, holidays: DataFrame | None = None, roads: DataFrame | None = None,
    stations: DataFrame | None = None, weather: DataFrame | None = None,
) -> DataFrame:
    """The whole build. Only the trip window shuffles the fact rows when dimensions are small."""
    dim = stop_dim(stops)
    out = with_trip(base_features(with_delays(clean(raw))), dim)
    if holidays is not None:
        out = add_holidays(out, dim.select("stop_id", "canton"), holidays, day=F.col("operating_day"))
    if roads is not None:
        t = traffic_dim(dim, roads)
        take = {c: c for c in ("traffic_dtv", "traffic_heavy_share", "traffic_peak_ratio", "traffic_msp", "traffic_asp", *TRAFFIC_COUNTS)}
        out = lookup(out, t, {"stop_id": "stop_id"}, take, how="inner")
        out = out.withColumn("traffic_peak", peak_by_half_day(F.hour("timestamp"), "traffic_msp", "traffic_asp"))
        out = out.drop("traffic_msp", "traffic_asp")
    if weather is not None and stations is not None:
        out = add_weather(out, nearest_station(dim, stations), weather, required=True)
    return out


def build_full_table(raw, stops, holidays, roads, stations, weather) -> DataFrame:
    """The whole build in its declared columns and types."""
    return conform(build_features(raw, stops, holidays, roads, stations, weather), FULL)
