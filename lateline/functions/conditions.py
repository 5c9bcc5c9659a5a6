"""Weather, traffic and geometry expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import col
from ..schema import DEFAULT_WIND, SERVING_DEFAULTS


def direction_parts(degrees) -> tuple[Column, Column]:
    angle = F.radians(col(degrees))
    return F.sin(angle), F.cos(angle)


def mean_of_two(a, b) -> Column:
    return (col(a) + col(b)) / 2


def wind_chill(temperature, wind_speed) -> Column:
    return col(temperature) - F.lit(0.7) * col(wind_speed)


def is_adverse(precipitation, snow_depth) -> Column:
    """Rain above 1 mm or any snow; an unknown value does not count as adverse."""
    wet = F.coalesce(col(precipitation) > 1.0, F.lit(False))
    return wet | F.coalesce(col(snow_depth) > 0, F.lit(False))


def is_rush_hour(hour) -> Column:
    hour = col(hour)
    return hour.between(7, 9) | hour.between(16, 19)


def guarded_ratio(part, whole) -> Column:
    """part / whole, and 0 where the whole is not positive."""
    whole = col(whole)
    return F.when(whole > 0, col(part) / whole).otherwise(F.lit(0.0))


def heavy_share(trucks, articulated, all_vehicles) -> Column:
    return guarded_ratio(col(trucks) + col(articulated), all_vehicles)


def peak_by_half_day(hour, morning, evening) -> Column:
    return F.when(col(hour) < 12, col(morning)).otherwise(col(evening))


def planar_distance(x0, y0, x1, y1) -> Column:
    dx, dy = col(x1) - col(x0), col(y1) - col(y0)
    return F.sqrt(dx * dx + dy * dy)


def swiss_grid_to_wgs84(east, north) -> tuple[Column, Column]:
    """(lat, lon) from the projected national grid by the published approximation polynomial.

    Accuracy is about a metre, far below the spacing of weather stations.
    """
    y = (col(east) - 2600000.0) / 1000000.0
    x = (col(north) - 1200000.0) / 1000000.0
    # Coefficients of the published approximation formulas.
    lon = 2.6779094 + 4.728982 * y + 0.791484 * y * x + 0.1306 * y * x * x - 0.0436 * y * y * y
    lat = (
        16.9023892 + 3.238272 * x - 0.270978 * y * y - 0.002528 * x * x
        - 0.0447 * y * y * x - 0.0140 * x * x * x
    )
    return lat * 100.0 / 36.0, lon * 100.0 / 36.0


def sunshine_fraction(seconds_per_hour) -> Column:
    return col(seconds_per_hour) / 3600.0


def kmh_to_ms(speed) -> Column:
    return col(speed) / 3.6


def serving_value(name: str) -> Column:
    """Input value at scoring time, or the published default where it is missing."""
    return F.coalesce(F.col(name), F.lit(SERVING_DEFAULTS[name]))


def serving_wind(speed, gust) -> Column:
    """Mean wind; a missing gust falls back to the speed, a missing speed to the default."""
    speed, gust = col(speed), col(gust)
    return (
        F.coalesce(speed, F.lit(DEFAULT_WIND)) + F.coalesce(gust, speed, F.lit(DEFAULT_WIND))
    ) / 2


def safe_id(text, kind: str = "int") -> Column:
    """Integer id from text; unreadable gives NULL."""
    return F.trim(col(text)).try_cast(kind)


def flag(value, kind: str | None = None) -> Column:
    """Boolean from boolean, number or text; NULL gives False. ``kind`` is the Spark type name."""
    value = col(value)
    if kind == "boolean":
        return F.coalesce(value, F.lit(False))
    if kind is not None and kind != "string":
        return F.coalesce(value != 0, F.lit(False))
    return F.coalesce(F.lower(value.cast("string")).isin("true", "1"), F.lit(False))


def shifted_log(value, offset) -> Column:
    return F.log(col(value) + F.lit(offset))


def shifted_exp(value, offset) -> Column:
    return F.exp(col(value)) - F.lit(offset)
