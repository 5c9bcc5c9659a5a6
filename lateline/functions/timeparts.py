"""Time parsing, calendar parts and cyclic encodings.

All functions work on zone-less timestamps and give the same answer under any session zone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import col

TAU = 2 * math.pi


def _digits(text: Column, start: int, length: int) -> Column:
    return F.substring(text, start, length).try_cast("int")


def parse_local(text, seconds: bool = False) -> Column:
    """``dd.MM.yyyy HH:mm[:ss]`` to a zone-less timestamp; anything else gives NULL."""
    text = col(text)
    shape = r"^\d{2}\.\d{2}\.\d{4} \d{2}:\d{2}" + (r":\d{2}$" if seconds else "$")
    second = _digits(text, 18, 2) if seconds else F.lit(0)
    parsed = F.try_make_timestamp_ntz(
        _digits(text, 7, 4), _digits(text, 4, 2), _digits(text, 1, 2),
        _digits(text, 12, 2), _digits(text, 15, 2), second.cast("decimal(16,6)"),
    )
    return F.when(text.rlike(shape), parsed)


def parse_day(text) -> Column:
    """``dd.MM.yyyy`` to a date; anything else gives NULL."""
    text = col(text)
    parsed = F.try_make_timestamp_ntz(
        _digits(text, 7, 4), _digits(text, 4, 2), _digits(text, 1, 2),
        F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"),
    )
    return F.when(text.rlike(r"^\d{2}\.\d{2}\.\d{4}$"), F.to_date(parsed))


def text_hour(text) -> Column:
    return F.coalesce(_digits(col(text), 12, 2), F.lit(0))


def text_minute_of_day(text) -> Column:
    """Minute of day straight from the text; unreadable hour or minute counts as 0."""
    return text_hour(text) * 60 + F.coalesce(_digits(col(text), 15, 2), F.lit(0))


def text_month(text) -> Column:
    """Month from ``dd.MM.yyyy`` text; unreadable gives 1."""
    return F.coalesce(_digits(col(text), 4, 2), F.lit(1))


def day_of_week(day) -> Column:
    """0 = Monday … 6 = Sunday; NULL day gives 0."""
    return F.coalesce(F.weekday(col(day)), F.lit(0))


def is_weekend(day) -> Column:
    return day_of_week(day) >= 5


def cyclic(value, period: float) -> tuple[Column, Column]:
    """(sin, cos) of a position on a circle, computed in double and stored as float."""
    angle = F.lit(TAU) * col(value).cast("double") / F.lit(float(period))
    return F.sin(angle).cast("float"), F.cos(angle).cast("float")


def training_cycles(minute_of_day, dow, month) -> dict[str, Column]:
    """Encoding used when the feature table is built: 1440 minutes, 7 days, 12 months."""
    out = {}
    for name, value, period in (("time", minute_of_day, 1440), ("dow", dow, 7), ("month", month, 12)):
        out[f"{name}_sin"], out[f"{name}_cos"] = cyclic(value, period)
    return out


def serving_cycles(ts) -> dict[str, Column]:
    """Encoding used at scoring time: whole hours, and months counted from zero."""
    ts = col(ts)
    parts = (("time", F.hour(ts), 24), ("dow", F.weekday(ts), 7), ("month", F.month(ts) - 1, 12))
    out = {}
    for name, value, period in parts:
        out[f"{name}_sin"], out[f"{name}_cos"] = cyclic(value, period)
    return out


def weekday_from_cycle(sin, cos) -> Column:
    """Inverse of the weekday encoding."""
    turns = F.round(F.atan2(col(sin), col(cos)) * 7.0 / F.lit(TAU))
    return F.pmod(turns.cast("int"), F.lit(7))


def hour_floor(ts) -> Column:
    """Start of the hour, staying zone-less."""
    ts = col(ts)
    return F.to_date(ts).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour(ts))


def utc_hour(ts, zone: str = "Europe/Zurich") -> Column:
    """Local wall time to the UTC hour that contains it.

    A wall time that occurs twice (clocks set back) means its second occurrence.
    """
    # Seconds since the epoch as if the wall clock were UTC. Offsets are whole minutes, so minutes
    # are enough, and these conversions resolve the zone once instead of once per row.
    ts = col(ts)
    epoch = F.lit("1970-01-01").cast("date")
    wall = (F.date_diff(F.to_date(ts), epoch).cast("bigint") * 1440 + F.hour(ts) * 60 + F.minute(ts)) * 60
    first = F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(wall), F.lit(zone)))
    second = first + 3600
    repeats = F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(second), F.lit(zone))) == wall
    hours = F.floor(F.when(repeats, second).otherwise(first) / 3600).cast("int")
    day = F.date_add(epoch, F.floor(hours / 24).cast("int"))
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.pmod(hours, F.lit(24)))


def service_date(ts) -> Column:
    return F.to_date(col(ts))


def fractional_hour(ts) -> Column:
    ts = col(ts)
    return F.hour(ts) + F.minute(ts) / F.lit(60.0)


def seconds_of_day(ts) -> Column:
    ts = col(ts)
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def easter_sunday(year) -> Column:
    """Western Easter by the anonymous Gregorian computus, as integer column arithmetic."""
    y = col(year).cast("int")
    a = F.pmod(y, F.lit(19))
    b = F.floor(y / 100)
    c = F.pmod(y, F.lit(100))
    g = F.floor((b * 8 + 13) / 25)
    h = F.pmod(a * 19 + b - F.floor(b / 4) - g + 15, F.lit(30))
    shift = F.floor((a + h * 11) / 319)
    r = F.pmod(F.pmod(b, F.lit(4)) * 2 + F.floor(c / 4) * 2 - F.pmod(c, F.lit(4)) - h + shift + 32, F.lit(7))
    month = F.floor((h - shift + r + 90) / 25)
    day = F.pmod(h - shift + r + month + 19, F.lit(32))
    return F.make_date(y, month.cast("int"), day.cast("int"))
