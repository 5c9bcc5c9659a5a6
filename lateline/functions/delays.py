"""Delay arithmetic, classes and severity wording."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import col
from .timeparts import seconds_of_day

HALF_DAY = 43200
DAY = 86400
# Accepted delay band in seconds.
BAND = (-120, 1800)
# Soft-class centres and widths for the four delay classes.
SOFT_CENTRES = (30.0, 90.0, 210.0, 420.0)
SOFT_WIDTHS = (30.0, 30.0, 90.0, 180.0)


def time_of_day_delay(scheduled, actual) -> Column:
    """Seconds from the scheduled minute to the observed second, wrapped to (-12 h, +12 h]."""
    scheduled, actual = col(scheduled), col(actual)
    planned = F.hour(scheduled) * 3600 + F.minute(scheduled) * 60
    gap = seconds_of_day(actual) - planned
    # One use of the gap: a filter on the delay is pushed below the projection, where every further
    # use would parse the texts again.
    return F.lit(HALF_DAY) - F.pmod(F.lit(HALF_DAY) - gap, F.lit(DAY))


def observed_only(time, status, accepted: Sequence[str] = ("REAL",)) -> Column:
    """The time where it was really observed, NULL where it is an estimate."""
    return F.when(col(status).isin(list(accepted)), col(time))


def in_band_or_null(*delays, low: int = BAND[0], high: int = BAND[1]) -> Column:
    """At least one delay present, and each present delay inside the band."""
    cols = [col(d) for d in delays]
    middle, half = (low + high) / 2, (high - low) / 2
    keep = F.coalesce(*cols).isNotNull()
    for c in cols:
        # Distance from the middle names the column once where two bounds would name it twice.
        keep = keep & F.coalesce(F.abs(c - F.lit(middle)) <= F.lit(half), F.lit(True))
    return keep


def both_at_least(*delays, low: int = BAND[0]) -> Column:
    """NULL-rejecting lower bound over all delays."""
    out = F.lit(True)
    for d in delays:
        out = out & (col(d) >= low)
    return out


def both_at_most(*delays, high: int = BAND[1]) -> Column:
    """NULL-rejecting upper bound over all delays."""
    out = F.lit(True)
    for d in delays:
        out = out & (col(d) <= high)
    return out


def delay_class(delay, bins: Sequence[float]) -> Column:
    """Right-closed bucket number: value on an edge belongs to the bucket below it."""
    delay = col(delay)
    total = F.lit(0)
    for edge in bins:
        total = total + (delay > F.lit(edge)).cast("int")
    return total


def class_names(bins: Sequence[float]) -> list[str]:
    middle = [f"{a:g}–{b:g}s" for a, b in zip(bins, bins[1:])]
    return [f"≤{bins[0]:g}s", *middle, f">{bins[-1]:g}s"]


def class_centres(bins: Sequence[float]) -> list[float]:
    """Value a class stands for: 30 below the first edge, midpoints, 50 above the last."""
    return [float(bins[0] - 30), *[(a + b) / 2 for a, b in zip(bins, bins[1:])], float(bins[-1] + 50)]


def pick(values: Sequence, index) -> Column:
    """Element of a literal list by zero-based index, NULL outside it."""
    return F.get(F.array(*[F.lit(v) for v in values]), col(index).cast("int"))


def class_name(cls, bins: Sequence[float]) -> Column:
    return pick(class_names(bins), cls)


def class_value(cls, bins: Sequence[float]) -> Column:
    return pick(class_centres(bins), cls)


def soft_classes(delay) -> list[Column]:
    """Normalised Gaussian weight of the delay around each class centre."""
    delay = col(delay)
    raw = [
        F.exp(-F.pow(delay - c, 2.0) / F.lit(2.0 * w * w)) for c, w in zip(SOFT_CENTRES, SOFT_WIDTHS)
    ]
    total = raw[0] + raw[1] + raw[2] + raw[3]
    return [r / total for r in raw]


def severity(delay) -> Column:
    """Name of a delay's size. The limits and names that the serving page shows."""
    delay = col(delay)
    return (
        F.when(delay <= 60, "On time").when(delay <= 120, "Slight delay")
        .when(delay <= 300, "Moderate delay").when(delay.isNotNull(), "Major delay")
    )


def likely_range(delay, spread: float = 64.0) -> tuple[Column, Column]:
    """Rounded lower and upper end of the band around a prediction; the lower end is never negative."""
    delay = col(delay)
    # Half rounds up, as the serving page does.
    low = F.floor(F.greatest(F.lit(0.0), delay - spread) + 0.5)
    return low.cast("bigint"), F.floor(delay + spread + 0.5).cast("bigint")


def absolute_gap_seconds(a, b) -> Column:
    """|a - b| in seconds for zone-less timestamps."""
    a, b = col(a), col(b)
    days = F.date_diff(F.to_date(b), F.to_date(a))
    return F.abs(days * DAY + seconds_of_day(b) - seconds_of_day(a))


def is_late(gap_seconds, threshold: int = 90) -> Column:
    return col(gap_seconds) >= threshold
