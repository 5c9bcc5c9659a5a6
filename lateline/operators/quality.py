"""Data-quality rules over a feature table.

Every rule contributes aggregate expressions; all rules are evaluated in one pass over the table
(plus two small distributions) and come back as one report: name, status, detail.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timeparts import weekday_from_cycle
from ..schema import CYCLIC, TRAFFIC, WEATHER

PASS, WARN, FAIL, SKIP = "PASS", "WARN", "FAIL", "SKIP"


@dataclass
class Rule:
    """``measure`` is an aggregate; the rule passes if ``ok(measure)``. ``soft`` gives WARN."""

    name: str
    measure: Column | None
    ok: object = None
    soft: object = False  # bool, or a function of the measure
    needs: tuple[str, ...] = ()
    skip_reason: str = ""
    groups: dict = field(default_factory=dict)


# --- fixed values: limits of the published checks ------------------------------------------------
REQUIRED = [
    "timestamp", *CYCLIC, "is_weekend", "operator", "line", "stop_id", "stop_name", "additional_trip",
    "arrival_delay_s", "departure_delay_s", "is_public_holiday",
]
TRIP_COLUMNS = ["prev_stop_delay", "dist_to_prev_stop", "trip_stop_index"]
NEVER_NULL = [
    *CYCLIC, "is_weekend", "operator", "line", "stop_id", "additional_trip", "is_public_holiday",
]
NULL_LIMITS = {  # column: (pass below, warn below), in percent
    "arrival_delay_s": (60, 80), "departure_delay_s": (60, 80),
    "temperature": (25, 50), "precipitation": (25, 50), "humidity": (25, 50),
    "wind_speed": (25, 50), "pressure": (25, 50),
    "prev_stop_delay": (50, 101), "dist_to_prev_stop": (95, 101),
}
WEATHER_BOUNDS = {  # column: (low, high, warn only)
    "temperature": (-50, 60, False), "precipitation": (0, 300, False), "sunshine": (0, 1.1, False),
    "humidity": (0, 101, False), "wind_speed": (0, 85, False), "wind_gust": (0, 112, False),
    "wind_dir": (0, 361, False), "pressure": (550, 1050, False), "snow_depth": (0, 10, True),
}
HALF_DAY_COLUMNS = ["arrival_delay_s", "departure_delay_s", "prev_stop_delay"]


def percent(condition: Column) -> Column:
    return F.count_if(condition) * 100.0 / F.count(F.lit(1))


def outside(column: str, low, high) -> Column:
    return F.count_if((F.col(column) < F.lit(low)) | (F.col(column) > F.lit(high)))


def _zero(m: Column) -> Column:
    return m == 0


def column_rules(columns: Sequence[str]) -> list[Rule]:
    """Presence of the required columns, and of each optional group that has begun to exist."""
    have = set(columns)
    out = []
    for title, needed, marker in (
        ("all required columns present", REQUIRED, None),
        ("all weather columns present", WEATHER, "temperature"),
        ("all traffic columns present", TRAFFIC, "traffic_dtv"),
        ("all trip columns present", TRIP_COLUMNS, "prev_stop_delay"),
    ):
        if marker and marker not in have:
            out.append(Rule(title, None, skip_reason=f"no {marker} column"))
        else:
            out.append(Rule(title, F.lit(len(set(needed) - have)), _zero))
    return out


def completeness_rules() -> list[Rule]:
    both_null = F.count_if(F.col("arrival_delay_s").isNull() & F.col("departure_delay_s").isNull())
    two = ("arrival_delay_s", "departure_delay_s")
    out = [Rule(f"no null in {c}", F.count_if(F.col(c).isNull()), _zero, needs=(c,))
           for c in [*NEVER_NULL, "trip_stop_index"]]
    out.append(Rule("every row has a delay", both_null, _zero, needs=two))
    for c, (limit, warn) in NULL_LIMITS.items():
        out.append(Rule(f"{c} null rate < {limit}%", percent(F.col(c).isNull()),
                        lambda m, x=limit: m < x, soft=lambda m, x=warn: m < x, needs=(c,)))
    for c in TRAFFIC:
        out.append(Rule(f"null rate of {c} is 0", percent(F.col(c).isNull()), _zero,
                        soft=lambda m: m < 5, needs=(c,)))
    return out


def range_rules(year: int | None = None) -> list[Rule]:
    out = [
        Rule(f"{c} in [-1, 1]",
             F.when((F.min(c) >= -1.01) & (F.max(c) <= 1.01), F.lit(0)).otherwise(F.lit(1)), _zero, needs=(c,))
        for c in CYCLIC
    ]
    if year is not None:
        out.append(Rule(f"rows outside {year} < 0.1%", percent(F.year("timestamp") != year),
                        lambda m: m < 0.1, soft=True, needs=("timestamp",)))
    out.append(Rule("stop_id > 0", F.count_if(F.col("stop_id") <= 0), _zero, needs=("stop_id",)))
    for c in HALF_DAY_COLUMNS:
        out.append(Rule(f"{c} within 12 h", outside(c, -43200, 43200), _zero, needs=(c,)))
    for c, (low, high, soft) in WEATHER_BOUNDS.items():
        out.append(Rule(f"{c} in [{low}, {high}]", outside(c, low, high), _zero, soft=soft, needs=(c,)))
    out.append(Rule("dist_to_prev_stop in [0, 100000]", outside("dist_to_prev_stop", 0, 100000), _zero,
                    needs=("dist_to_prev_stop",)))
    out.append(Rule("trip_stop_index in [0, 500)",
                    F.count_if((F.col("trip_stop_index") < 0) | (F.col("trip_stop_index") >= 500)), _zero,
                    needs=("trip_stop_index",)))
    for c in ("traffic_dtv", "traffic_peak"):
        out.append(Rule(f"{c} >= 0", F.count_if(F.col(c) < 0), _zero, needs=(c,)))
        out.append(Rule(f"{c} is not zero", F.count_if(F.col(c) == 0), _zero, soft=True, needs=(c,)))
    out.append(Rule("traffic_heavy_share in [0, 1]", outside("traffic_heavy_share", 0, 1), _zero,
                    needs=("traffic_heavy_share",)))
    out.append(Rule("traffic_peak_ratio in [0, 2]", outside("traffic_peak_ratio", 0, 2), _zero, soft=True,
                    needs=("traffic_peak_ratio",)))
    return out


def distribution_rules() -> list[Rule]:
    def share(flag: str) -> Column:
        return F.avg(F.col(flag).cast("double")) * 100

    months = {m: percent(F.month("timestamp") == m) for m in range(1, 13)}
    hours = {h: percent(F.hour("timestamp") == h) for h in range(24)}

    def worst(parts: dict, bad) -> Column:
        total = F.lit(0)
        for v in parts.values():
            total = total + F.when((v > 0) & bad(v), 1).otherwise(0)
        return total

    late = (F.col("departure_delay_s") > 10800) | (F.col("arrival_delay_s") > 10800)
    return [
        Rule("weekend share 15-35%", share("is_weekend"), lambda m: m.between(15, 35), needs=("is_weekend",)),
        Rule("each month has 4-15% of rows", worst(months, lambda v: ~v.between(4, 15)), _zero, needs=("timestamp",)),
        Rule("no hour above 15% of rows", worst(hours, lambda v: v > 15), _zero, needs=("timestamp",)),
        Rule("no hour below 0.5% of rows", worst(hours, lambda v: v < 0.5), _zero, soft=True, needs=("timestamp",)),
        Rule("delays above 3 h < 1%", percent(F.coalesce(late, F.lit(False))), lambda m: m < 1, soft=True,
             needs=("arrival_delay_s", "departure_delay_s")),
        Rule("additional trips < 20%", share("additional_trip"), lambda m: m < 20, needs=("additional_trip",)),
    ]


def consistency_rules() -> list[Rule]:
    wrong = F.col("is_weekend") != (weekday_from_cycle("dow_sin", "dow_cos") >= 5)
    both_null = F.col("arrival_delay_s").isNull() & F.col("departure_delay_s").isNull()
    return [
        Rule("is_weekend agrees with the encoded weekday", F.count_if(wrong), _zero,
             needs=("is_weekend", "dow_sin", "dow_cos")),
        Rule("no row with both delays null", F.count_if(both_null), _zero,
             needs=("arrival_delay_s", "departure_delay_s")),
    ]


def weather_join_rules() -> list[Rule]:
    hit = percent(F.col("temperature").isNotNull())
    t = ("temperature",)
    return [
        Rule("weather hit rate > 80%", hit, lambda m: m > 80, needs=t),
        Rule("weather row coverage > 95%", hit, lambda m: m > 95, needs=t),
        Rule("temperature std > 1", F.stddev_samp("temperature"), lambda m: m > 1, needs=t),
    ]


def traffic_join_rules() -> list[Rule]:
    return [
        Rule("traffic hit rate = 100%", percent(F.col("traffic_dtv").isNotNull()), lambda m: m == 100, needs=("traffic_dtv",)),
        Rule("traffic_dtv std > 100", F.stddev_samp("traffic_dtv"), lambda m: m > 100, needs=("traffic_dtv",)),
        Rule("traffic_heavy_share mean > 0.01", F.avg("traffic_heavy_share"), lambda m: m > 0.01, soft=True,
             needs=("traffic_heavy_share",)),
        Rule("traffic_peak_ratio zero share < 10%", percent(F.col("traffic_peak_ratio") == 0), lambda m: m < 10,
             needs=("traffic_peak_ratio",)),
        Rule("more than 2000 distinct traffic_dtv", F.count_distinct("traffic_dtv"), lambda m: m > 2000,
             needs=("traffic_dtv",)),
    ]


def build_rules() -> list[Rule]:
    """Smoke rules of the dataset build itself."""
    return [
        Rule("lag inside the accepted band", outside("prev_stop_delay", -120, 1800), _zero, needs=("prev_stop_delay",)),
        Rule("stop index is not negative", F.count_if(F.col("trip_stop_index") < 0), _zero, needs=("trip_stop_index",)),
        Rule("distance is never zero", F.count_if(F.col("dist_to_prev_stop") == 0), _zero, needs=("dist_to_prev_stop",)),
        Rule("traffic null rate < 5%", percent(F.col("traffic_dtv").isNull()), lambda m: m < 5, needs=("traffic_dtv",)),
    ]


def all_rules(columns: Sequence[str], year: int | None = None) -> list[Rule]:
    return [
        *column_rules(columns), *completeness_rules(), *range_rules(year), *distribution_rules(),
        *consistency_rules(), *weather_join_rules(), *traffic_join_rules(),
    ]


def validate(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(name, status, measure) for every rule, from a single aggregate row."""
    have = set(df.columns)
    measured, report = [], []
    for i, r in enumerate(rules):
        if r.measure is None or not set(r.needs) <= have:
            reason = r.skip_reason or "column absent"
            report.append(F.struct(F.lit(i).alias("i"), F.lit(r.name).alias("name"), F.lit(SKIP).alias("status"),
                                   F.lit(None).cast("double").alias("measure"), F.lit(reason).alias("detail")))
            continue
        measured.append(r.measure.cast("double").alias(f"m{i}"))
        m = F.col(f"m{i}")
        passed = F.coalesce(r.ok(m), F.lit(False))
        soft = r.soft(m) if callable(r.soft) else F.lit(bool(r.soft))
        status = F.when(passed, PASS).when(F.coalesce(soft, F.lit(False)), WARN).otherwise(FAIL)
        report.append(F.struct(F.lit(i).alias("i"), F.lit(r.name).alias("name"), status.alias("status"),
                               m.alias("measure"), F.lit("").alias("detail")))
    one = df.agg(F.count(F.lit(1)).alias("__n"), *measured)
    return one.select(F.inline(F.array(*report))).drop("i")


def status_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def has_failures(report: DataFrame) -> bool:
    """True if any rule failed: what a job turns into a non-zero exit code."""
    return not report.filter(F.col("status") == FAIL).isEmpty()
