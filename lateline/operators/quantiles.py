"""Exact quantiles by repeated selection: no task ever orders more than a stated number of rows.

Spark's exact ``percentile`` keeps every distinct value of a group in one aggregation buffer. Here a sketch brackets the
ranks asked for; as long as a bracket may hold more than ``limit`` rows, its rows are sketched again and the bracket moves to the
counted borders around the rank. What lies strictly inside the last brackets is ranked; what lies below or on a border is
only counted, so values that repeat a billion times cost a counter. The sketches decide how often the rows are read, never the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint

SMALL_GROUP = 20_000      # rows that one task may put in order
MARGIN = 1.0 / 2000       # half width of the first bracket, in ranks
ACCURACY = 10_000         # a sketch's ranks are off by this part of its rows at most
GRID = 64                 # borders a repeated sketch offers
ROUNDS = 20
FEW_GROUPS = 10_000       # brackets sent to the rows; with more the rows go to them


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], out: Sequence[str],
    small_group: int = SMALL_GROUP,
) -> DataFrame:
    """One row per key with the linearly interpolated quantiles of ``value`` (NULLs ignored)."""
    return column_quantiles(
        df, keys, {o: (value, p) for o, p in zip(out, probs)}, small_group=small_group
    )


def medians(df: DataFrame, keys: Sequence[str], columns: Sequence[str], **kw) -> DataFrame:
    return column_quantiles(df, keys, {c: (c, 0.5) for c in columns}, **kw)


class _Requests:
    """Quantiles asked for: request i takes column ``source[i]`` at probability ``prob[i]``; a column's requests rise."""

    def __init__(self, wanted: dict[str, tuple[str, float]]):
        self.columns = sorted({c for c, _ in wanted.values()})
        asked = sorted((self.columns.index(c), p, n) for n, (c, p) in wanted.items())
        self.source = [s for s, _, _ in asked]
        self.prob = [float(p) for _, p, _ in asked]
        self.name = [n for _, _, n in asked]

    def of(self, s: int) -> list[int]:
        return [i for i, x in enumerate(self.source) if x == s]

    def __len__(self):
        return len(self.name)


def _null_safe(names: Sequence[str]):
    cond = F.lit(True)
    for g in names:
        cond = cond & F.col(g).eqNullSafe(F.col(f"__r{g}"))
    return cond


def column_quantiles(
    df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, float]],
    small_group: int = SMALL_GROUP,
) -> DataFrame:
    """Several quantiles of several columns at once: ``{output: (column, probability)}``."""
    asked = _Requests(wanted)
    groups = [f"__g{i}" for i in range(len(keys))]
    slim = df.select(*[F.col(k).alias(g) for k, g in zip(keys, groups)],
                     *[F.col(c).cast("double").alias(f"__c{s}") for s, c in enumerate(asked.columns)])
    brackets = checkpoint(_first_brackets(slim, groups, asked, small_group))
    for _ in range(ROUNDS):
        if not _crowded(brackets, asked, small_group):
            break
        brackets = checkpoint(_narrowed(slim, brackets, groups, asked))
    picked = _ranked(slim, brackets, groups, asked)
    out = picked.groupBy(*groups).agg(*[F.max(F.when(F.col("__q") == i, F.col("__p"))).alias(n) for i, n in enumerate(asked.name)])
    # A group without any value has no ranks, but a row.
    whole = brackets.select(*[F.col(g).alias(f"__r{g}") for g in groups]).join(out, _null_safe(groups), "left") if groups else out
    return whole.select(*[F.col(f"__r{g}").alias(k) for g, k in zip(groups, keys)], *[F.col(n) for n in wanted])


def _first_brackets(slim: DataFrame, groups: list[str], asked: _Requests, limit: int) -> DataFrame:
    """Per group and request: rows, the borders and at most how many rows lie strictly between them."""
    margin = max(MARGIN, 4.0 / limit)
    stats = []
    for s in range(len(asked.columns)):
        c = f"__c{s}"
        points = sorted({x for i in asked.of(s) for x in (asked.prob[i] - margin, asked.prob[i] + margin) if 0 < x < 1})
        stats += [F.count(c).alias(f"n{s}"), F.min(c).alias(f"a{s}"), F.max(c).alias(f"b{s}")]
        if points:
            stats.append(F.approx_percentile(c, F.array(*[F.lit(x) for x in points]), F.lit(ACCURACY)).alias(f"e{s}"))
    out = slim.groupBy(*groups).agg(*stats)
    parts = []
    for i, s in enumerate(asked.source):
        p = asked.prob[i]
        points = sorted({x for j in asked.of(s) for x in (asked.prob[j] - margin, asked.prob[j] + margin) if 0 < x < 1})
        border = lambda x, end: F.get(f"e{s}", F.lit(points.index(x))) if 0 < x < 1 else F.col(end)
        n, low, high = F.col(f"n{s}"), border(p - margin, f"a{s}"), border(p + margin, f"b{s}")
        whole = n <= limit
        at = 0.0 if p in (0.0, 1.0) else 2 * margin + 4.0 / ACCURACY
        if p in (0.0, 1.0):
            low = high = F.col(f"a{s}" if p == 0 else f"b{s}")
        else:
            low, high = F.when(whole, F.col(f"a{s}")).otherwise(low), F.when(whole, F.col(f"b{s}")).otherwise(high)
        low = _rising(low, parts, asked, i)
        parts.append(F.struct(n.alias("n"), low.alias("low"), high.alias("high"),
                              F.when(whole, n).otherwise(n * at).cast("double").alias("most")).alias(f"__b{i}"))
    return out.select(*groups, *parts)


def _rising(low, parts: list, asked: _Requests, i: int):
    """A request's low border, not below that of the one before it in its column, whose rank is no higher."""
    return F.greatest(low, parts[i - 1].getField("low")) if i and asked.source[i - 1] == asked.source[i] else low


def _crowded(brackets: DataFrame, asked: _Requests, limit: int) -> bool:
    """Whether some bracket with two different borders may hold more rows than a task may order."""
    most = [F.max(F.when(F.col(f"__b{i}.low") < F.col(f"__b{i}.high"), F.col(f"__b{i}.most"))) for i in range(len(asked))]
    return brackets.agg(F.greatest(*most, F.lit(0.0), F.lit(0.0)).alias("m")).first()["m"] > limit


def _beside(slim: DataFrame, brackets: DataFrame, groups: list[str], asked: _Requests):
    """Rows with their group's brackets: a join, or literals where there is one group (they also reach the scan)."""
    if groups:
        joined = slim.join(_small(brackets).withColumnsRenamed({g: f"__r{g}" for g in groups}), _null_safe(groups)).drop(*[f"__r{g}" for g in groups])
        return joined, lambda i, f: F.col(f"__b{i}.{f}")
    row = brackets.first()
    return slim, lambda i, f: F.lit(row[f"__b{i}"][f]).cast("bigint" if f == "n" else "double")


def _small(brackets: DataFrame) -> DataFrame:
    """Brackets of few groups, counted, go to every task: else all rows of a group would meet in one and be put in order there."""
    return F.broadcast(brackets) if brackets.count() <= FEW_GROUPS else brackets


def _narrowed(slim: DataFrame, brackets: DataFrame, groups: list[str], asked: _Requests) -> DataFrame:
    """Brackets moved to borders of a new sketch of what they hold, chosen by the counts below and on them."""
    rows, part = _beside(slim, brackets, groups, asked)
    grid = F.array(*[F.lit(k / GRID) for k in range(GRID + 1)])
    stats = []
    for i, s in enumerate(asked.source):
        v, low, high = F.col(f"__c{s}"), part(i, "low"), part(i, "high")
        inner = F.when((v > low) & (v < high), v)
        stats += [F.count_if(v < low).alias(f"u{i}"), F.count_if(v == low).alias(f"l{i}"), F.count(inner).alias(f"m{i}"),
                  F.approx_percentile(inner, grid, F.lit(ACCURACY)).alias(f"e{i}"), F.first(F.struct(part(i, "n").alias("n"), low.alias("low"), high.alias("high"))).alias(f"o{i}")]
    out = rows.groupBy(*groups).agg(*stats)
    error = 2.0 / ACCURACY
    parts = []
    for i in range(len(asked)):
        n, low, high = (F.col(f"o{i}.{f}") for f in ("n", "low", "high"))
        under, on, inside = F.col(f"u{i}"), F.col(f"l{i}"), F.col(f"m{i}")
        rank = F.lit(asked.prob[i]) * (n - 1)
        first, last = F.floor(rank) - under - on, F.ceil(rank) - under - on        # places strictly inside, from 0
        left = F.floor((F.try_divide(first, inside) - error) * GRID).cast("int")
        right = F.ceil((F.try_divide(last + 1, inside) + error) * GRID).cast("int")
        new_low = F.when(last < 0, low).when(first >= inside, high).when(left > 0, F.get(f"e{i}", left)).otherwise(low)
        new_high = F.when(last < 0, low).when(first >= inside, high).when(right < GRID, F.get(f"e{i}", right)).otherwise(high)
        most = (F.least(right, F.lit(GRID)) - F.greatest(left, F.lit(0))) / GRID + 2 * error
        new_low = _rising(new_low, parts, asked, i)
        parts.append(F.struct(n.alias("n"), new_low.alias("low"), new_high.alias("high"),
                              F.least(inside.cast("double"), inside * most).alias("most")).alias(f"__b{i}"))
    return out.select(*groups, *parts)


def _ranked(slim: DataFrame, brackets: DataFrame, groups: list[str], asked: _Requests) -> DataFrame:
    """Rows (groups, __q, __p) from one more pass: a row of the table tells how many low borders of its column it reaches, and
    becomes a value of its own only for the requests whose bracket holds it."""
    rows, part = _beside(slim, brackets, groups, asked)
    entry = lambda q, reached, v: F.struct(F.lit(q).alias("__q"), reached.alias("__s"), v.alias("__v"))
    none, zero = F.lit(None).cast("double"), F.lit(0)
    told = []
    for s in range(len(asked.columns)):
        v, mine = F.col(f"__c{s}"), asked.of(s)
        reached = sum([F.when(v >= part(i, "low"), 1).otherwise(0) for i in mine], F.lit(0))
        told.append(F.when(v.isNotNull() & (reached < len(mine)), entry(-1 - s, reached, none)))
        told += [F.when((v >= part(i, "low")) & (v <= part(i, "high")), entry(i, zero, v)) for i in mine]
    counted = (rows.select(*groups, F.inline(F.filter(F.array(*told), lambda e: e.isNotNull())))
               .groupBy(*groups, "__q", "__s", "__v").agg(F.count(F.lit(1)).alias("__k")))
    # Rows that reach r of a column's borders lie below the borders of its requests from the r-th on.
    below = F.lit(None).cast("array<int>")
    for s in range(len(asked.columns)):
        mine = F.array(*[F.lit(i) for i in asked.of(s)])
        below = F.when(F.col("__q") == -1 - s, F.slice(mine, F.col("__s") + 1, len(asked.of(s)))).otherwise(below)
    spread = counted.select(*groups, F.explode(F.when(F.col("__q") >= 0, F.array("__q")).otherwise(below)).alias("__q"), "__v", "__k")
    sizes = brackets.select(*[F.col(g).alias(f"__r{g}") for g in groups], *[F.col(f"__b{i}.n").alias(f"__n{i}") for i in range(len(asked))])
    n = F.lit(None).cast("bigint")
    if groups:
        spread = spread.join(sizes, _null_safe(groups)).drop(*[f"__r{g}" for g in groups])
        for i in range(len(asked)):
            n = F.when(F.col("__q") == i, F.col(f"__n{i}")).otherwise(n)
    else:
        row = brackets.first()
        for i in range(len(asked)):
            n = F.when(F.col("__q") == i, F.lit(row[f"__b{i}"]["n"])).otherwise(n)
    probs = F.array(*[F.lit(p) for p in asked.prob])
    along = Window.partitionBy(*groups, "__q").orderBy(F.col("__v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    placed = spread.withColumn("__t", F.get(probs, F.col("__q")) * (n - 1)).withColumn("__upto", F.sum("__k").over(along))
    at = lambda r: F.max(F.when((F.col("__upto") - F.col("__k") <= r) & (r < F.col("__upto")), F.col("__v")))
    low, high = F.floor("__t"), F.ceil("__t")
    return (placed.groupBy(*groups, "__q").agg(at(low).alias("lo"), at(high).alias("hi"), F.max(F.col("__t") - low).alias("part"))
            .withColumn("__p", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")))


def quantile_edges(df: DataFrame, column: str, pieces: int) -> list[float]:
    """Sorted distinct approximate edges at i/pieces; a list of at most pieces + 1 numbers."""
    points = [i / pieces for i in range(pieces + 1)]
    row = df.agg(F.approx_percentile(column, points, F.lit(ACCURACY)).alias("e")).first()
    return sorted({float(v) for v in (row["e"] or []) if v is not None})


def exact_edges(df: DataFrame, column: str, pieces: int) -> list[float]:
    """Sorted distinct exact (interpolated) edges at i/pieces."""
    points = [i / pieces for i in range(pieces + 1)]
    names = [f"e{i}" for i in range(pieces + 1)]
    row = exact_quantiles(df, [], column, points, names).first()
    return sorted({row[n] for n in names if row is not None and row[n] is not None})
