"""Ordered operators over trips: previous value, position and distance.

A window partition is one task. Most trips are short, but one key (a default trip id, the NULL
key) may hold a large part of all rows. Keys above ``hot_rows`` are therefore cut into chunks of
the ordering axis. A small summary (one row per hot key and chunk) carries the last value and the
row count across chunk borders, so the result is identical to the plain window while no task
holds a whole hot key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.conditions import planar_distance
from ..session import checkpoint

# Decides how a key is computed, never its result.
HOT_ROWS = 1_000_000
CHUNK_ROWS = 250_000      # rows a chunk of a hot key should have
CHUNKS = 4096             # chunks of a key at most; a larger key has larger ones
SAMPLED = 8               # sampled rows per border
MEASURED = "measured"


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(prefix + k))
    return cond


def _hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame:
    """Keys with more than ``hot_rows`` rows and their counts, written once: from here on they are a small table."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).filter(F.col("__rows") > max(hot_rows, 0))
    return checkpoint(counts.withColumnsRenamed({k: f"__h{k}" for k in keys}))


def _with_borders(df: DataFrame, hot: DataFrame, keys: Sequence[str], order: Sequence[str], chunk_rows: int) -> DataFrame:
    """Hot keys with the borders of their chunks: every ``SAMPLED``-th of a hash sample of their order values.

    ``__coarse`` holds every 64th border, so that a row is placed by two short comparisons instead of one long one."""
    pieces = F.least(F.ceil(F.col("__rows") / chunk_rows), F.lit(CHUNKS))
    every = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("__rows") / (pieces * SAMPLED)))
    slim = df.select(*[F.col(k).alias(f"__k{k}") for k in keys], F.col(order[0]).alias("__b"), F.xxhash64(*order).alias("__o"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"__k{k}").eqNullSafe(F.col(f"__h{k}"))
    sample = slim.join(hot, cond).filter(F.col("__b").isNotNull() & (F.pmod(F.col("__o"), every) == 0))
    names = [f"__h{k}" for k in keys]
    lists = sample.groupBy(*names).agg(F.sort_array(F.collect_list("__b")).alias("__l"))
    borders = F.array_distinct(F.filter("__l", lambda x, i: i % SAMPLED == SAMPLED - 1))
    lists = lists.select(*[F.col(n).alias(f"__l{n}") for n in names], borders.alias("__borders"))
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"__l{n}"))
    out = hot.join(lists, same, "left").drop(*[f"__l{n}" for n in names])
    return checkpoint(out.withColumn("__borders", F.coalesce("__borders", F.slice("__borders", 1, 0)))
                      .withColumn("__coarse", F.filter("__borders", lambda x, i: i % 64 == 0)))


def _chunk_of(value: Column) -> Column:
    """Number of borders not above the value; never decreases with it."""
    start = F.greatest(F.size(F.filter("__coarse", lambda b: b <= value)) - 1, F.lit(0)) * 64
    return start + F.size(F.filter(F.slice("__borders", start + 1, F.lit(64)), lambda b: b <= value))


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    lags: Mapping[str, str] | None = None,
    index: str | None = None,
    base: int = 0,
    chunk: Column | str | None = None,
    hot_rows: int = HOT_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add previous-row values (``{new: source}``) and/or the position within ``keys``.

    ``order`` must end in a unique tie-break. ``chunk=MEASURED`` cuts hot keys at borders taken from their own
    rows, about ``chunk_rows`` apart (rows equal in the first order column stay together); an expression
    that never decreases along ``order`` cuts them as the caller says. NULLs of the chunk, like those
    of the order, come first and are a chunk of their own. Without ``chunk`` every key is handled by
    one window partition. ``hot_rows=0`` chunks every key, which is the right choice for an empty
    or a handful of keys.
    """
    lags = dict(lags or {})
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        new = {out: F.lag(src).over(w) for out, src in lags.items()}
        if index:
            new[index] = F.row_number().over(w) - 1 + base
        return df.withColumns(new)

    measured = isinstance(chunk, str)
    if measured and not keys:
        raise ValueError("borders are measured per key; without keys give a chunk expression")
    inputs = {f"__v{i}": src for i, src in enumerate(lags.values())}
    rows = df.withColumns({v: F.col(src) for v, src in inputs.items()})
    if hot_rows <= 0 and not measured:
        hot = None
        rows = rows.withColumn("__hot", F.lit(True))
    else:
        hot = _hot_keys(df, keys, hot_rows)
        if hot.isEmpty():
            return with_previous(df, keys, order, lags=lags, index=index, base=base)
        if measured:
            hot = _with_borders(df, hot, keys, order, chunk_rows)
        # Few keys as a rule, but their number grows with the rows: Spark decides by measured size how to join.
        rows = rows.join(hot.withColumn("__hot", F.lit(True)), _null_safe(rows, hot, keys, "__h"), "left")
        rows = rows.withColumn("__hot", F.coalesce("__hot", F.lit(False)))
    at = _chunk_of(F.col(order[0])) if measured else chunk
    known = F.col(order[0]).isNotNull() if measured else chunk.isNotNull()
    # NULL must sort first and stay apart from "not hot", so the chunk is a pair.
    pair = F.struct(known.alias("known"), F.when(known, at).alias("at"))
    rows = rows.withColumn("__chunk", F.when(F.col("__hot"), pair))
    if hot is not None:
        rows = rows.drop(*hot.columns)

    # One row per hot key and chunk: how many rows, and the values of the last one.
    last = F.max_by(F.struct(*[F.col(v) for v in inputs], F.lit(1).alias("__one")), F.struct(*order))
    summary = (
        rows.filter("__hot")
        .groupBy(*keys, "__chunk")
        .agg(F.count(F.lit(1)).alias("__n"), last.alias("__last"))
    )
    over_chunks = Window.partitionBy(*keys).orderBy("__chunk")
    before = over_chunks.rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.withColumns({
        "__prev": F.lag("__last").over(over_chunks),
        "__shift": F.coalesce(F.sum("__n").over(before), F.lit(0)) - 1,
    })
    heads = carried.select(
        *keys, "__chunk", *[F.col(f"__prev.{v}").alias(v) for v in inputs], "__shift",
        F.lit(0).alias("__row"),
    )
    body = rows.withColumns({"__shift": F.lit(0).cast("bigint"), "__row": F.lit(1)})
    both = body.unionByName(heads, allowMissingColumns=True)

    w = Window.partitionBy(*keys, "__chunk").orderBy("__row", *order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = {out: F.lag(v).over(w) for out, v in zip(lags, inputs)}
    if index:
        new[index] = (F.row_number().over(w) + F.sum("__shift").over(upto)).cast("int") - 1 + base
    wanted = df.columns + [c for c in new if c not in df.columns]
    return both.withColumns(new).filter(F.col("__row") == 1).select(*wanted)


def previous_value(df: DataFrame, keys, order, source: str, out: str, **kw) -> DataFrame:
    return with_previous(df, keys, order, lags={out: source}, **kw)


def previous_value_filled(df: DataFrame, keys, order, source: str, out: str, default, **kw) -> DataFrame:
    """Previous value as float, with a constant where there is none."""
    lagged = previous_value(df, keys, order, source, out, **kw)
    return lagged.withColumn(out, F.coalesce(F.col(out).cast("double"), F.lit(float(default))).cast("float"))


def position(df: DataFrame, keys, order, out: str, base: int = 0, **kw) -> DataFrame:
    return with_previous(df, keys, order, index=out, base=base, **kw)


def distance_to_previous(
    df: DataFrame, keys, order, x: str, y: str, out: str, same: str | None = None, **kw
) -> DataFrame:
    """Planar distance to the previous row of ``keys``.

    ``same`` names a column that must be equal on both rows (the legacy file-order mode keys by
    date only and compares the trip of the neighbour).
    """
    lags = {"__px": x, "__py": y}
    if same:
        lags["__psame"] = same
    lagged = with_previous(df, keys, order, lags=lags, **kw)
    dist = planar_distance("__px", "__py", x, y)
    if same:
        dist = F.when(F.col("__psame") == F.col(same), dist)
    return lagged.withColumn(out, dist).drop(*lags)


def sampled_chunks(df: DataFrame, column: str, pieces: int = 256, seed: int = 42) -> Column:
    """Chunk expression that cuts any sortable column into pieces of similar size.

    The borders are a small hash sample of the column's values (``pieces - 1`` of them), so they
    follow its distribution; a chunk is the number of borders not above the value.
    """
    h = F.xxhash64(F.lit(seed), F.col(column))
    rows = df.select(column).distinct().orderBy(h, column).limit(pieces - 1).collect()
    borders = [r[0] for r in rows if r[0] is not None]
    if not borders:
        return F.lit(0)
    fixed = F.array(*[F.lit(b) for b in sorted(borders)])
    return F.coalesce(F.size(F.filter(fixed, lambda b: b <= F.col(column))), F.lit(0))
