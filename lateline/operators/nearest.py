"""Exact nearest-box join in the plane, without a cross join.

Boxes (points are boxes of size zero) go into a hierarchy of grid cells. Every cell keeps the
bounding rectangle of its boxes and one representative. The representatives of a point's own cells
bound its answer; only cells within that bound are visited, from the level that fits the bound down
to the last one. On the way the best representative so far tightens the bound, and cells whose
rectangle cannot beat it are dropped. The boxes themselves are compared in the few cells that are
left. Every step is an equality join on a cell number.

The cost is either the squared distance, or (search band, squared distance): with ``radii`` a box
belongs to the smallest radius whose square window around the point touches it, and a nearer band
always wins. Boxes outside the widest window do not match.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint

SIDE = 8  # cells per axis and level
MAX_LEVEL = 6
LEAF = 32


def _cost(prefix: str, radii: Sequence[float] | None) -> Column:
    zero = F.lit(0.0)
    dx = F.greatest(F.col(f"{prefix}minx") - F.col("px"), zero, F.col("px") - F.col(f"{prefix}maxx"))
    dy = F.greatest(F.col(f"{prefix}miny") - F.col("py"), zero, F.col("py") - F.col(f"{prefix}maxy"))
    band = F.lit(0)
    if radii:
        reach = F.greatest(dx, dy)
        for r in sorted(radii):
            band = band + (reach > F.lit(float(r))).cast("int")
    return F.struct(band.alias("band"), (dx * dx + dy * dy).alias("d2"))


def _cell(level: int, x: Column, y: Column, frame: tuple[float, float, float]) -> Column:
    x0, y0, size = frame
    n = SIDE**level
    step = size / n
    clip = lambda v: F.greatest(F.lit(0).cast("bigint"), F.least(F.floor(v / F.lit(step)), F.lit(n - 1).cast("bigint")))
    return clip(x - F.lit(x0)) * F.lit(n) + clip(y - F.lit(y0))


def _cells(boxes: DataFrame, level: int, frame) -> DataFrame:
    """(parent, child, rectangle c…, representative r…) of the non-empty cells of a level."""
    corners = ("minx", "maxx", "miny", "maxy")
    return (
        boxes.withColumn("child", _cell(level, F.col("mx"), F.col("my"), frame))
        .withColumn("parent", _parent(F.col("child"), level))
        .groupBy("parent", "child")
        .agg(
            F.min("minx").alias("cminx"), F.max("maxx").alias("cmaxx"),
            F.min("miny").alias("cminy"), F.max("maxy").alias("cmaxy"),
            F.min_by(F.struct(*corners), "id").alias("rep"),
        )
        .select("parent", "child", "cminx", "cmaxx", "cminy", "cmaxy", *[F.col(f"rep.{k}").alias(f"r{k}") for k in corners])
    )


def _levels(boxes: DataFrame, frame) -> int:
    """Depth at which leaves are small, from one pass that rolls the finest grid up."""
    finest = boxes.groupBy(_cell(MAX_LEVEL, F.col("mx"), F.col("my"), frame).alias("c")).count()
    n = SIDE**MAX_LEVEL
    cx, cy = F.floor(F.col("c") / n), F.pmod(F.col("c"), F.lit(n))
    coarser = F.inline(F.array(*[
        F.struct(F.lit(level).alias("level"), F.floor(cx / SIDE ** (MAX_LEVEL - level)).alias("x"),
                 F.floor(cy / SIDE ** (MAX_LEVEL - level)).alias("y"))
        for level in range(1, MAX_LEVEL + 1)]))
    worst = (
        finest.select("count", coarser).groupBy("level", "x", "y").agg(F.sum("count").alias("k"))
        .groupBy("level").agg(F.max("k").alias("k"))
    )
    # MAX_LEVEL rows.
    fits = [r["level"] for r in worst.collect() if r["k"] is not None and r["k"] <= LEAF]
    return min(fits) if fits else MAX_LEVEL


def nearest_box(
    points: DataFrame, boxes: DataFrame, *, point_key: str, x: str, y: str, box_key: str,
    bounds: Sequence[str], radii: Sequence[float] | None = None, out: str = "nearest",
) -> DataFrame:
    """(point_key, out, d2) with the nearest box of every point; lowest box key wins a tie.

    Points with a NULL coordinate, or with no box inside the widest radius, have no row.
    """
    # Equal rectangles (copies of one box) count once, under their lowest key.
    unique = (
        boxes.select(F.col(box_key).alias("id"), *[F.col(b).cast("double").alias(n) for b, n in zip(bounds, ("minx", "maxx", "miny", "maxy"))])
        .dropna().groupBy("minx", "maxx", "miny", "maxy").agg(F.min("id").alias("id"))
        .withColumns({"mx": (F.col("minx") + F.col("maxx")) / 2, "my": (F.col("miny") + F.col("maxy")) / 2})
    )
    # The dimension is read once per level below.
    unique = checkpoint(unique)
    corners = ("minx", "maxx", "miny", "maxy")
    ext = unique.agg(
        F.min("mx"), F.max("mx"), F.min("my"), F.max("my"),
        F.max(F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))) / 2,
        F.min_by(F.struct(*corners), "id"),
    ).first()
    keyed = points.select(F.col(point_key), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py"))
    if ext[0] is None:
        return keyed.limit(0).select(point_key, F.lit(None).cast(dict(boxes.dtypes)[box_key]).alias(out), F.lit(0.0).alias("d2"))
    size = max(ext[1] - ext[0], ext[3] - ext[2], 1e-9) * (1 + 1e-9)
    frame = (ext[0], ext[2], size)
    depth = _levels(unique, frame)
    cells = {level: _cells(unique, level, frame) for level in range(1, depth + 1)}

    # Equal points share one search.
    spots = keyed.dropna(subset=["px", "py"]).select("px", "py").distinct()

    # 1. A first bound: the representative of the point's own cell on every level that has one,
    # and one fixed box for points with empty cells around them.
    anyone = spots.withColumns({f"r{c}": F.lit(v) for c, v in zip(corners, ext[5])}).withColumn("up", _cost("r", radii))
    own = anyone.select("px", "py", "up", F.inline(F.array(*[
        F.struct(F.lit(level).alias("level"), _cell(level, F.col("px"), F.col("py"), frame).alias("cell"))
        for level in cells])))
    reps = None
    for level, c in cells.items():
        part = c.select(F.lit(level).alias("rlevel"), "child", *[f"r{k}" for k in corners])
        reps = part if reps is None else reps.unionByName(part)
    bound = (
        own.join(reps, (F.col("level") == F.col("rlevel")) & (F.col("cell") == F.col("child")), "left")
        .withColumn("near", F.when(F.col("child").isNotNull(), _cost("r", radii)))
        .groupBy("px", "py").agg(F.min(F.least("up", "near")).alias("best"))
    )

    # 2. Cells the answer can lie in, on the finest level whose cells are as wide as the bound.
    if radii:
        wide = F.lit(float(max(radii)))
        for i, r in reversed(list(enumerate(sorted(radii)))):
            wide = F.when(F.col("best.band") <= i, F.lit(float(r))).otherwise(wide)
    else:
        wide = F.sqrt(F.col("best.d2"))
    slack = 1e-9 * (size + abs(ext[0]) + abs(ext[2]))
    reach = wide * (1 + 1e-9) + F.lit(ext[4] + slack)
    start = F.lit(1)
    for level in range(2, depth + 1):
        start = start + (F.lit(size / SIDE**level) >= F.col("reach")).cast("int")
    sized = bound.withColumn("reach", reach).withColumn("level", start)
    n = F.lit(0).cast("bigint")
    for level in cells:
        n = F.when(F.col("level") == level, F.lit(SIDE**level).cast("bigint")).otherwise(n)
    sized = sized.withColumn("n", n)

    def index(value: Column, origin: float) -> Column:
        at = F.floor((value - F.lit(origin)) / (F.lit(size) / F.col("n")))
        return F.greatest(F.lit(0).cast("bigint"), F.least(at, F.col("n") - 1))

    entries = (
        sized.withColumn("cx", F.explode(F.sequence(index(F.col("px") - F.col("reach"), frame[0]), index(F.col("px") + F.col("reach"), frame[0]))))
        .withColumn("cy", F.explode(F.sequence(index(F.col("py") - F.col("reach"), frame[1]), index(F.col("py") + F.col("reach"), frame[1]))))
        .select("px", "py", "best", "level", (F.col("cx") * F.col("n") + F.col("cy")).alias("cell"))
    )

    # 3. Walk down; points enter on their own level.
    frontier: DataFrame | None = None
    for level, c in cells.items():
        hinted = F.broadcast(c) if level <= 2 else c  # at most 64 and 4,096 rows
        step = entries.filter(F.col("level") == level).join(hinted, F.col("cell") == F.col("child")).drop("level", "cell", "parent")
        if frontier is not None:
            step = step.unionByName(frontier.join(hinted, F.col("cell") == F.col("parent")).drop("cell", "parent"))
        priced = step.withColumns({"low": _cost("c", radii), "up": _cost("r", radii)})
        over = Window.partitionBy("px", "py")
        tight = priced.withColumn("best", F.least("best", F.min("up").over(over)))
        frontier = tight.filter(F.col("low") <= F.col("best")).select("px", "py", F.col("child").alias("cell"), "best")

    leaves = unique.withColumn("leaf", _cell(depth, F.col("mx"), F.col("my"), frame))
    hits = frontier.select("px", "py", "cell").join(leaves, F.col("cell") == F.col("leaf")).withColumn("cost", _cost("", radii))
    if radii:
        hits = hits.filter(F.col("cost.band") < len(radii))
    won = (
        hits.groupBy("px", "py").agg(F.min(F.struct("cost", "id")).alias("m"))
        .select(F.col("px").alias("__x"), F.col("py").alias("__y"), F.col("m.id").alias(out), F.col("m.cost.d2").alias("d2"))
    )
    return keyed.join(won, (F.col("px") == F.col("__x")) & (F.col("py") == F.col("__y"))).select(point_key, out, "d2")


def _parent(cell: Column, level: int) -> Column:
    n = SIDE**level
    cx, cy = F.floor(cell / n), F.pmod(cell, F.lit(n))
    return F.floor(cx / SIDE) * F.lit(n // SIDE) + F.floor(cy / SIDE)


def nearest_point(
    points: DataFrame, targets: DataFrame, *, point_key: str, x: str, y: str, target_key: str,
    tx: str, ty: str, out: str = "nearest",
) -> DataFrame:
    """Nearest target by planar distance in the given coordinates (k = 1)."""
    return nearest_box(
        points, targets, point_key=point_key, x=x, y=y, box_key=target_key,
        bounds=(tx, tx, ty, ty), out=out,
    )
