import random

import pytest

from lateline.operators.joins import ROAD_RADII, nearest_road
from lateline.operators.nearest import nearest_box, nearest_point


def band(reach, radii):
    return sum(reach > r for r in radii)


def brute(points, boxes, radii=None):
    out = {}
    for pid, px, py in points:
        best = None
        for bid, x0, x1, y0, y1 in boxes:
            dx, dy = max(x0 - px, 0.0, px - x1), max(y0 - py, 0.0, py - y1)
            b = band(max(dx, dy), radii) if radii else 0
            if radii and b >= len(radii):
                continue
            cost = (b, dx * dx + dy * dy, bid)
            best = cost if best is None or cost < best else best
        if best:
            out[pid] = best[2]
    return out


@pytest.mark.parametrize("seed,clusters", [(1, 0), (2, 3), (3, 1)])
def test_roads_match_brute_force(spark, seed, clusters):
    rng = random.Random(seed)
    centres = [(rng.uniform(0, 90000), rng.uniform(0, 90000)) for _ in range(clusters)]
    def place():
        if centres and rng.random() < 0.7:
            cx, cy = rng.choice(centres)
            return cx + rng.gauss(0, 300), cy + rng.gauss(0, 300)
        return rng.uniform(0, 100000), rng.uniform(0, 100000)
    boxes = []
    for i in range(600):
        x, y = place()
        boxes.append((i, x, x + rng.choice([0, 50, 900]), y, y + rng.choice([0, 40, 700])))
    boxes += [(600 + i, *boxes[i][1:]) for i in range(200)]  # copies
    points = [(i, *place()) for i in range(400)]
    points += [(400 + i, *points[0][1:]) for i in range(50)] + [(900, -5e5, 0.0), (901, boxes[0][1], boxes[0][3])]
    p = spark.createDataFrame(points, "stop_id int, east double, north double")
    b = spark.createDataFrame(boxes, "id int, minx double, maxx double, miny double, maxy double")
    got = {r.stop_id: r.road for r in nearest_road(p, b).collect()}
    assert got == brute(points, boxes, ROAD_RADII)
    plain = nearest_box(p, b, point_key="stop_id", x="east", y="north", box_key="id", bounds=("minx", "maxx", "miny", "maxy"), out="road")
    assert {r.stop_id: r.road for r in plain.collect()} == brute(points, boxes)


def test_window_edges_are_inclusive(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 1e6, 0.0)], "stop_id int, east double, north double")
    near = lambda *boxes: {r.stop_id: r.road for r in nearest_road(p, spark.createDataFrame(list(boxes), "id int, minx double, maxx double, miny double, maxy double")).collect()}
    assert near((1, 500.0, 600.0, 0.0, 1.0)) == {1: 1}
    assert near((1, 5000.0, 5600.0, 0.0, 1.0)) == {1: 1}
    assert near((1, 5000.1, 5600.0, 0.0, 1.0)) == {}
    # A corner box in the 500 m window beats a straight one just outside it, although it is farther.
    assert near((1, 499.0, 500.0, 499.0, 500.0), (2, 501.0, 502.0, 0.0, 1.0)) == {1: 1}
    # Equal distance: lowest id.
    assert near((7, 10.0, 10.0, 0.0, 0.0), (3, -10.0, -10.0, 0.0, 0.0)) == {1: 3}


def test_points_without_coordinates_and_empty_targets(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0)], "id int, x double, y double")
    t = spark.createDataFrame([("s", 1.0, 1.0)], "sid string, tx double, ty double")
    kw = dict(point_key="id", x="x", y="y", target_key="sid", tx="tx", ty="ty")
    assert [(r.id, r.nearest) for r in nearest_point(p, t, **kw).collect()] == [(1, "s")]
    assert nearest_point(p, t.limit(0), **kw).count() == 0
