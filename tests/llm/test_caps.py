"""Spherical caps against all cosines."""
import numpy as np
import pytest

from lateline.llm import caps


def brute(rows, cosine=0.95):
    def unit(e):
        v = None if e is None or not len(e) or any(x is None for x in e) else np.array(e, float)
        return None if v is None or not np.isfinite(v).all() or not v.any() else (v / abs(v).max()) / np.linalg.norm(v / abs(v).max())
    us = [(i, unit(e)) for i, e in rows]
    near = [[x is not None and y is not None and len(x) == len(y) and a != b and x @ y >= cosine for b, (_, y) in enumerate(us)] for a, (_, x) in enumerate(us)]
    low = [i for i, _ in us]
    for _ in us:
        low = [min([low[a], *(low[b] for b in range(len(us)) if near[a][b])]) for a in range(len(us))]
    return sorted((i, sum(n), c, c == i) for (i, _), n, c in zip(us, near, low, strict=True))


def told(df):
    return sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect())


@pytest.mark.parametrize("dim", [2, 3, 17, 64])
def test_equals_brute_force(spark, dim):
    rng = np.random.default_rng(dim)
    rows = []
    for c in range(25):
        base = rng.standard_normal(dim)
        for k in range(rng.integers(1, 8)):
            rows.append(base + rng.standard_normal(dim) * 0.27 * k / 7 * np.linalg.norm(base) / np.sqrt(dim))
    rows = [(100 + i, [float(x) for x in v]) for i, v in enumerate(rows)]
    rows += [(1, rows[0][1]), (2, [3 * x for x in rows[0][1]]), (3, [0.0] * dim), (4, None), (5, [float("nan")] * dim), (6, [None] + [1.0] * (dim - 1)),
             (7, [float("inf")] + [1.0] * (dim - 1)), (9, rows[3][1]), (10, [1e-300 * x for x in rows[3][1]])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, n_links int").repartition(3)
    assert told(caps.links(df)) == brute(rows)


def test_large_group_and_recall(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal(64)
    x = np.vstack([base + 0.15 * rng.standard_normal((150, 64)), rng.standard_normal((400, 64))])
    near = x[150:250] + 0.31 * rng.standard_normal((100, 64))        # about 0.95: on both sides of the threshold
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([x, near]))]
    got = told(caps.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    want = brute(rows)
    assert sum(r[1] for r in got) >= 0.999 * sum(r[1] for r in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))


def test_decoder_finds_all_pairs():
    rng = np.random.default_rng(0)
    for _ in range(50):
        x, y = rng.standard_normal(20), rng.standard_normal(15)
        need = rng.uniform(0, 4)
        want = {i * 15 + j for i in range(20) for j in range(15) if x[i] + y[j] >= need}
        got = caps.decode(x, y, need, 5)
        assert len(got) == len(set(got)) and (set(got) == want if len(want) >= 5 else want <= set(got) and len(got) == 5)
        total = (x[:, None] + y).ravel()
        assert set(caps.decode(x, y, 99.0, 5)) == set(np.argsort(-total)[:5])


def test_empty_and_unusable(spark):
    df = spark.createDataFrame([(1, None), (None, [1.0, 0.0]), (2, [])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in caps.links(df).collect()}
    assert got == {1: (0, 1, True), 2: (0, 2, True), None: (0, None, False)}
    assert caps.links(df.limit(0)).collect() == []


def test_two_lengths_and_an_odd_first_row(spark):
    rng = np.random.default_rng(4)
    rows = [(0, [0.0] * 5), (1, [1.0, 2.0, 3.0]), (2, []), (3, [1.0, 0.0]), (4, [1.0, 0.0, 0.0])]
    for c in range(12):
        for dim in (64, 24):
            base = rng.standard_normal(dim)
            rows += [(100 * c + dim + k, (base + 0.05 * k * rng.standard_normal(dim)).tolist()) for k in range(3)]
    got = told(caps.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)))
    assert got == brute(rows) and sum(r[1] for r in got) >= 100
