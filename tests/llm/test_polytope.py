"""Cross-polytope tables: recall against all cosines, exact scores, edge cases."""
import numpy as np
import pytest

from lateline.llm import polytope

KIND = "vec_id long, embedding array<double>"


def brute(rows, asked, k=5):
    """Best k rows of each asked id, by cosine, then id."""
    rows = [(i, np.array(v)) for i, v in rows]
    out = {}
    for i, v in rows:
        if asked(i):
            s = sorted((-(v @ w) / np.sqrt((v @ v) * (w @ w)), j) for j, w in rows if j != i and len(w) == len(v))
            out[i] = [(j, -x) for x, j in s[:k]]
    return out


def told(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    hits = [x in dict(got.get(i, [])) for i, best in want.items() for x, _ in best]
    return np.mean(hits)


@pytest.mark.parametrize("dim,bucket", [(64, 4096), (24, 20), (3, 8)])
def test_recall_and_exact_scores(spark, dim, bucket):
    rng = np.random.default_rng(dim)
    base = rng.standard_normal((60, dim))
    x = np.vstack([rng.standard_normal((900, dim)), base[rng.integers(0, 60, 300)] + 0.3 * rng.standard_normal((300, dim))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, KIND).repartition(3)
    got, want = told(polytope.nearest(df, df.where("vec_id % 8 = 0"), bucket=bucket)), brute(rows, lambda i: i % 8 == 0)
    assert recall(got, want) >= 0.93
    for i, best in got.items():
        assert len(best) == 5 and best == sorted(best, key=lambda b: (-b[1], b[0])) and i not in dict(best)
        for j, s in best:
            assert s == pytest.approx(x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]), abs=1e-14)


def test_transform_is_orthogonal_and_axes_are_nearest():
    poly = polytope.Polytopes(10, 1, 2, 3)
    x = np.random.default_rng(0).standard_normal((50, 10))
    y = poly.turned(x, 0)
    assert poly.width == 16 and np.allclose(np.square(y).sum(2), np.square(x).sum(1)[:, None])
    assert (poly.buckets(x, 0) == poly.probes(x, 0, 1)[:, 0]).all()
    probes = poly.probes(x, 0, 40)
    assert all(len(set(p)) == 40 for p in probes)
    near = np.stack([y, -y], 3).reshape(50, 2, 32)
    total = (near[:, 0, :, None] + near[:, 1, None, :]).reshape(50, -1)
    assert np.allclose(np.take_along_axis(total, probes, 1), -np.sort(-total, axis=1)[:, :40])


def test_ties_copies_and_unusable_rows(spark):
    hot = [1.0, 2.0, -1.0, 0.5]
    rows = [(i, hot) for i in range(3, 90)] + [(200 + i, [2 * x for x in hot]) for i in range(4)] + [(300 + i, [float(i), 1.0, 1.0, -1.0]) for i in range(9)]
    odd = [(1, None), (2, []), (400, [0.0] * 4), (401, [float("nan")] * 4), (402, [None, 1.0, 1.0, 1.0]), (403, [float("inf"), 1.0, 1.0, 1.0]), (None, hot),
           (50, hot), (50, hot), (404, [1e-300 * x for x in hot]), (405, [1e300 * x for x in hot]), (500, [1.0, 1.0]), (501, [1.0, 0.5]), (502, [3.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], KIND + ", key string").repartition(2)
    got = told(polytope.nearest(df, df.where("vec_id in (3, 50, 89, 200, 300, 400, 401, 404, 500, 502)"), recall=1.0))
    assert [j for j, _ in got[50]] == [3, 4, 5, 6, 7] and [j for j, _ in got[3]] == [4, 5, 6, 7, 8] and [j for j, _ in got[89]] == [3, 4, 5, 6, 7]
    assert [j for j, _ in got[200]] == [3, 4, 5, 6, 7] and [round(s, 12) for _, s in got[404]] == [1.0] * 5
    assert [j for j, _ in got[500]] == [501] and got[300][0][0] == 301 and set(got) == {3, 50, 89, 200, 300, 404, 500}


def test_an_id_with_two_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [1.0, 0.2]), (3, [0.0, 1.0])]
    df = spark.createDataFrame(rows, KIND)
    got = [(r["rank"], r["vec_id"]) for r in polytope.nearest(df, df.where("vec_id = 1"), recall=1.0).collect()]
    assert sorted(got) == [(1, 1), (1, 1), (2, 2), (2, 2), (3, 3), (3, 3)]


def test_hot_bucket_is_cut_into_blocks(spark, monkeypatch):
    from lateline.llm import blocks

    monkeypatch.setattr(blocks.paired, "__kwdefaults__", {"q_size": 4, "r_size": 16})
    rng = np.random.default_rng(2)
    base = rng.standard_normal(16)
    rows = [(i, (base + 0.01 * rng.standard_normal(16)).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, KIND)
    got, want = told(polytope.nearest(df, df.where("vec_id % 10 = 0"))), brute(rows, lambda i: i % 10 == 0)
    assert recall(got, want) >= 0.97


def test_empty(spark):
    df = spark.createDataFrame([], KIND)
    assert polytope.nearest(df, df).collect() == []
    one = spark.createDataFrame([(1, [1.0, 2.0])], KIND)
    assert polytope.nearest(one, one).collect() == [] and polytope.nearest(df, one).collect() == []


def test_probes_stay_few_without_near_neighbours(spark, monkeypatch):
    made, write = {}, polytope.written
    monkeypatch.setattr(polytope, "written", lambda df, name: [made.update({name: write(df, name)}), made[name]][1])
    x = np.random.default_rng(5).standard_normal((1500, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, KIND)
    got, want = told(polytope.nearest(df, df.where("vec_id % 10 = 0"), bucket=4)), brute(rows, lambda i: i % 10 == 0)
    assert recall(got, want) >= 0.93
    # Two rotations would send each query to thousands of buckets, each time with its vector.
    sent = made["probes"]
    assert sent.count() == 4 * 150 and sent.selectExpr("max(size(keys))").first()[0] <= 128
    assert made["index"].count() == 1500


def test_probes_take_bounded_memory():
    import tracemalloc

    poly, x = polytope.Polytopes(64, 1, 2, 3), np.random.default_rng(6).standard_normal((1024, 64))
    tracemalloc.start()
    probes = poly.probes(x, 0, 2000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert probes.shape == (1024, 2000) and peak < 1.5e8


def test_rotations_are_those_with_the_least_work():
    rng = np.random.default_rng(7)
    far = polytope.normed(rng.standard_normal((4096, 64)))
    base = rng.standard_normal((400, 64))
    near = polytope.normed(base[rng.integers(0, 400, 4096)] + 0.1 * rng.standard_normal((4096, 64)))
    work = dict(tables=4, bucket=4096, k=5, recall=0.975, seed=11)
    assert polytope.planned(far, 600_000, 12_000, **work)[0] == 1
    assert polytope.planned(near, 600_000, 12_000, **work)[0] == 1          # 16,384 small buckets a table cost more than they spare
    assert polytope.planned(near, 60_000_000, 1_200_000, **work)[0] == 2


@pytest.mark.parametrize("kind", ["float", "double"])
def test_two_rotations_in_small_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(polytope, "PROBE", 0.01)
    monkeypatch.setattr(polytope, "GROUP", 0.01)
    monkeypatch.setattr(polytope, "ASKED", 16 * 4)
    monkeypatch.setattr(polytope, "INDEXED", 16 * 8)
    plans, plan = [], polytope.planned
    monkeypatch.setattr(polytope, "planned", lambda *a: plans.append(plan(*a)) or plans[-1])
    rng = np.random.default_rng(8)
    base = rng.standard_normal((30, 16))
    x = (base[rng.integers(0, 30, 500)] + 0.02 * rng.standard_normal((500, 16))).astype(np.float32 if kind == "float" else np.float64)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[0].tolist()) for i in range(20)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    got, want = told(polytope.nearest(df, df.where("vec_id % 10 = 0"), bucket=8)), brute(rows, lambda i: i % 10 == 0)
    assert plans[0][0] == 2 and set(got) == set(want) and recall(got, want) >= 0.93
    assert got[1010] == [(j, pytest.approx(1, abs=1e-14)) for j in (0, 1000, 1001, 1002, 1003)]
    for i, best in got.items():
        assert len(best) == 5 and i not in dict(best)
        for j, s in best:
            a, b = (np.array(x[z] if z < 500 else x[0], float) for z in (i, j))
            assert s == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-14)
