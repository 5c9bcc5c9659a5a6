import pytest

from lateline.operators import metrics as M


def pairs(spark, rows):
    return spark.createDataFrame(rows, "label double, prediction double")


def from_matrix(spark, matrix):
    """One row per cell with its count, expanded by Spark."""
    cells = [(i, j, n) for i, row in enumerate(matrix) for j, n in enumerate(row)]
    df = spark.createDataFrame(cells, "label int, prediction int, n int")
    return df.selectExpr("label", "prediction", "explode(sequence(1, n)) as k")


@pytest.mark.parametrize("pred,mse,r2", [((110.0, 190.0, 310.0), 100.0, None), ((100.0, 200.0, 300.0), 0.0, 1.0), ((200.0, 200.0, 200.0), None, 0.0)])
def test_regression(spark, pred, mse, r2):
    r = M.regression_metrics(pairs(spark, list(zip((100.0, 200.0, 300.0), pred)))).first()
    assert r.rmse == pytest.approx(r.mse**0.5)
    assert mse is None or r.mse == pytest.approx(mse)
    assert r2 is None or r.r2 == pytest.approx(r2)


def test_published_four_class_matrix(spark):
    df = from_matrix(spark, [[35471, 5594, 454, 13], [8122, 17452, 3399, 1], [1135, 4435, 17869, 239], [44, 10, 565, 1866]])
    rep = {r.cls: r for r in M.class_report(df).collect()}
    want = {0: (0.7923, 0.8541, 0.8220, 41532), 1: (0.6348, 0.6023, 0.6182, 28974), 2: (0.8018, 0.7547, 0.7775, 23678), 3: (0.8806, 0.7509, 0.8106, 2485)}
    for c, (p, r, f, s) in want.items():
        assert (round(rep[c].precision, 4), round(rep[c].recall, 4), round(rep[c].f1, 4), rep[c].support) == (p, r, f, s)
    s = M.class_summary(df).first()
    assert round(s.macro_f1, 4) == 0.7571 and round(s.accuracy, 4) == 0.7516
    got = [tuple(r)[1:] for r in M.confusion(df, [0, 1, 2, 3]).orderBy("actual").collect()]
    assert got[0] == (35471, 5594, 454, 13) and got[3] == (44, 10, 565, 1866)


def test_missing_classes_count_as_zero(spark):
    df = pairs(spark, [(0.0, 2.0), (0.0, 0.0), (1.0, 0.0)])
    rep = {r.cls: (r.precision, r.recall, r.f1, r.support) for r in M.class_report(df).collect()}
    assert rep[2] == (0.0, 0.0, 0.0, 0) and rep[1][1] == 0.0 and set(rep) == {0, 1, 2}
    cm = {r.actual: (r.pred_0, r.pred_1, r.pred_2) for r in M.confusion(df, [0, 1, 2]).collect()}
    assert cm == {0: (1, 0, 1), 1: (1, 0, 0), 2: (0, 0, 0)}


def test_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "c int")
    w = {r.c: r.weight for r in M.class_weights(df, "c").collect()}
    assert w == {0: pytest.approx(8 / 12), 1: pytest.approx(2.0)}
    rows = M.with_class_weight(df, "c", "sqrt_balanced").distinct().collect()
    assert {r.c: r.weight for r in rows}[1] == pytest.approx(2**0.5)
    assert M.with_class_weight(df, "c", None).filter("weight <> 1").count() == 0


def test_leaderboard(spark):
    df = spark.createDataFrame([("a", 0.5, 1), ("a", 0.7, 2), ("b", 0.6, 1), ("c", None, 1)], "name string, f1 double, run int")
    assert [(r.name, r.run) for r in M.leaderboard(df, "f1").collect()] == [("a", 2), ("b", 1)]
    assert M.leaderboard(df, "f1", descending=False).first()["name"] == "a"
