"""Merging, statistics and imputers, against worked values and properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreweave.operators import cells as C
from scoreweave.operators import impute as I
from scoreweave.operators import multivariate as V

OBS = "entity string, metric string, score double, std_dev double, source string, ord long"
#: Three metrics, five entities, two gaps.
X1 = [("e1", "A", 10), ("e1", "B", 21), ("e1", "C", 5), ("e2", "A", 20), ("e2", "B", 38), ("e3", "A", 30), ("e3", "B", 62), ("e3", "C", 14), ("e4", "A", 40), ("e4", "C", 22), ("e5", "A", 50), ("e5", "B", 101), ("e5", "C", 24)]


def frame(spark, rows):
    return spark.createDataFrame([(e, m, None if s is None else float(s), None, "src", i) for i, (e, m, s) in enumerate(rows)], OBS)


def grid(spark, rows):
    return C.densify(C.merge_cells(frame(spark, rows)).drop("n", "source"))


def filled(df):
    return {(r.entity, r.metric): (r.score, r.std_dev) for r in df.where("not is_known").collect()}


def test_merge_counts_null_as_zero(spark):
    obs = spark.createDataFrame([("e", "m", 10.0, 3.0, "a", 1), ("e", "m", None, None, "b", 2), ("e", "n", 7.0, None, "", 3), ("e", "o", 1.5, 2.0, "c", 4), ("e", "o", 2.0, None, "d", 0)], OBS)
    got = {r.metric: r for r in C.merge_cells(obs).collect()}
    assert (got["m"].score, got["m"].std_dev) == (5.0, pytest.approx(7.0710678118654755))
    assert (got["n"].score, got["n"].std_dev, got["n"].source) == (7.0, 0.0, "Original")
    assert got["o"].source == "Multiple: Score 2 at d; Score 1.5 at c"


@pytest.mark.parametrize(("values", "mean"), [([1, 2, 3, 4, 5], 3), ([42], 42), ([-1, -2, -3, -4, -5], -3), ([-2, 0, 2], 0), ([1e10, 2e10, 3e10], 2e10)])
def test_metric_mean(spark, values, mean):
    rows = [(f"e{i}", "m", v) for i, v in enumerate(values)]
    assert C.metric_means(grid(spark, rows)).first()["mean"] == mean


def test_metric_mean_without_scores_is_zero(spark):
    assert C.metric_means(grid(spark, [("e", "m", None)])).first()["mean"] == 0


def test_pair_lines(spark):
    pairs = {(r.bk, r.bj): (r.a, r.b) for r in I.pair_regression(grid(spark, [("m1", "b1", 10), ("m1", "b2", 20), ("m2", "b1", 30), ("m2", "b2", 40)])).collect()}
    assert pairs[("b2", "b1")] == pytest.approx((1, 10))
    pairs = {(r.bk, r.bj): (r.a, r.b) for r in I.pair_regression(grid(spark, X1)).collect()}
    assert pairs[("C", "A")] == pytest.approx((0.5, 0.0), abs=1e-9)
    assert pairs[("B", "A")] == pytest.approx((2.028571428571, -0.285714285714))
    assert pairs[("C", "B")] == pytest.approx((0.237346386170, -0.223911685066))
    assert pairs[("B", "C")] == pytest.approx((4.204797047970, 1.064575645756))


def test_pairs_of_equal_entities_have_no_slope(spark):
    pairs = I.pair_regression(grid(spark, [("m1", "b1", 10), ("m1", "b2", 20), ("m2", "b1", 10), ("m2", "b2", 20)])).collect()
    assert {(r.a, r.b) for r in pairs if r.bk == "b2"} == {(0.0, 20.0)}


def test_worked_example(spark):
    cells = grid(spark, X1)
    want = {
        "mean": {("e2", "C"): (16.25, 16.25), ("e4", "B"): (55.5, 55.5)},
        "bivariate": {("e2", "C"): (9.178631702904, 1.340796359955), ("e4", "B"): (85.363755320453, 2.068338013312)},
        "consolidated": {("e2", "C"): (11.895277692459, 0), ("e4", "B"): (77.580638050377, 0)},
        "multivariate": {("e2", "C"): (8.540582532336, 1.293792740707), ("e4", "B"): (85.418131252633, 2.649752273500)},
    }
    got = {"mean": I.impute_mean(cells), "bivariate": I.impute_bivariate(cells), "consolidated": I.impute_consolidated(cells), "multivariate": V.impute_multivariate(cells, 1)}
    for method, values in want.items():
        found = filled(got[method])
        for cell, pair in values.items():
            assert found[cell] == pytest.approx(pair, abs=1e-6), method


@pytest.mark.parametrize("method", [I.impute_bivariate, I.impute_consolidated, I.impute_mean])
def test_known_cells_stay_and_none_are_null(spark, method):
    out = {(r.entity, r.metric): r for r in method(grid(spark, X1)).collect()}
    assert len(out) == 15
    assert all(r.score is not None and math.isfinite(r.score) for r in out.values())
    assert all(out[(e, m)].score == s and out[(e, m)].source is None for e, m, s in X1)


def test_gaps_without_predictors(spark):
    assert filled(I.impute_bivariate(grid(spark, [("m1", "b1", 10), ("m1", "b2", None), ("m2", "b1", 30), ("m2", "b2", 40)]))) == {("m1", "b2"): (40.0, 40.0)}
    nothing = grid(spark, [("m1", "b1", None), ("m1", "b2", None), ("m2", "b1", None), ("m2", "b2", None)])
    assert set(filled(I.impute_bivariate(nothing)).values()) == {(0.0, 0.0)}
    two = filled(I.impute_bivariate(grid(spark, [("m1", "b1", 50), ("m1", "b2", 60), ("m2", "b1", 70), ("m2", "b2", 80), ("m2", "b3", 90), ("m3", "b1", 30), ("m3", "b3", 50)])))
    assert two == {("m1", "b3"): (70.0, 70.0), ("m3", "b2"): (70.0, 70.0)}


def test_empty(spark):
    assert I.impute_bivariate(grid(spark, [])).count() == 0


def test_bivariate_is_affine_equivariant(spark):
    scaled = [(e, m, s * 3 - 7 if m == "C" else s) for e, m, s in X1]
    a, b = filled(I.impute_bivariate(grid(spark, X1))), filled(I.impute_bivariate(grid(spark, scaled)))
    assert a[("e4", "B")][0] == pytest.approx(b[("e4", "B")][0], rel=1e-9)
    assert a[("e2", "C")][0] * 3 - 7 == pytest.approx(b[("e2", "C")][0], rel=1e-9)


def test_matrices_by_key_are_independent(spark):
    one = grid(spark, X1).withColumn("h", F.lit("a"))
    two = grid(spark, [(e, m, s + 1) for e, m, s in X1]).withColumn("h", F.lit("b"))
    out = I.impute_bivariate(one.unionByName(two), by=["h"])
    got, want = filled(out.where("h = 'a'")), filled(I.impute_bivariate(grid(spark, X1)))
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_second_iteration_estimates_the_same_cells(spark):
    out = filled(I.impute_bivariate(grid(spark, X1), 2))
    assert set(out) == {("e2", "C"), ("e4", "B")}


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    s, known = rng.normal(size=(6, 4)), rng.random((6, 4)) < 0.7
    alpha, beta = rng.normal(size=4), rng.normal(size=(4, 4))
    np.fill_diagonal(beta, 0)
    a, b, w = rng.normal(size=(4, 4)), rng.normal(size=(4, 4)), rng.random((4, 4)) + 0.5
    np.fill_diagonal(w, 0)

    def check(function, parts, free):
        loss, *slopes = function(*parts)
        for k, (x, g) in enumerate(free):
            for place in np.ndindex(x.shape):
                moved = [p.copy() for p in parts]
                at = next(i for i, p in enumerate(parts) if p is x)
                moved[at][place] += 1e-6
                if abs(slopes[k][place]) > 0:
                    assert (function(*moved)[0] - loss) / 1e-6 == pytest.approx(slopes[k][place], rel=1e-3, abs=1e-4)

    check(V.multivariate_slopes, [s, known, alpha, beta], [(alpha, 0), (beta, 0), (s, 0)])
    check(V.consolidated_slopes, [s, known, a, b, w], [(s, 0), (a, 0), (b, 0), (w, 0)])


def test_descents_lower_the_loss(spark):
    rng = np.random.default_rng(2)
    s, known = rng.normal(size=(12, 4)), rng.random((12, 4)) < 0.7
    alpha, beta = np.zeros(4), np.zeros((4, 4))
    out = V.descend_multivariate(s, known, alpha, beta, 30)
    assert np.array_equal(out[known], s[known])
    for method in (V.impute_multivariate_gd, V.impute_consolidated_gd):
        got = {(r.entity, r.metric): r for r in method(grid(spark, X1), 20).collect()}
        assert all(got[(e, m)].score == x for e, m, x in X1)
        assert all(math.isfinite(r.score) for r in got.values())


def test_regressions():
    x = np.array([[1.0, 3, 1], [2, 5, 1], [3, 7, 1], [4, 9.5, 1]])
    model = V.Regressions(x.T @ x, 4)
    want = np.linalg.lstsq(x[:, [0, 2]], x[:, 1], rcond=None)[0]
    assert model.beta[1, [0, 2]] == pytest.approx(want, abs=1e-8)


@pytest.mark.parametrize("kind", ["full", "constant", "copy", "sum", "few"])
def test_regressions_are_least_squares_of_each_metric(kind):
    rng = np.random.default_rng(8)
    s = rng.normal(size=(5 if kind == "few" else 40, 6)) * [1, 10, 0.1, 3, 5, 2] + [0, 5, 1, 0, 100, 2]
    if kind == "constant":
        s[:, 2] = 4
    if kind == "copy":
        s[:, 4] = s[:, 1]
    if kind == "sum":
        s[:, 5] = s[:, 0] - 2 * s[:, 3] + 1
    x = np.hstack([s, np.ones((len(s), 1))])
    model = V.Regressions(x.T @ x, len(s))
    guess, sd = model.predict(x)
    free = len(s) - 6
    for k in range(6):
        rest = [i for i in range(7) if i != k]
        found = np.linalg.lstsq(x[:, rest], x[:, k], rcond=None)[0]
        want = x[:, rest] @ found
        assert guess[:, k] == pytest.approx(want, rel=1e-5, abs=1e-5)
        sigma2 = ((x[:, k] - want) ** 2).sum() / free if free > 0 else 0.0
        spread = sigma2 * (1 + np.einsum("ij,jk,ik->i", x[:, rest], np.linalg.pinv(x[:, rest].T @ x[:, rest]), x[:, rest]))
        assert sd[:, k] ** 2 == pytest.approx(spread, rel=1e-4, abs=1e-6)


def test_stats_and_names(spark):
    obs = frame(spark, [("a", "m", 1), ("b", "m", 1), ("a", "n", 2), ("b", "n", 4), ("a", "", 9)])
    raw = {r.metric: (r.mean, r.std_dev) for r in C.raw_stats(obs).collect()}
    assert raw["m"] == (1.0, 1.0) and raw["n"] == (3.0, 1.0)
    assert {r.metric: r.std_dev for r in C.cell_stats(obs).collect()}["m"] == 0.0
    assert {r.metric: r.n for r in C.metric_counts(obs).collect()} == {"m": 2, "n": 2}
    twice = spark.createDataFrame([("a", "m", 1.0, None, "x", 1), ("a", "m", 2.0, None, "y", 2)], OBS)
    assert [(r.score, r.source) for r in C.last_by_name(twice).collect()] == [(2.0, "y")]
