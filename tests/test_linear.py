"""Linear models from sums against direct fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from streetgrid.operators import linear

N, D = 400, 7


@pytest.fixture(scope="module")
def data(spark):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(N, D)) @ rnd.normal(size=(D, D)) + 3
    x[:, 5] = 2 * x[:, 1] - 1
    y = x @ np.array([1.0, -2, 0, 0, 0.5, 0, 0]) + rnd.normal(size=N) + 10
    w, fold = rnd.random(N) + 0.5, rnd.integers(0, 5, N)
    rows = [(i, x[i].tolist(), float(y[i]), float(w[i]), int(fold[i])) for i in range(N)]
    odd = [(N, None, 1.0, 1.0, 0), (N + 1, [1.0] * D, None, 1.0, 0), (N + 2, [float("nan")] * D, 1.0, 1.0, 1), (N + 3, [1.0] * D, float("inf"), 1.0, 1)]
    df = spark.createDataFrame(rows + odd, "id long, x array<double>, y double, w double, fold int").repartition(6)
    return df, x, y, w, fold


def ridge(x, y, alpha, w=None):
    w = np.ones(len(y)) if w is None else w
    mx, my = np.average(x, axis=0, weights=w), np.average(y, weights=w)
    r = np.sqrt(w)[:, None]
    a = np.vstack([r * (x - mx), np.sqrt(alpha) * np.eye(x.shape[1])])
    b = np.linalg.lstsq(a, np.r_[r[:, 0] * (y - my), np.zeros(x.shape[1])], rcond=1e-10)[0]
    return b, my - mx @ b


def test_sums_and_weighted_fits(data):
    df, x, y, w, _ = data
    s = linear.sums(df, "x", "y", "w")[0]
    z = np.column_stack([x, y, np.ones(N)])
    assert np.allclose(s.products, z.T @ (z * w[:, None]), rtol=1e-12)
    for alpha, fit in [(0.0, linear.least_squares(s)), *zip((0.01, 10.0), linear.ridge_path(s, (0.01, 10.0)), strict=True)]:
        b, i = ridge(x, y, alpha, w)
        assert np.allclose(fit.coef, b, atol=1e-6) and fit.intercept == pytest.approx(i, abs=1e-5)


def test_search_by_folds(data):
    df, x, y, _, fold = data
    found = linear.ridge_by_folds(linear.sums(df, "x", "y", fold="fold"))
    want = np.zeros((5, 30))
    for f in range(5):
        own = fold == f
        for k, a in enumerate(linear.RIDGE_PATH):
            b, i = ridge(x[~own], y[~own], a)
            want[f, k] = 1 - ((y[own] - x[own] @ b - i) ** 2).sum() / ((y[own] - y[own].mean()) ** 2).sum()
    assert np.allclose(found.scores, want, atol=1e-8)
    assert found.alpha == linear.RIDGE_PATH[want.mean(axis=0).argmax()]
    assert np.allclose(found.fit.coef, ridge(x, y, found.alpha)[0], atol=1e-8)


def test_search_by_leaving_one_out(data):
    df, x, y, *_ = data
    found = linear.ridge_leave_one_out(df, "x", "y")
    for k, a in enumerate(linear.PROBE_ALPHAS):
        errors = []
        for i in range(0, N):
            rest = np.arange(N) != i
            b, c = ridge(x[rest], y[rest], a)
            errors.append(y[i] - x[i] @ b - c)
        assert found.scores[k] == pytest.approx(np.mean(np.square(errors)), rel=1e-9)
    assert found.alpha == linear.PROBE_ALPHAS[int(found.scores.argmin())]
    got = df.filter("id < 5").orderBy("id").select(found.fit.predict("x").alias("p")).collect()
    assert [r["p"] for r in got] == pytest.approx((x[:5] @ found.fit.coef + found.fit.intercept).tolist())


@pytest.mark.parametrize("l1", [0.1, 0.5, 1.0])
def test_elastic_net(data, l1):
    """A minimum of the definition: every slope is within the penalty, and all are on the path."""
    df, x, y, *_ = data
    s = linear.sums(df, "x", "y")[0]
    alphas = [1.0, 0.1, 0.01]
    for a, fit in zip(alphas, linear.elastic_path(s, alphas, l1), strict=True):
        slope = (x - x.mean(axis=0)).T @ (y - x @ fit.coef - fit.intercept) / N - a * (1 - l1) * fit.coef
        used = fit.coef != 0
        assert np.allclose(slope[used], a * l1 * np.sign(fit.coef[used]), atol=1e-6)
        assert (np.abs(slope[~used]) <= a * l1 + 1e-6).all()
    strongest = linear.elastic_net(s, 1e6, 1.0)
    assert (strongest.coef == 0).all() and strongest.intercept == pytest.approx(y.mean())


def test_flat_and_empty(spark):
    flat = spark.createDataFrame([([1.0, float(i)], 2.0) for i in range(6)], "x array<double>, y double")
    s = linear.sums(flat, "x", "y")[0]
    assert np.allclose(linear.least_squares(s).coef, 0) and np.isnan(s.r2(linear.least_squares(s)))
    assert np.allclose(linear.elastic_net(s, 0.1, 0.5).coef, 0)
    assert linear.sums(flat.filter(F.lit(False)), "x", "y") == {}
