"""Paths of elastic-net fits and least squares from triangular factors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strucreg.operators import linear, paths, search


def _moments(seed, n=300, d=25, targets=3):
    """Columns that nearly depend on each other, some that are the same and one that is constant."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + 0.05 * rng.normal(size=(n, d))
    x[:, 3], x[:, 4] = x[:, 2], 1.0
    x = (x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-9)
    y = x @ np.where(rng.random((d, targets)) < 0.3, rng.normal(size=(d, targets)), 0) + 0.5 * rng.normal(size=(n, targets))
    y = (y - y.mean(axis=0)) / y.std(axis=0)
    return paths.Moments(x.T @ x / n, x.T @ y / n, np.mean(y * y, axis=0))


def _loss(m, w, alpha, ratio):
    squared = m.yy - 2 * np.sum(m.xy * w, axis=0) + np.sum(w * (m.xx @ w), axis=0)
    return 0.5 * squared + alpha * ratio * np.abs(w).sum(axis=0) + 0.5 * alpha * (1 - ratio) * np.sum(w * w, axis=0)


ALPHAS = np.exp(np.linspace(np.log(1e-3), np.log(100), 70))
RATIOS = np.random.default_rng(0).random(70)


@pytest.mark.parametrize("seed", range(3))
def test_screening_changes_no_answer(seed):
    m = _moments(seed)
    plain, _ = paths.elastic_path(m, ALPHAS, RATIOS, gap=0.0, screen=False)
    screened, ended = paths.elastic_path(m, ALPHAS, RATIOS, gap=0.0)
    assert ended.all()
    for a, r, p, s in zip(ALPHAS, RATIOS, plain, screened):
        assert np.allclose(_loss(m, p, a, r), _loss(m, s, a, r), atol=1e-11)
        if a > 0.01:
            assert np.allclose(p, s, atol=1e-7)
    # the conditions of the optimum, feature by feature
    for a, r, w in zip(ALPHAS, RATIOS, screened):
        slope = m.xy - m.xx @ w - a * (1 - r) * w
        assert np.all(np.abs(slope) <= a * r + 1e-7) and np.allclose(slope[w != 0], (a * r * np.sign(w))[w != 0], atol=1e-7)


@pytest.mark.parametrize("seed", range(3))
def test_the_gap_bounds_what_is_left(seed):
    m = _moments(seed)
    best, _ = paths.elastic_path(m, ALPHAS, RATIOS, gap=0.0)
    early, ended = paths.elastic_path(m, ALPHAS, RATIOS, gap=1e-4)
    assert ended.all()
    for a, r, p, q in zip(ALPHAS, RATIOS, best, early):
        left = _loss(m, q, a, r) - _loss(m, p, a, r)
        assert np.all(left <= 1e-4 * m.yy + 1e-12) and np.all(left >= -1e-10)
        gaps = paths.duality_gaps(m.xx, m.xy, m.yy, q, m.xx @ q, np.full(3, a * r), np.full(3, a * (1 - r)))[:2]
        assert np.all(gaps[0] >= left - 1e-12) and np.all(gaps[1] >= left - 1e-12)


def test_paths_take_trials_in_any_order_and_without_a_penalty_of_either_kind():
    m = _moments(5)
    order = np.random.default_rng(1).permutation(70)
    there, _ = paths.elastic_path(m, ALPHAS, RATIOS, gap=0.0)
    mixed, _ = paths.elastic_path(m, ALPHAS[order], RATIOS[order], gap=0.0)
    assert np.allclose(there[order][ALPHAS[order] > 0.01], mixed[ALPHAS[order] > 0.01], atol=1e-7)
    ridge, _ = paths.elastic_path(m, [0.5, 2.0], [0.0, 0.0], gap=0.0)
    assert np.allclose(ridge, paths.ridge_path(m.xx, m.xy, [0.5, 2.0]), atol=1e-8)
    assert not paths.elastic_path(m, [0.001], [1.0], gap=0.0, max_iter=2)[1].any()


def test_a_thousand_trials_equal_one_by_one(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 6))
    y = x @ rng.normal(size=(6, 2)) + rng.normal(size=(200, 2))
    df = spark.createDataFrame([([float(v) for v in a], float(b), float(c), i % 3) for i, (a, (b, c)) in enumerate(zip(x, y))], "features array<double>, y0 double, y1 double, fold int")
    products = linear.cross_products(df, "features", ["y0", "y1"], F.col("fold"))
    for family in ("ridge", "lasso", "elastic_net"):
        log, best, model = search.search_linear(spark, products, family, 150, gap=0.0)
        rows = log.orderBy("trial").collect()
        assert [r["trial"] for r in rows] == list(range(150))
        for r in rows[::30]:
            params = {k: float(v) for k, v in r["params"].items()}
            errors = [
                float(np.mean(held.squared_errors(linear.FAMILIES[family](linear.added(products) - held, params, 0.0)))) for held in products.values()
            ]
            assert np.isclose(r["value"], np.mean(errors), rtol=1e-8)
        assert np.allclose(model.coef, linear.FAMILIES[family](linear.added(products), best, 0.0).coef)


@pytest.mark.parametrize("condition", [1e3, 1e7])
def test_least_squares_keeps_its_digits(spark, condition):
    """At a condition of 1e7 the cross products have no digit left of the smallest direction; the factor has."""
    rng = np.random.default_rng(4)
    u, _ = np.linalg.qr(rng.normal(size=(500, 5)))
    v, _ = np.linalg.qr(rng.normal(size=(5, 5)))
    x = (u - u.mean(axis=0)) @ np.diag(np.geomspace(1, 1 / condition, 5)) @ v + np.arange(5)
    y = x @ np.ones(5) + 3
    df = spark.createDataFrame([([float(a) for a in r], float(t)) for r, t in zip(x, y)], "features array<double>, y double").repartition(7)
    model = linear.least_squares(df, "features", ["y"])
    assert np.allclose(model.coef[:, 0], 1, atol=1e-6) and np.isclose(model.intercept[0], 3, atol=1e-6)


def test_least_squares_is_shortest_and_reads_any_partitioning(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 4))
    x = np.column_stack([x, x[:, 0] + x[:, 1], np.zeros(300), np.full(300, 2.0)])
    y = x[:, :2] @ rng.normal(size=(2, 2)) + rng.normal(size=(300, 2))
    df = spark.createDataFrame([([float(a) for a in r], float(a), float(b)) for r, (a, b) in zip(x, y)], "features array<double>, y0 double, y1 double")
    expected = np.linalg.pinv(x - x.mean(axis=0), rcond=1e-10) @ (y - y.mean(axis=0))
    for n in (1, 9, 40):
        model = linear.least_squares(df.repartition(n), "features", ["y0", "y1"])
        assert np.allclose(model.coef, expected, atol=1e-9)
        assert np.allclose(model.intercept, y.mean(axis=0) - x.mean(axis=0) @ expected, atol=1e-9)
    one = linear.least_squares(df.limit(1), "features", ["y0", "y1"])
    assert np.allclose(one.coef, 0) and np.isclose(one.intercept[0], df.limit(1).first()["y0"])
    with pytest.raises(ValueError):
        linear.least_squares(df.limit(0), "features", ["y0"])
