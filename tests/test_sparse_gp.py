"""Processes through inducing points: all rows as points give the exact process; searches share passes; odd rows."""

from __future__ import annotations

import numpy as np
import pytest

from modalis.operators import gp
from modalis.operators import sparse_gp as G


def rows(spark, x, y, parts=4):
    data = [(k, *map(float, a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data, "i long, " + ", ".join(f"x{k} double" for k in range(x.shape[1])) + ", y double").repartition(parts)


def field(n, seed, d=2):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-2, 2, (n, d))
    return x, np.sin(2 * x[:, 0]) + 0.3 * x[:, -1] + 0.05 * rng.normal(size=n)


@pytest.mark.parametrize("kernel", ["rbf", "matern32", "matern52", "exponential", "rational_quadratic"])
def test_all_rows_as_points_are_the_exact_process(spark, kernel):
    x, y = field(60, 1)
    theta = np.log([1.3, 0.7, 0.9] + [1.5] * gp.KERNELS[kernel][0])
    exact = gp.GaussianProcess(kernel, 0.05).condition(x, y, theta)
    sparse = G.SparseProcess(kernel, 0.05, jitter=1e-8).condition(rows(spark, x, y), ["x0", "x1"], "y", x, theta)
    at = field(40, 2)[0]
    for a, b in zip(sparse.predict(at), exact.predict(at), strict=True):
        assert np.allclose(a, b, atol=2e-4 if kernel == "rbf" else 5e-6)
    assert np.isclose(sparse.value + 0.0, exact.likelihood(theta), atol=1e-3)


def test_fewer_points_bound_the_likelihood_and_come_near(spark):
    x, y = field(400, 3, 1)
    theta = np.log([1.0, 0.6])
    exact = gp.GaussianProcess("rbf", 0.01).condition(x, y, theta)
    df = rows(spark, x, y)
    z = G.inducing_points(df, ["x0"], 25)
    assert z.shape == (25, 1) and {float(v) for v in z.ravel()} <= {float(v) for v in x.ravel()}
    sparse = G.SparseProcess("rbf", 0.01).condition(df, ["x0"], "y", z, theta)
    assert sparse.value >= exact.likelihood(theta) - 1e-2
    assert np.abs(sparse.predict(x)[0] - exact.predict(x)[0]).max() < 0.02


def test_restarts_share_passes_and_find_the_scale(spark):
    x, y = field(800, 4, 1)
    df = rows(spark, x, y)
    p = G.SparseProcess("rbf", None, restarts=3, rounds=14).fit(df, ["x0"], "y", np.linspace(-2, 2, 20)[:, None], seed=5)
    assert p.passes == 14
    assert 0.001 < p.sigma2 < 0.006 and 0.3 < p.scale[0] < 3
    assert np.sqrt(((p.predict(x)[0] - y) ** 2).mean()) < 0.06


def test_fidelities_with_all_rows_as_points(spark):
    x, y = field(50, 6, 1)
    high = 1.7 * y + 0.2 * x[:, 0]
    theta = np.log([1.0, 0.8])
    exact = gp.MultiFidelity("rbf", 0.01).fit([x, x[:20]], [y, high[:20]], theta)
    sparse = G.SparseFidelities("rbf", 0.01, 1e-8).fit([rows(spark, x, y), rows(spark, x[:20], high[:20])], ["x0"], "y", [x, x[:20]], theta)
    for a, b in zip(sparse.predict(x), exact.predict(x), strict=True):
        assert np.allclose(a, b, atol=1e-5)


def test_gaps_are_left_out_and_predicted_as_null(spark):
    x, y = field(30, 7, 1)
    df = rows(spark, x, y)
    odd = df.unionByName(spark.createDataFrame([(100, None, 1.0), (101, 0.5, None), (102, float("nan"), 2.0)], df.schema))
    a, b = (G.SparseProcess("rbf", 0.1).condition(d, ["x0"], "y", x[:5], np.log([1.0, 1.0])) for d in (df, odd))
    assert np.allclose(a.weights, b.weights, atol=1e-9)
    got = {r.i: (r.mean, r.std) for r in a.predict_rows(odd.select("i", "x0"), ["x0"]).collect()}
    assert got[100] == got[102] == (None, None) and got[101][0] is not None and len(got) == 33
