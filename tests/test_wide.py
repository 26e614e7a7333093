"""Panels of columns against NumPy, near-dependent columns, and least squares without squared condition numbers."""

from __future__ import annotations

import numpy as np
import pytest

from modalis.functions import matrix as M
from modalis.operators import linalg as L
from modalis.operators import wide


def table_of(spark, x, parts=3):
    return M.of_width(spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "row_id bigint, x array<double>").repartition(parts), x.shape[1])


def factors(rows, panel):
    q, r = wide.panel_qr(rows, panel)
    n = M.width(rows)
    full = np.zeros((n, n))
    for e in r.collect():
        full[e.i, e.at : e.at + len(e.x)] = e.x
    return np.array([t.x for t in q.orderBy("row_id").collect()]), full


@pytest.mark.parametrize(("shape", "panel"), [((60, 23), 5), ((60, 23), 23), ((40, 40), 16), ((9, 7), 1)])
def test_panels(spark, shape, panel):
    x = np.random.default_rng(1).normal(size=shape)
    q, r = factors(table_of(spark, x), panel)
    assert np.allclose(q @ r, x) and np.allclose(q.T @ q, np.eye(shape[1]), atol=1e-12)
    assert np.allclose(r, np.triu(r), atol=1e-10) and np.allclose(r.T @ r, x.T @ x)


def test_close_columns_stay_orthonormal(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 1)) + 1e-7 * rng.normal(size=(80, 24))
    q, r = factors(table_of(spark, x), 6)
    assert np.abs(q.T @ q - np.eye(24)).max() < 1e-8 and np.allclose(q @ r, x, atol=1e-12)


def test_dependent_columns_and_more_columns_than_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 6)) @ rng.normal(size=(6, 20))
    x[:, 3] = 0
    q, r = factors(table_of(spark, x), 7)
    assert np.allclose(q @ r, x, atol=1e-9)
    w = rng.normal(size=(12, 30))
    q, r = factors(table_of(spark, w), 8)
    assert np.allclose(q @ r, w, atol=1e-9)
    assert wide.panel_qr(table_of(spark, w).limit(0), 8)[0].count() == 0


def test_the_driver_refuses_only_what_is_too_large(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(40, 30))
    rows = table_of(spark, x)
    monkeypatch.setattr(L, "DRIVER_COLUMNS", 16)
    with pytest.raises(ValueError):
        L.tsqr(rows)
    q, r = factors(rows, 8)  # 30 x 8 numbers at a time
    assert np.allclose(q @ r, x)
    u, s, vt = L.randomized_svd(rows, 6, 2, 1)
    assert np.allclose(s[:3], np.linalg.svd(x, compute_uv=False)[:3], rtol=0.1)


def test_least_squares_of_nearly_dependent_terms(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(200, 1)) + 1e-6 * rng.normal(size=(200, 3))
    y = a @ [1.0, -2.0, 3.0]
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(a, y, strict=True)] + [(None, 1.0, 1.0, 1.0)], "a double, b double, c double, y double")
    assert np.allclose(L.least_squares(df, ["a", "b", "c"], "y"), [1, -2, 3], atol=1e-6)  # normal equations miss by far
    got = L.ridge_regression(df, ["a", "b", "c"], "y", 0.5)
    assert np.allclose(got, np.linalg.solve(a.T @ a + 0.5 * np.eye(3), a.T @ y), atol=1e-6)
