"""Tiles against NumPy: nearest columns with ties, products, and embeddings by landmarks against the whole."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from modalis.functions import matrix as M
from modalis.operators import manifold, tiles


def table_of(spark, x, parts=3, first=0):
    return M.of_width(spark.createDataFrame([(first + k, [float(v) for v in r]) for k, r in enumerate(x)], "row_id bigint, x array<double>").repartition(parts), x.shape[1])


def brute(x, k):
    d = ((x[:, :, None] - x[:, None, :]) ** 2).sum(axis=0)
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return {i: [(float(np.sqrt(d[i, j])), int(j)) for j in js] for i, js in enumerate(order)}


@pytest.mark.parametrize(("columns", "block"), [(37, 8), (37, 37), (37, 100), (16, 8), (1, 4), (2, 1)])
def test_nearest_columns_with_ties(spark, columns, block):
    x = np.random.default_rng(1).integers(0, 3, (50, columns)).astype(float)  # many equal distances and columns
    x[:, : columns // 2] = x[:, :1]
    got = {r.i: [(n.d, n.j) for n in r.near] for r in tiles.nearest(table_of(spark, x), 5, block).collect()}
    want = {i: v[: min(5, columns - 1)] for i, v in brute(x, 5).items() if columns > 1}
    assert {i: [j for _, j in v] for i, v in got.items()} == {i: [j for _, j in v] for i, v in want.items()}
    assert all(np.allclose(got[i], want[i]) for i in want)
    assert tiles.nearest(table_of(spark, x).limit(0), 5, block).count() == 0


def test_twenty_thousand_columns(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6, 20_000))
    near = tiles.nearest(table_of(spark, x), 3, 1024)
    some = {r.i: [n.j for n in r.near] for r in near.filter(F.col("i") % 997 == 0).collect()}
    for i, got in some.items():
        d = ((x - x[:, i : i + 1]) ** 2).sum(axis=0)
        d[i] = np.inf
        assert got == np.argsort(d, kind="stable")[:3].tolist()


@pytest.mark.parametrize(("shape", "block", "first"), [((30, 25, 20), 8, 0), ((5, 40, 3), 16, 100), ((33, 7, 50), 64, 3)])
def test_products_of_tiles(spark, shape, block, first):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=shape[:2]), rng.normal(size=shape[1:])
    got = {r.row_id: r.x for r in tiles.matmul(table_of(spark, a, first=first), table_of(spark, b), block).collect()}
    assert np.allclose(np.array([got[first + k] for k in range(len(a))]), a @ b) and len(got) == len(a)
    sparse = table_of(spark, b).filter("row_id <> 2 and row_id < 5")
    b[[2, *range(5, len(b))]] = 0
    got = {r.row_id: r.x for r in tiles.matmul(table_of(spark, a, first=first), sparse, block).collect()}
    assert np.allclose(np.array([got[first + k] for k in range(len(a))]), a @ b)
    assert tiles.matmul(table_of(spark, a).limit(0), table_of(spark, b), block).count() == 0


def test_what_a_product_shuffles(spark, tmp_path):
    """Each factor goes out as often as the other one has blocks: rows of A times blocks of B's columns times inner blocks, and so on."""
    rng = np.random.default_rng(4)
    a, b, block = rng.normal(size=(40, 32)), rng.normal(size=(32, 24)), 8
    out = tiles.matmul(table_of(spark, a, 1), table_of(spark, b, 1), block)
    plan = out._jdf.queryExecution()
    sent = [p for p in re.findall(r"Exchange hashpartitioning\(i", plan.executedPlan().toString())]
    assert sent
    logical = plan.optimizedPlan().toString()
    assert "Join" not in logical  # pieces meet by their tile, nothing is multiplied by a join
    assert spark.createDataFrame(out.rdd, out.schema).count() == 40


def test_all_snapshots_as_landmarks_are_isomap(spark):
    t = np.linspace(0, 3, 45)
    x = np.vstack([np.cos(t), np.sin(t), t, 0.1 * np.cos(9 * t)])
    rows = table_of(spark, x)
    want, residual, edges, members = manifold.isomap(rows, 2, 4)
    got, r, e = manifold.landmark_isomap(rows, 2, 4, block=16)
    y = {p.node: p.y for p in got.collect()}
    assert sorted(y) == members.tolist() and np.allclose(np.array([y[int(m)] for m in members]).T, want, atol=1e-8)
    assert np.isclose(r, residual, atol=1e-9)
    pairs = {(p.i, p.j): p.d for p in e.collect()}
    finite = {(i, j): edges[i, j] for i, j in zip(*np.nonzero(np.isfinite(edges)), strict=True) if i != j}
    assert pairs.keys() == finite.keys() and all(np.isclose(pairs[k], finite[k]) for k in pairs)


def test_few_landmarks_come_near_and_components_are_kept_apart(spark):
    t = np.linspace(0, 4, 80)
    x = np.vstack([np.cos(t), np.sin(t), t])
    far = np.hstack([x, x[:, :9] + 1000])
    rows = table_of(spark, far)
    got, residual, _ = manifold.landmark_isomap(rows, 1, 4, landmarks=20, block=32)
    y = {p.node: p.y[0] for p in got.collect()}
    assert sorted(y) == list(range(80)) and residual < 1e-3
    line = np.array([y[k] for k in range(80)])
    assert abs(np.corrcoef(line, t)[0, 1]) > 0.9999
    other, _, _ = manifold.landmark_isomap(rows, 1, 4, component=2, block=32)
    assert sorted(p.node for p in other.collect()) == list(range(80, 89))
    assert manifold.landmark_isomap(rows, 1, 4, component=7, block=32)[0].count() == 80


def test_paths_of_a_chain_and_of_no_edges(spark):
    edges = spark.createDataFrame([(k, k + 1, 1.0) for k in range(20)] + [(k + 1, k, 1.0) for k in range(20)] + [(0, 20, 50.0), (20, 0, 50.0)], "i bigint, j bigint, d double")
    sources = spark.createDataFrame([(0,), (7,), (0,)], "source bigint")
    got = {(r.node, r.source): r.d for r in manifold.paths_from(edges, sources).collect()}
    assert got == {(n, s): float(abs(n - s)) for n in range(21) for s in (0, 7)}
    assert [tuple(r) for r in manifold.paths_from(edges.limit(0), sources).sort("node").collect()] == [(0, 0, 0.0), (7, 7, 0.0)]


@pytest.mark.parametrize(("n", "block"), [(300, 64), (300, 1000), (5, 2), (1, 8)])
def test_nearest_vectors_with_ties_and_odd_ones(spark, n, block):
    x = np.random.default_rng(5).integers(0, 3, (n, 4)).astype(float) + 1e6
    x[2 * n // 3 :] = x[: n - 2 * n // 3]
    if n > 9:
        x[7], x[8, 1] = np.nan, np.inf
    rows = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "i bigint, x array<double>").repartition(3)
    got = {r.i: [(n.d, n.j) for n in r.near] for r in tiles.nearest_vectors(rows, 5, block).collect()}
    with np.errstate(invalid="ignore"):
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = {}
    for i in range(n):
        order = [j for j in np.lexsort((np.arange(n), d[i])) if j != i][:5]
        want[i] = [(d[i, j], j) for j in order]
    assert {i: [j for _, j in v] for i, v in got.items()} == {i: [j for _, j in v] for i, v in want.items() if n > 1}
    assert all(np.allclose(got[i], want[i], equal_nan=True) for i in got)


def test_vectors_go_out_a_bounded_number_of_times(spark):
    """Blocks grow with the vectors, so that what is shuffled grows with them and not with their square."""
    rows = spark.range(4000).select("id", F.array(*(F.rand(k).cast("float") for k in range(4))).alias("x")).toDF("i", "x")
    plan = tiles.nearest_vectors(rows, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert tiles.LEAST_BLOCKS * tiles.VECTORS >= 100_000 and rows.count() == tiles.nearest_vectors(rows, 2).count()


@pytest.mark.parametrize(("block", "share"), [(40, None), (16, 4096)])
def test_rows_of_a_tile_are_shared_by_tasks(spark, monkeypatch, block, share):
    """Columns of one block are compared where their rows are, and many rows of several blocks by several tasks."""
    if share:
        monkeypatch.setattr(tiles, "TILE_BYTES", share)
    x = np.random.default_rng(6).integers(0, 9, (900, 40)).astype(float)
    near = tiles.nearest(table_of(spark, x, 6), 3, block)
    sent = re.findall(r"hashpartitioning\(([^)]*)\)", near._jdf.queryExecution().executedPlan().toString())
    assert any("first" in s for s in sent) and (any("part" in s for s in sent) if share else not any("part" in s for s in sent))
    want = brute(x, 3)
    assert {r.i: [n.j for n in r.near] for r in near.collect()} == {i: [j for _, j in v] for i, v in want.items()}
