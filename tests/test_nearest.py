"""Nearest points by a grid against all distances: ties, crowds, flat and far places."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from modalis import registry
from modalis.operators import mesh as G


def table_of(spark, name, x):
    return spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], f"{name} bigint, x double, y double, z double").repartition(5)


def brute(points, sensors):
    out = {}
    for k, s in enumerate(sensors):
        d = ((points - s) ** 2).sum(axis=1)
        out[k] = (int(np.argmin(d)), float(d.min()))
    return out


def check(spark, points, sensors):
    got = {r.sensor: (r.point_id, r.d2) for r in G.nearest_on_grid(table_of(spark, "point_id", points), table_of(spark, "sensor", sensors)).collect()}
    want = brute(points, sensors)
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and np.isclose(got[k][1], want[k][1]) for k in want)


CASES = {
    "even": lambda r: (r.uniform(-1, 1, (800, 3)), r.uniform(-1.5, 1.5, (300, 3))),
    "ties": lambda r: (r.integers(0, 4, (300, 3)), r.integers(-1, 6, (200, 3)) / 1.0),
    "crowd": lambda r: (np.vstack([np.zeros((300, 3)), 1e-3 * r.normal(size=(200, 3)), 100 * r.normal(size=(20, 3))]), np.vstack([r.normal(size=(100, 3)), 80 * r.normal(size=(100, 3))])),
    "flat": lambda r: (np.column_stack([r.uniform(0, 9, 400), r.uniform(0, 1, 400), np.full(400, 2.0)]), r.uniform(-20, 20, (150, 3))),
    "line": lambda r: (np.column_stack([r.uniform(0, 9, 100), np.zeros(100), np.zeros(100)]), r.uniform(-2, 12, (100, 3))),
    "one place": lambda r: (np.ones((5, 3)), r.normal(size=(20, 3))),
    "one far": lambda r: (np.vstack([r.uniform(0, 1, (50, 3)), [[1e6, 0, 0]]]), np.vstack([r.uniform(0, 1, (20, 3)), [[4e5, 0, 0], [6e5, 0, 0], [1e9, 1, 1]]])),
}


@pytest.mark.parametrize("case", CASES)
def test_nearest_points(spark, case):
    points, sensors = CASES[case](np.random.default_rng(3))
    check(spark, np.asarray(points, float), np.asarray(sensors, float))


def test_many_sensors_over_a_given_table(spark):
    """A hundred thousand sensors over the parts' mesh; those of one in a hundred against all distances."""
    part = spark.read.parquet("/root/testdata/sf0.1/part.parquet").selectExpr("p_partkey AS point_id", "p_partkey div 100 * 1.0D AS x", "p_size * 1.0D AS y", "p_retailprice / 100 AS z")
    sensors = spark.range(100_000).selectExpr("id AS sensor", "pmod(xxhash64(id, 1), 2100) / 10.0D - 5 AS x", "pmod(xxhash64(id, 2), 600) / 10.0D - 5 AS y", "pmod(xxhash64(id, 3), 200) / 100.0D + 8.5 AS z")
    got = {r.sensor: r for r in G.nearest_on_grid(part, sensors).collect()}
    assert len(got) == 100_000
    p = np.array(part.orderBy("point_id").collect())
    for s in sensors.filter("sensor % 100 = 0").collect():
        d = ((p[:, 1:] - np.array(s[1:])) ** 2).sum(axis=1)
        assert np.isclose(got[s.sensor].d2, d.min()) and np.isclose(d[int(got[s.sensor].point_id)], d.min())


def test_no_points_no_sensors_and_gaps(spark):
    p, s = table_of(spark, "point_id", np.ones((3, 3))), table_of(spark, "sensor", np.ones((2, 3)))
    assert G.nearest_on_grid(p.limit(0), s).count() == 0 and G.nearest_on_grid(p, s.limit(0)).count() == 0
    odd = p.unionByName(spark.createDataFrame([(0, None, 1.0, 1.0)], p.schema))
    assert {(r.sensor, r.point_id, r.d2) for r in G.nearest_on_grid(odd, s).collect()} == {(0, 0, 0.0), (1, 0, 0.0)}


def test_rounded_distances_are_ties(spark):
    """Of points whose squared distances are equal to nine places the first counts, though another is nearer by a rounding."""
    points = np.array([[1.0 + 1e-12, 0, 0], [-1.0, 0, 0], [0, 1.0 - 1e-12, 0], [5, 5, 0]])
    sensor = table_of(spark, "sensor", np.zeros((1, 3)))
    assert [r.point_id for r in G.nearest_on_grid(table_of(spark, "point_id", points), sensor, 9).collect()] == [0]
    assert [r.point_id for r in G.nearest_on_grid(table_of(spark, "point_id", points), sensor).collect()] == [2]


def test_looks_of_many_sensors_go_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(G, "LOOKS", 500)
    monkeypatch.setattr(G, "FEW_LOOKS", 1000)
    made, repartition = [], type(spark.range(0)).repartition
    monkeypatch.setattr(type(spark.range(0)), "repartition", lambda df, n, *c: (made.append(n), repartition(df, n, *c))[1])
    r = np.random.default_rng(8)
    check(spark, r.uniform(-1, 1, (500, 3)), r.uniform(-1, 1, (400, 3)))
    assert max(made) >= 400 * 27 // 500


def test_looks_of_many_sensors_are_not_broadcast(spark, monkeypatch, tmp_path):
    """Sensors of a small file, whose size the planner takes for that of their looks."""
    monkeypatch.setattr(G, "FEW_LOOKS", 1000)
    plans, keep = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df, *a: (plans.append(df._jdf.queryExecution().executedPlan().toString()), keep(df, *a))[1])
    r = np.random.default_rng(9)
    for name, n in (("point_id", 500), ("sensor", 400)):
        table_of(spark, name, r.uniform(-1, 1, (n, 3))).write.parquet(f"{tmp_path}/{name}")
    G.nearest_on_grid(*(spark.read.parquet(f"{tmp_path}/{name}") for name in ("point_id", "sensor")))
    looks = [p for p in plans if "REPARTITION_BY_NUM" in p]
    assert looks and not any("BroadcastExchange" in p for p in looks)


def test_keys_with_gaps_and_customers_without_a_balance(spark, tmp_path):
    """Parts lie where their keys say, not where their number does."""
    spark.range(300).selectExpr("id * 7 + id div 100 * 1000 AS p_partkey", "cast(id % 50 + 1 AS int) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(400).selectExpr("id * 3 AS c_custkey", "CASE WHEN id % 90 <> 5 THEN pmod(xxhash64(id), 1100000) / 100.0D - 1000 END AS c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    c = duckdb.connect()
    for name in ("part", "customer"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = c.sql(registry.ORACLE_SQL["nearest_sensor"]).fetchall()
    got = registry.QUERIES["nearest_sensor"](spark, str(tmp_path)).select("sensor", "point_id", "d2").collect()
    assert len(want) == 400 and sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
