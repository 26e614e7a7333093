"""Training over rows: slopes against differences, steps against NumPy on one machine, line searches, batches, odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from modalis.operators import surrogates as S
from modalis.operators import training as T

NETS = [T.Dense((2, 4, 3, 1)), T.Functions((2, 3, 1), 3), T.Functions((2, 2, 1), 2, "sine"), T.Dense((2, 1, 2)), T.Variational(2, 3, 2, 0.1)]


def data(n, seed, net):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-1, 1, (n, 2))
    if isinstance(net, T.Variational):
        return x, rng.normal(size=(n, 2))
    return x, x if net.sizes[-1] == 2 else (np.sin(2 * x[:, :1]) + x[:, 1:] ** 2)


def table_of(spark, x, y, parts=5):
    rows = [(k, *map(float, a), *map(float, b)) for k, (a, b) in enumerate(zip(x, y, strict=True))]
    names = [f"x{k}" for k in range(x.shape[1])], [f"y{k}" for k in range(y.shape[1])]
    df = spark.createDataFrame(rows, "i long, " + ", ".join(f"{n} double" for n in sum(names, []))).repartition(parts)
    return T.samples(df, *names)


@pytest.mark.parametrize("net", NETS)
def test_slopes_are_differences(net):
    x, y = data(7, 1, net)
    theta = net.start(2)
    _, g = net.slopes(theta, x, y)
    for k in range(len(theta)):
        step = np.zeros_like(theta)
        step[k] = 1e-6
        assert np.isclose((net.slopes(theta + step, x, y)[0] - net.slopes(theta - step, x, y)[0]) / 2e-6, g[k], rtol=1e-5, atol=1e-7)


@pytest.mark.parametrize("net", NETS)
def test_steps_equal_one_machine(spark, net):
    x, y = data(300, 3, net)
    got = T.adam(table_of(spark, x, y), net, 6, T.Adam(0.05, 0.5, 3), seed=4)
    theta, m, v = net.start(4), 0, 0
    for t in range(1, 7):
        _, g = net.slopes(theta, x, y)
        g = g / len(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.05 * 0.5 ** ((t - 1) // 3) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert np.allclose(got.theta, theta, atol=1e-8, rtol=0)


def test_a_line_search_is_one_pass_and_learns(spark, monkeypatch):
    net = T.Dense((2, 6, 1))
    x, y = data(400, 5, net)
    passes = []
    old = T.evaluated
    monkeypatch.setattr(T, "evaluated", lambda rows, trials: passes.append(len(trials)) or old(rows, trials))
    got = T.lbfgs(table_of(spark, x, y), net, 25)
    assert passes[0] == 1 and set(passes[1:]) == {8} and len(passes) <= 26
    assert got.losses[-1] < 0.05 * got.losses[0] and got.losses == sorted(got.losses, reverse=True)
    assert np.isclose(((got.predict(x) - y) ** 2).mean(), got.losses[-1])


def test_batches_hold_every_row_once_and_early_stop_keeps_the_best(spark):
    net = T.Dense((2, 5, 1))
    x, y = data(500, 6, net)
    rows = table_of(spark, x, y)
    parts = T.dealt(rows, 4)
    assert sorted(tuple(r.x) for p in parts for r in p.collect()) == sorted(map(tuple, x.tolist()))
    assert all(50 < p.count() < 200 for p in parts)
    assert all("PartitionFilters: [isnotnull(batch" in p._jdf.queryExecution().toString() for p in parts)
    got = T.adam(rows, net, 12, T.Adam(0.2), batches=4, valid=table_of(spark, *data(100, 7, net)), stop=S.EarlyStop(2))
    best = min(got.held)
    assert np.isclose(T.evaluated(table_of(spark, *data(100, 7, net)), [(net, got.theta)])[0][0], best)
    assert len(got.held) < 12 or got.held[-3:] != sorted(got.held[-3:]) or best in got.held


def test_rows_with_gaps_are_left_out(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (float("nan"), 1.0), (1.0, None), (float("inf"), 0.0), (2.0, 4.0)], "a double, b double")
    assert T.samples(df, ["a"], ["b"]).count() == 2
    net = T.Dense((1, 1))
    loss, g = T.evaluated(T.samples(df, ["a"], ["b"]), [(net, np.zeros(2))])[0]
    assert loss == 10 and g.tolist() == [-10, -6]
    with pytest.raises(ValueError):
        T.evaluated(T.samples(df.limit(0), ["a"], ["b"]), [(net, np.zeros(2))])


def test_noise_hangs_on_its_seeds_and_is_normal(spark):
    d = spark.range(4000).select(T.noise(F.col("id"), F.lit(3), latent=2).alias("z"))
    z = np.array([r.z for r in d.collect()])
    assert np.array_equal(z, np.array([r.z for r in d.repartition(7).sort("z").collect()])[np.argsort(np.lexsort(z.T[::-1]))]) or len({tuple(v) for v in z}) == 4000
    assert np.abs(z.mean(axis=0)).max() < 0.06 and np.abs(z.std(axis=0) - 1).max() < 0.05 and abs(np.corrcoef(z.T)[0, 1]) < 0.06
