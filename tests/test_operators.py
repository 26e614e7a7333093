"""Hand-checked cases, invariants, and results that don't depend on partitions."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from modalis.functions import columns as C
from modalis.functions import matrix as M
from modalis.operators import gappy, linalg, manifold, mesh, modal, signal, stats, surrogates, tables
from modalis.streaming import sketch

SMALL = np.array([[1, 2, 3], [4, 5, 9], [2, 2, 2], [0, 1, 5]], float)


def rows(spark, a, parts=None):
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(a)], "row_id bigint, x array<double>")
    return df.repartition(parts, "row_id") if parts else df


def dense(df):
    got = df.select("row_id", "x").toPandas().sort_values("row_id")
    return np.vstack(got["x"].to_numpy())


def test_small_matrix(spark):
    r = rows(spark, SMALL)
    assert [x.m for x in r.select("row_id", C.temporal_mean("x").alias("m")).orderBy("row_id").collect()] == [2, 6, 2, 2]
    v = [x.s for x in r.select("row_id", C.temporal_variance("x").alias("s")).orderBy("row_id").collect()]
    assert np.allclose(v, [2 / 3, 14 / 3, 0, 14 / 3])
    assert np.isnan([x.x for x in r.select("row_id", C.norm_variance("x").alias("x")).orderBy("row_id").collect()][2]).all()
    m = modal.pod(r)
    assert np.allclose(m.s[:2], [5.45881384, 0.448721977]) and abs(m.s[2]) < 1e-9
    d = linalg.column_distances(r)
    assert np.allclose([d[0, 1] ** 2, d[0, 2] ** 2, d[1, 2] ** 2], [3, 54, 33])


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_factorisations_do_not_depend_on_partitions(spark, parts):
    a = np.random.default_rng(1).normal(size=(40, 6))
    r = rows(spark, a, parts)
    u, s, vt = linalg.tsqr_svd(r)
    assert np.allclose(s, np.linalg.svd(a, compute_uv=False))
    q = dense(u)
    assert np.allclose(q.T @ q, np.eye(6)) and np.allclose(q * s @ vt, a)
    assert np.allclose(linalg.gram(r), a.T @ a)


def test_empty_and_short_partitions(spark):
    a = np.random.default_rng(2).normal(size=(5, 4))
    r = rows(spark, a).repartition(16)
    full = linalg.tsqr(r)
    assert np.allclose(full.T @ full, a.T @ a)


def test_randomized_svd_of_low_rank(spark):
    g = np.random.default_rng(3)
    a = g.normal(size=(50, 4)) @ g.normal(size=(4, 12))
    _, s, _ = linalg.randomized_svd(rows(spark, a), 6, 2, 5)
    assert np.allclose(s[:4], np.linalg.svd(a, compute_uv=False)[:4])


def test_streaming_sketch_replays(spark, tmp_path):
    g = np.random.default_rng(4)
    a = g.normal(size=(30, 3)) @ g.normal(size=(3, 12))
    s = sketch.start(rows(spark, a[:, :6]), 5, 1, 9)
    sketch.save(s, str(tmp_path))
    once = sketch.update(s, rows(spark, a[:, 6:]), 5, 1, 9)
    again = sketch.update(sketch.load(spark, str(tmp_path), 1), rows(spark, a[:, 6:]), 5, 1, 9)
    assert np.allclose(dense(once.q) @ once.b, a) and np.allclose(dense(again.q) @ again.b, a)


def test_truncation_rules():
    s = np.array([8.0, 4, 2, 1])
    assert [modal.truncation(s, r) for r in (-0.81, -0.75, 2, 9, 0.3)] == [3, 2, 2, 4, 2]
    assert np.allclose(modal.residuals(s)[1:3], [0.497, 0.243], atol=1e-3)


@pytest.mark.parametrize(("confidence", "n", "value"), [(0.8, 10, 1.883), (0.95, 10, 4.965), (0.95, 30, 4.171), (0.9, 7, 3.589)])
def test_f_quantile_against_tables(confidence, n, value):
    assert abs(modal.f_quantile(confidence, n) - value) < 2e-3


def test_dmd_finds_an_oscillation(spark):
    t = np.arange(30.0)
    a = np.array([np.exp(-0.02 * t) * np.cos(0.5 * t + k) for k in range(20)])
    d = modal.dmd(rows(spark, a), 2, remove_mean=False)
    damping, frequency = modal.frequency_damping(d.mu, 1.0)
    assert np.allclose(damping, -0.02) and np.allclose(frequency, [0.5, -0.5])
    assert np.allclose(dense(modal.dmd_reconstruct(d, t[:-1])), a[:, :-1], atol=1e-8)


def test_spod_peaks_at_the_frequency(spark):
    t = np.arange(128.0)
    a = np.array([np.sin(2 * np.pi * t * 4 / 32 + 0.1 * k) for k in range(10)])
    m = modal.spod(rows(spark, a), t, 32, 16)
    assert np.isclose(m.frequency[0], 4 / 32) and (np.diff(m.energy[:, 0]) <= 1e-12).all()


def test_gappy_fills_low_rank(spark):
    g = np.random.default_rng(6)
    a = g.normal(size=(60, 2)) @ g.normal(size=(2, 10))
    holes = np.where(g.random(a.shape) < 0.15, 0, a)
    model = gappy.GappyPOD(truncation=2, ridge=None).fit(rows(spark, a))
    assert np.allclose(dense(model.predict(rows(spark, holes))), a, atol=1e-6)
    filled, spectra = gappy.reconstruct_full_set(rows(spark, holes), 2, truncation=2)
    assert np.allclose(dense(filled)[holes != 0], a[holes != 0]) and len(spectra) == 2


def test_mds_keeps_distances_and_isomap_runs(spark):
    a = np.random.default_rng(7).normal(size=(30, 8))
    y = manifold.mds(rows(spark, a), 8)
    d = np.sqrt(((y[:, :, None] - y[:, None]) ** 2).sum(axis=0))
    assert np.allclose(d, linalg.column_distances(rows(spark, a)))
    coordinates, residual, _, _ = manifold.isomap(rows(spark, a), 2, 4)
    assert coordinates.shape == (2, 8) and 0 <= residual <= 1


def test_isomap_embeds_one_component(spark):
    """Two clusters far apart: paths of one never lead to the other."""
    g = np.random.default_rng(17)
    a = np.hstack([g.normal(size=(6, 9)), 1000 + g.normal(size=(6, 5))])
    y, residual, edges, members = manifold.isomap(rows(spark, a), 2, 3)
    assert members.tolist() == list(range(9)) and y.shape == (2, 9) and 0 <= residual <= 1 and np.isinf(edges[0, 10])
    assert manifold.isomap(rows(spark, a), 2, 3, 2)[3].tolist() == list(range(9, 14))
    assert manifold.isomap(rows(spark, a), 2, 3, 9)[3].tolist() == list(range(9))


def test_wide_matrices_are_refused_before_any_pass(spark):
    """No task runs over the rows: a row that fails when it is computed is never reached."""
    wide = spark.range(3).select(F.col("id").alias("row_id"), F.expr("if(id = 0, array_repeat(1D, 5000), cast(raise_error('a pass') as array<double>))").alias("x")).coalesce(1)
    for f in (linalg.gram, linalg.tsqr, linalg.column_distances, lambda r: modal.pod(r, remove_mean=False), lambda r: modal.dmd(r, 2, remove_mean=False), lambda r: surrogates.sensor_reconstruction(r, [0], 1)):
        with pytest.raises(ValueError, match="columns"):
            f(wide)
    with pytest.raises(ValueError, match="entries"):
        linalg.through(rows(spark, SMALL), np.zeros((5000, 5000)))


@pytest.mark.parametrize("slice_", [1, 7, 65_536])
def test_sums_over_tasks_in_slices(spark, monkeypatch, slice_):
    monkeypatch.setattr(linalg, "SLICE", slice_)
    a = np.random.default_rng(18).normal(size=(50, 5))
    r = rows(spark, a, 9)
    assert np.allclose(linalg.gram(r), a.T @ a) and np.allclose(linalg.through(r, np.eye(5)[:, :2]), a.T @ a[:, :2])
    assert np.allclose(linalg.cross_gram(r.withColumn("y", F.slice("x", 1, 2))), a.T @ a[:, :2])


def test_dmd_keeps_small_modes(spark):
    """Modes of a millionth of the first, which a Gram matrix would lose."""
    t = np.arange(12.0)
    a = np.array([0.9**t * (1 + k) + 1e-7 * 0.5**t * (-1) ** k for k in range(10)])
    d = modal.dmd(rows(spark, a, 3), 2, remove_mean=False)
    assert np.allclose(sorted(d.mu.real), [0.5, 0.9], atol=1e-6)


def test_extraction_of_dynamic_and_spectral_modes(spark):
    g = np.random.default_rng(19)
    a = g.normal(size=(20, 64))
    d = modal.dmd(rows(spark, a), 6)
    phi = dense(d.phi)
    got = dense(modal.extract_dynamics(d.phi, 2, 2, [3, 1]).withColumnRenamed("point", "row_id"))
    assert np.allclose(got, phi[1::2][:, [4, 0]])
    assert np.allclose(dense(modal.extract_dynamics(d.phi, 1, 2, [2], real=False).withColumnRenamed("point", "row_id")), phi[0::2][:, [3]])
    m = modal.spod(rows(spark, a, 5), np.arange(64.0), 16, 8)
    whole = {(r.row_id, r.f): r.x for r in m.modes.collect()}
    got = {r.point: r.x for r in modal.extract_spectral(m, 2, 2, [1, 4], 2).collect()}
    assert all(np.allclose(got[p], [whole[2 * p + 1, int(m.order[k])][1] for k in (0, 3)]) for p in range(10))
    q, b = modal.mode_computation(rows(spark, a), np.eye(64)[:2], np.array([2.0, 4.0]), np.array([[3j, 0], [0, -4.0]])), a[:, :2] * [1.5, 1.0]
    assert np.allclose(dense(q), b)


def test_spod_against_a_plain_transform(spark):
    a = np.random.default_rng(20).normal(size=(30, 64))
    m = modal.spod(rows(spark, a, 4), np.arange(64.0), 16, 8)
    y = a - a.mean(axis=1, keepdims=True)
    w = signal.hamming_window(16)
    q = np.stack([np.fft.fft(y[:, 8 * b : 8 * b + 16] * w, axis=1)[:, :9] / w.mean() / 16 for b in range(7)], axis=2) / np.sqrt(7)
    q[:, 1:-1] *= 2
    s2 = np.array([np.linalg.svd(q[:, f], compute_uv=False) ** 2 for f in range(9)])
    order = np.argsort(-s2[:, 0])
    assert np.allclose(m.energy, s2[order]) and np.allclose(m.frequency, order / 16)


def test_t2_scores_and_coherent_modes_against_plain_formulas(spark):
    a = np.random.default_rng(21).normal(size=(30, 12))
    _, p = modal.pca(rows(spark, a))
    y = (a - a.mean(axis=1, keepdims=True)) / a.var(axis=1, keepdims=True)
    u, s, vt = np.linalg.svd(y, full_matrices=False)
    scores, limit = modal.t2_score(p)
    assert np.allclose(scores, vt[0] ** 2 * (len(p) - 1)) and np.isclose(limit, modal.f_quantile(0.8, 11))
    m = modal.pod(rows(spark, a))
    found, _, coherent, others = modal.coherent_modes(m.vt, np.arange(12.0))
    assert len(found) == 12 and sorted([*coherent, *others]) == list(range(12))


def test_delay_embedding(spark):
    s = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (0, 2, 3.0)], "s bigint, pos int, v double")
    got = sorted((r.pos, r.d, r.v) for r in signal.delay_embedding(s, 2).collect())
    assert got == [(0, 0, 0.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 2.0), (2, 0, 2.0), (2, 1, 3.0)]


def test_worksplit():
    assert tables.worksplit(0, 10, 4) == [(0, 0, 3), (1, 3, 6), (2, 6, 8), (3, 8, 10)]
    assert tables.worksplit(0, 10, 12)[9:] == [(9, 9, 10), (10, 10, 10), (11, 10, 10)]


def test_structured_cells(spark):
    assert [r.nodes for r in mesh.struct2d_cells(spark, 3, 2).orderBy("cell_id").collect()] == [[0, 1, 3, 2], [2, 3, 5, 4]]
    c = mesh.struct2d_cells(spark, 3, 2)
    assert sorted((r.cell_id, r.neighbour) for r in mesh.cell_adjacency(c).collect()) == [(0, 1), (1, 0)]


def test_normals_agree_after_turning(spark):
    p = mesh.struct2d_points(spark, 5, 4, (0.0, 1.0), (0.0, 1.0))
    c = mesh.struct2d_cells(spark, 5, 4).withColumn("nodes", F.when(F.col("cell_id") % 2 == 1, F.reverse("nodes")).otherwise(F.col("nodes")))
    n = mesh.coherent_normals(c, mesh.normals(p, c)).collect()
    assert len({np.sign(r.nz) for r in n}) == 1 and len(n) == 12


def test_exact_splits(spark):
    df = spark.range(103).select(F.col("id").alias("k"))
    n = {r["split"]: r["count"] for r in tables.split_exact(df, "k", [0.5, 0.3, 0.2]).groupBy("split").count().collect()}
    assert n == {0: 52, 1: 31, 2: 20}
    ordered = tables.split_exact(df, "k", [100, 3], None)
    assert sorted(r.k for r in ordered.filter("split = 1").collect()) == [100, 101, 102]
    with pytest.raises(ValueError):
        tables.split_sizes(10, [3, 3])


def test_build_x_and_back(spark):
    f = spark.createDataFrame([("u", 0, 0, 0, 1.0), ("u", 0, 1, 0, 2.0), ("w", 0, 0, 0, 3.0), ("w", 0, 1, 0, 4.0)], "field string, comp int, point_id bigint, t int, v double")
    x = tables.build_x(f, ["w", "u"])
    assert sorted((r.i, r.v) for r in x.collect()) == [(0, 3.0), (1, 1.0), (2, 4.0), (3, 2.0)]
    assert sorted((r.i, r.v) for r in tables.get_dim(x, 2, 1).collect()) == [(0, 1.0), (1, 2.0)]


def test_empty_matrix(spark):
    e = spark.createDataFrame([], "row_id bigint, x array<double>")
    assert linalg.gram(e).shape == (0, 0) and M.to_long(e).count() == 0 and M.width(e) == 0


def test_polynomial_networks_learn():
    x = np.random.default_rng(22).uniform(-1, 1, (200, 2))
    y = np.sin(2 * x[:, 0]) + x[:, 1] ** 2
    m = surrogates.PolynomialNetwork((6,), 3, epochs=300).fit(x, y)
    assert m.losses[-1] < 0.01 and np.isclose(((m.predict(x)[:, 0] - y) ** 2).mean(), m.losses[-1], rtol=0.2)
    sine = surrogates.PolynomialNetwork((6,), 3, "sine", 300).fit(x, y - y.mean())
    assert sine.losses[-1] < 0.3 * sine.losses[0]
    # Slopes against differences, by one small step of a coefficient.
    for kind in ("chebyshev", "sine"):
        n = surrogates.PolynomialNetwork((), 2, kind)
        f, slope = n.basis(np.array([[0.3, -0.7]]))
        near = (n.basis(np.array([[0.3 + 1e-6, -0.7 + 1e-6]]))[0] - f) / 1e-6
        assert np.allclose(near, slope, atol=1e-5)


def test_variational_autoencoder():
    g = np.random.default_rng(23)
    v = surrogates.VariationalAutoencoder(2, 5, 0.1).start(3)
    x, noise = g.normal(size=(7, 3)), g.normal(size=(7, 2))
    _, slopes = v.loss(x, noise)
    for k, w in v.weights.items():
        at = tuple(0 for _ in w.shape)
        keep = w[at]
        w[at] = keep + 1e-6
        up = v.loss(x, noise)[0]
        w[at] = keep - 1e-6
        down = v.loss(x, noise)[0]
        w[at] = keep
        assert np.isclose((up - down) / 2e-6, slopes[k][at], atol=1e-6)
    z = g.normal(size=(200, 2))
    data = np.column_stack([z, z[:, 0] - z[:, 1], 0.5 * z[:, 0]])
    m = surrogates.VariationalAutoencoder(epochs=250).fit(data)
    assert ((m.predict(data) - data) ** 2).mean() < 0.1 * data.var()


def test_sensors_reconstruct_low_rank_fields(spark):
    t = np.arange(60.0)
    a = np.array([[np.cos(0.3 * s + 0.2 * k) + 0.5 * np.sin(0.7 * s - 0.1 * k) for s in t] for k in range(50)])
    got = dense(surrogates.sensor_reconstruction(rows(spark, a, 3), [3, 20, 41], 5))
    assert np.linalg.norm(got[:, 5:] - a[:, 5:]) < 0.02 * np.linalg.norm(a[:, 5:])
    lags = surrogates.delayed(np.array([[1.0, 2, 3], [4, 5, 6]]), 1)
    assert lags.tolist() == [[0, 1, 0, 4], [1, 2, 4, 5], [2, 3, 5, 6]]


def test_nonlinear_targets(spark):
    c = spark.createDataFrame([(0.1, 1.0), (0.4, 2.0), (-0.2, 0.5), (0.8, 1.0)], "cp double, a double")
    two = [(lambda v: v * v, lambda v: 2 * v, 1.7), (lambda v: F.col("a") * F.exp(v), lambda v: F.col("a") * F.exp(v), 7.0)]
    x = np.array([(r.cp, r.a, r.adjusted) for r in surrogates.adjust_field_nonlinear(c, two).collect()])
    assert np.isclose((x[:, 2] ** 2).sum(), 1.7) and np.isclose((x[:, 1] * np.exp(x[:, 2])).sum(), 7.0)
    # The change is a combination of the constraints' slopes: it is least.
    slopes = np.column_stack([2 * x[:, 2], x[:, 1] * np.exp(x[:, 2])])
    w = np.linalg.lstsq(slopes, x[:, 2] - x[:, 0], rcond=None)[0]
    assert np.allclose(slopes @ w, x[:, 2] - x[:, 0], atol=1e-8)


def test_any_operation_reduces(spark):
    d = spark.createDataFrame([(k % 3 if k % 7 else None, float((-1) ** k * k)) for k in range(50)], "k int, v double").repartition(5)
    most = lambda a, b: a if abs(a) > abs(b) else b
    got = {r.k if r.k == r.k else None: r.v for r in tables.reduced(d, "k", "v", most).collect()}
    assert got == {0: 48.0, 1: 46.0, 2: -47.0, None: -49.0}


def test_cross_validation_sees_each_row_once(spark):
    d = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 2.0).alias("y"))
    mean = lambda train: (lambda m: lambda test: test.withColumn("p", F.lit(m)))(train.agg(F.avg("y")).first()[0])
    got = surrogates.cross_validated(d, "k", 3, mean, F.avg((F.col("p") - F.col("y")) ** 2))
    fold = np.array([r[0] for r in d.orderBy("k").select(surrogates.fold_of(F.col("k"), 3)).collect()])
    y = np.arange(60) * 2.0
    assert np.isclose(got, np.mean([((y[fold == f] - y[fold != f].mean()) ** 2).mean() for f in range(3)]))


def test_known_widths_follow_their_columns(spark):
    r = rows(spark, SMALL)
    known = M.of_width(r, 3)
    assert M.width(r) == M.width(known) == M.width(modal.centred(known)) == 3
    assert modal.centred(known).schema["x"].metadata == {"width": 3}
    assert M.width(known.select("row_id", F.slice("x", 1, 2).alias("x"))) == 2
    assert M.width(linalg.times(known, np.ones((3, 5)))) == 5 and M.width(M.dense_rows(M.to_long(r), 4)) == 4
    assert dense(M.dense_rows(M.to_long(r).filter("v <> 2"), 4)).tolist() == [[1, 0, 3, 0], [4, 5, 9, 0], [0, 1, 5, 0]]


def test_dense_rows_go_to_as_many_tasks_as_their_cells_need(spark, monkeypatch):
    """A task's cells stay few however many there are, also of a row that most entries belong to; the rows are the same."""
    rng = np.random.default_rng(9)
    i, j, v = rng.integers(0, 300, 6000), rng.integers(0, 7, 6000), rng.integers(1, 50, 6000).astype(float)
    i[3000:5500], j[3500:5500] = 11, 3
    long = spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(i, j, v, strict=True)], "i bigint, j int, v double").repartition(5)
    want = np.zeros((300, 7))
    np.add.at(want, (i, j), v)
    few = M.dense_rows(long, 7)
    monkeypatch.setattr(M, "CELLS_A_TASK", 200)
    many = M.dense_rows(long, 7)
    assert many.rdd.getNumPartitions() == 30 > few.rdd.getNumPartitions()
    ids = np.unique(i)
    assert dense(few).tolist() == dense(many).tolist() == want[ids].tolist() and many.count() == len(ids)
    cells = M.added_up(long).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert cells <= 2 * M.CELLS_A_TASK
    sent = {re.sub(r"#\w+", "", x) for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", many._jdf.queryExecution().executedPlan().toString())}
    assert sent == {"i, had, 30", "i, 30"}  # what a task had of a row is dealt apart from the rest of it
    assert M.dense_rows(long.limit(0), 7).count() == 0


def test_models_learn():
    x = np.random.default_rng(8).uniform(-1, 1, (300, 2))
    y = np.sin(x[:, 0]) + x[:, 1] ** 2
    m = surrogates.Perceptron((16, 16), 120).fit(x, y, stop=surrogates.EarlyStop(40))
    assert ((m.predict(x)[:, 0] - y) ** 2).mean() < 0.01
    stop = surrogates.EarlyStop(2)
    assert [stop(v) for v in (3, 2, 2, 2)] == [False, False, False, True]


def test_adjusted_field_meets_targets(spark):
    c = spark.createDataFrame([(0.1, 1.0, 0.0), (0.4, 1.0, 1.0), (-0.2, 1.0, 2.0)], "cp double, a double, b double")
    r = surrogates.adjust_field(c, {"a": 1.0, "b": 0.5}).agg(F.sum(F.col("adjusted") * F.col("a")), F.sum(F.col("adjusted") * F.col("b"))).first()
    assert np.allclose(list(r), [1.0, 0.5])


def test_channels_and_counters(spark):
    from modalis.functions.profile import Channels, counted

    c = Channels()

    @c.timed("work")
    def work(n):
        with c.span("inner"):
            return sum(range(n))

    assert work(10) == 45 and work(100) == 4950
    r = {x.name: x for x in c.report(spark).collect()}
    assert r["work"].calls == 2 and r["work"].total >= r["inner"].total >= 0
    df, seen = counted(spark.range(7), "seen", F.count(F.lit(1)).alias("n"), F.max("id").alias("m"))
    assert df.count() == 7 and seen.get == {"n": 7, "m": 6}
    c.reset()
    assert not c.spans


def test_many_partitions_merge_in_levels(spark, monkeypatch):
    monkeypatch.setattr(linalg, "MERGED", 2)
    a = np.random.default_rng(9).normal(size=(60, 3))
    r = linalg.tsqr(rows(spark, a, 9))
    assert np.allclose(r.T @ r, a.T @ a)


@pytest.mark.parametrize("kind", ["spread", "ties", "heavy", "odd"])
def test_exact_percentiles_by_passes(spark, monkeypatch, kind):
    monkeypatch.setattr(stats, "GATHERED", 30)
    monkeypatch.setattr(stats, "ACCURACY", 100)
    rng = np.random.default_rng(3)
    x = {"spread": rng.exponential(size=3000), "ties": rng.integers(0, 9, 3000) / 4, "heavy": np.concatenate([np.zeros(2850), rng.normal(size=150)]), "odd": np.concatenate([rng.normal(size=2000), [np.inf, -np.inf] * 9])}[kind]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").repartition(4)
    at = [0.0, 0.31, 0.5, 0.95, 0.99, 1.0]
    want = df.agg(F.percentile("v", at).alias("q")).first()["q"]
    assert np.allclose(stats.percentiles(df, F.col("v"), at), want, rtol=1e-14)
    assert stats.percentiles(df.limit(0), F.col("v"), at) == [None] * 6


def test_metrics_gather_no_distinct_errors(spark):
    df = spark.range(500).select(F.col("id").cast("double").alias("y"), F.lit(0.5).alias("p"))
    m = stats.regression_metrics(df)
    assert "percentile" not in m._jdf.queryExecution().optimizedPlan().toString()
    assert np.isclose(m.first()["ae_95"], np.quantile(np.abs(np.arange(500) - 0.5), 0.95))


def test_a_diagonal_is_made_by_many_tasks(spark):
    v = spark.range(300).select(F.col("id").alias("i"), (F.col("id") + 1.0).alias("v")).coalesce(1)
    a = linalg.build_diagonal(v, 300)
    assert len({r.p for r in a.select(F.spark_partition_id().alias("p")).distinct().collect()}) > 1
    assert a.count() == 90_000 and a.filter("v <> 0").count() == 300 and a.filter("i = j and v <> i + 1").count() == 0


def test_sketches_have_one_worker_a_task(spark, monkeypatch):
    """Factors of X W are taken where X W is made: no plan has one Python stage on top of another."""
    plans, merged = [], linalg.merged
    monkeypatch.setattr(linalg, "merged", lambda df, *a: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), merged(df, *a))[1])
    x = np.random.default_rng(4).normal(size=(60, 5))
    df = rows(spark, x)
    w = np.random.default_rng(5).normal(size=(5, 3))
    assert np.allclose(linalg.tsqr_of(df, w), linalg.tsqr(linalg.times(df, w)))
    assert np.allclose(linalg.tsqr_of(df, w).T @ linalg.tsqr_of(df, w), (x @ w).T @ (x @ w))
    assert "MapInArrow" not in plans[0] and "MapInArrow" in plans[1]


def test_signs_agree_by_few_rounds(spark, monkeypatch):
    """A long mesh, of two parts, with every third cell turned: rounds shrink instead of following its length."""
    cuts, keep = [], mesh.cut
    monkeypatch.setattr(mesh, "cut", lambda df, *a: (cuts.append(1), keep(df, *a))[1])
    monkeypatch.setattr(mesh, "FEW_PAIRS", 300)
    p = mesh.struct2d_points(spark, 400, 3, (0.0, 1.0), (0.0, 1.0))
    c = mesh.struct2d_cells(spark, 400, 3).filter("cell_id < 300 or cell_id > 303").withColumn("nodes", F.when(F.col("cell_id") % 3 == 1, F.reverse("nodes")).otherwise(F.col("nodes")))
    signs = mesh.agreeing_signs(mesh.edge_owners(c), mesh.normals(p, c)).join(mesh.normals(p, c), "cell_id").collect()
    parts = {}
    for r in signs:
        parts.setdefault(r.root, set()).add(np.sign(r.nz) * r.sign)
    assert len(signs) == 794 and len(parts) == 2 and all(len(v) == 1 for v in parts.values())
    assert {r.root for r in signs if r.cell_id < 300} != {r.root for r in signs if r.cell_id > 303} and len(cuts) < 40


def test_a_diagonal_is_made_by_tiles_of_few_columns(spark):
    """Indices have gaps; a task has all of its rows for the columns of one tile, and each row and column comes once."""
    v = spark.range(1500).select((F.col("id") * 7 + 3).alias("i"), F.when(F.col("id") != 5, F.col("id") + 1.0).alias("v"))
    a = linalg.build_diagonal(v, 1500).withColumn("task", F.spark_partition_id())
    got = a.groupBy("task").agg(F.countDistinct("j").alias("j"), F.countDistinct("i").alias("i"), F.count("*").alias("n")).collect()
    assert max(r.j for r in got) < 2 * linalg.TILE and all(r.n == r.i * r.j for r in got)
    assert a.count() == a.select("i", "j").distinct().count() == 1500**2 and a.filter("v <> 0").count() == 1499
    assert a.filter("i = j").join(v.toDF("i", "w"), "i").filter("v <=> w").count() == 1500
    assert a.filter("(i - 3) % 7 <> 0 or (j - 3) % 7 <> 0").isEmpty() and a.filter("i <> j and v <=> 0").count() == 1500 * 1499
    assert linalg.build_diagonal(v.limit(0), 0).count() == 0
