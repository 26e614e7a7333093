from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from modalis.operators import modal
from modalis.sources import layout


def test_fields_and_modes_are_pruned(spark, tmp_path):
    f = spark.range(40).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("field"), F.lit(0).alias("comp"), F.col("id").alias("point_id"), F.lit(0).alias("t"), F.rand(1).alias("v"))
    points = spark.range(40).select(F.col("id").alias("point_id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    axes = spark.createDataFrame([("time", 0, 0, 0.0)], "axis string, idim int, pos int, value double")
    layout.Dataset(points, axes, f).save(str(tmp_path / "d"))
    got = layout.Dataset.load(spark, str(tmp_path / "d"), ["a"]).fields
    assert got.count() == 20 and "PartitionFilters: [isnotnull(field" in got._jdf.queryExecution().toString()

    a = np.random.default_rng(0).normal(size=(20, 5))
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(a)], "row_id bigint, x array<double>")
    m = modal.pod(rows, remove_mean=False)
    layout.save_modes(m, str(tmp_path / "m"))
    two = layout.load_modes(spark, str(tmp_path / "m"), 2)
    assert np.allclose(two.s, m.s[:2]) and np.allclose(two.vt, m.vt[:2])
    assert {len(r.x) for r in two.u.collect()} == {2}


def test_complex_factors(spark, tmp_path):
    layout.save_small(spark, str(tmp_path / "f"), mu=np.array([1 + 2j, 3]), s=np.array([[1.0, 2.0], [3.0, 4.0]]))
    back = layout.load_small(spark, str(tmp_path / "f"))
    assert np.allclose(back["mu"], [[1 + 2j, 3]]) and np.allclose(back["s"], [[1, 2], [3, 4]])
