"""Parts of meshes against the join forms over the whole mesh."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from modalis.operators import mesh as G
from modalis.operators import partition as P


def mesh_of(spark):
    """A bent grid, padded triangles beside it, and a third cell on one edge."""
    points = G.struct2d_points(spark, 14, 9, (0.0, 3.0), (0.0, 1.0)).withColumn("z", F.col("x") * F.col("y"))
    cells = G.struct2d_cells(spark, 14, 9).repartition(4)
    odd = spark.createDataFrame([(1000, 2, [0, 1, 125, -1]), (1001, 2, [1, 2, 125, -1]), (1002, 2, [0, 9, 60, -1])], "cell_id bigint, eltype int, nodes array<int>")
    return points, cells.unionByName(odd)


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_parts_have_the_rows_of_the_whole(spark, parts, tmp_path):
    points, cells = mesh_of(spark)
    c, p = P.divided(points, cells, parts=parts)
    P.save(c, p, str(tmp_path / "mesh"))
    c, p = P.load(spark, str(tmp_path / "mesh"))
    sizes = [r[1] for r in c.filter("own").groupBy("part").count().collect()]
    assert sum(sizes) == cells.count() and len(sizes) == parts and max(sizes) < 2 * cells.count() / parts + 5
    got = {(r.cell_id, r.neighbour) for r in P.neighbours(c, p).collect()}
    assert got == {(r.cell_id, r.neighbour) for r in G.cell_adjacency(cells).collect()}
    mine = {r.cell_id: (r.x, r.y, r.z) for r in P.centres(c, p).collect()}
    whole = {r.cell_id: (r.x, r.y, r.z) for r in G.cell_centres(points, cells).collect()}
    assert mine.keys() == whole.keys() and all(np.allclose(mine[k], whole[k]) for k in whole)


def test_parts_are_read_alone_and_keys_are_near(spark, tmp_path):
    points, cells = mesh_of(spark)
    c, p = P.divided(points, cells, parts=5)
    P.save(c, p, str(tmp_path / "mesh"))
    one, at = P.load(spark, str(tmp_path / "mesh"), [2])
    assert "PartitionFilters: [isnotnull(part" in one._jdf.queryExecution().toString()
    assert {r.part for r in one.select("part").distinct().collect()} == {2} and at.count() > 0
    assert one.filter("own").count() < 0.5 * cells.count() and 0 < one.filter("not own").count() < 2 * one.filter("own").count()


def test_a_mesh_without_cells(spark):
    points, cells = mesh_of(spark)
    c, p = P.divided(points, cells.limit(0))
    assert c.count() == 0 and p.count() == 0 and P.neighbours(c, p).count() == 0 and P.centres(c, p).count() == 0


def test_the_curve_interleaves_bits(spark):
    rows = spark.createDataFrame([(5, 3), (0, 0), (7, 7)], "a long, b long").select("a", "b", P.curve_key([F.col("a"), F.col("b")], 3).alias("k")).collect()
    assert {(r.a, r.b): r.k for r in rows} == {(5, 3): 0b011011, (0, 0): 0, (7, 7): 63}
