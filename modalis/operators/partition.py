"""Meshes in parts: cells along a space-filling curve, each part with a halo of the cells that share an edge with its own.

The table of a part holds all that its cells' centres, neighbours and normals need, so these run within a part, as one
grouped task each, without a join over the mesh; the rows are those of the join forms in ``mesh``. Parts are runs of the
curve of about equal numbers of cells; their number is chosen so that a part fits a task.

Cells with equal keys stay together: a crowd of cells at one place is one part. A mesh without cells has no parts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from . import mesh as G

#: Bits of an axis in a key, and cells of a part, about.
BITS, CELLS = 10, 50_000


def curve_key(places: list[Column], bits: int = BITS) -> Column:
    """Bits of whole numbers below 2**bits, one of each axis in turn: neighbours in space are near on the curve."""
    parts = [F.call_function("shiftleft", F.call_function("shiftright", q, F.lit(b)).bitwiseAND(1), F.lit(b * len(places) + k)) for k, q in enumerate(places) for b in range(bits)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def keyed(points: DataFrame, cells: DataFrame, bits: int = BITS) -> DataFrame:
    """cell_id, key: the place of each cell's centre on the curve."""
    c = G.cell_centres(points, cells)
    b = points.agg(*(f(a).alias(f"{n}{a}") for a in "xyz" for f, n in ((F.min, "low"), (F.max, "high")))).first()
    axes = [a for a in "xyz" if b[f"low{a}"] is not None and b[f"high{a}"] > b[f"low{a}"]] or ["x"]
    steps = (1 << bits) - 1
    place = lambda a: F.floor((F.col(a) - (b[f"low{a}"] or 0.0)) / ((b[f"high{a}"] or 0.0) - (b[f"low{a}"] or 0.0) or 1.0) * steps).cast("long")
    return c.select("cell_id", curve_key([place(a) for a in axes], bits).alias("key"))


def bounds_of(keys: DataFrame, parts: int) -> list[int]:
    """Keys at which parts but the first begin, about equal in cells."""
    at = keys.approxQuantile("key", [k / parts for k in range(1, parts)], 0.1 / parts) if parts > 1 else []
    return sorted({int(v) for v in at})


def divided(points: DataFrame, cells: DataFrame, bounds: list[int] | None = None, parts: int | None = None, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """Cells (part, own, cell_id, eltype, nodes) and points (part, point_id, x, y, z) of all parts, halos included. ``bounds``:
    keys at which parts begin, if they are not to be found."""
    keys = cut(keyed(points, cells, bits))
    if bounds is None:
        bounds = bounds_of(keys, parts if parts is not None else max(1, keys.count() // CELLS))
    part = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<long>"), lambda b: b <= F.col("key")))
    of = cut(keys.select("cell_id", part.alias("part")))
    e = G.edges(cells).select("v1", "v2", "cell_id").distinct().join(of, "cell_id")
    sides = e.select("v1", "v2", F.col("part").alias("other")).distinct()
    halo = e.join(sides, ["v1", "v2"]).filter("part <> other").select(F.col("other").alias("part"), "cell_id").distinct()
    members = of.select("part", "cell_id", F.lit(True).alias("own")).unionByName(halo.select("part", "cell_id", F.lit(False).alias("own")))
    c = cut(cells.select("cell_id", "eltype", "nodes").join(members, "cell_id").select("part", "own", "cell_id", "eltype", "nodes"))
    nodes = c.select("part", F.explode(F.filter("nodes", lambda n: n >= 0)).alias("node")).distinct()
    p = nodes.join(points.select(F.col("point_id"), "x", "y", "z"), F.col("node") == F.col("point_id")).select("part", "point_id", "x", "y", "z")
    return c, p


def save(cells: DataFrame, points: DataFrame, path: str) -> None:
    """A folder for each part, so that parts are read alone."""
    cells.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/cells")
    points.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/points")


def load(spark: SparkSession, path: str, parts: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Cells and points of all or some parts; other parts' files are not read."""
    out = []
    for name, schema in (("cells", "own boolean, cell_id bigint, eltype int, nodes array<int>, part int"), ("points", "point_id bigint, x double, y double, z double, part int")):
        t = spark.read.schema(schema).parquet(f"{path}/{name}")
        out.append(t if parts is None else t.filter(F.col("part").isin(parts)))
    return out[0], out[1]


# --- within a part ---------------------------------------------------------------------------------------


def table_of(cells: pd.DataFrame, points: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a part: for each corner of each cell the cell's place, the corner's number and its node; and the nodes' places."""
    nodes = [np.array([n for n in x if n >= 0], np.int64) for x in cells["nodes"]]
    cell = np.repeat(np.arange(len(nodes)), [len(n) for n in nodes])
    k = np.concatenate([np.arange(len(n)) for n in nodes]) if nodes else np.zeros(0, np.int64)
    node = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
    order = np.argsort(points["point_id"].to_numpy())
    xyz = points[["x", "y", "z"]].to_numpy()[order]
    return cell, k, node, xyz[np.searchsorted(points["point_id"].to_numpy()[order], node)]


def within(cells: DataFrame, points: DataFrame, f: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``f`` of each part's cells and points, a task a part."""
    p = points.toDF(*points.columns)  # columns of its own, where both come from one table
    return cells.groupBy("part").cogroup(p.groupBy("part")).applyInPandas(f, schema)


def centres(cells: DataFrame, points: DataFrame) -> DataFrame:
    """part, cell_id, x, y, z of the parts' own cells."""

    def one(c: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        c = c[c["own"]]
        cell, _, _, xyz = table_of(c, p)
        sums = np.stack([np.bincount(cell, xyz[:, a], len(c)) for a in range(3)], axis=1) / np.maximum(np.bincount(cell, minlength=len(c)), 1)[:, None]
        return pd.DataFrame({"part": c["part"], "cell_id": c["cell_id"], "x": sums[:, 0], "y": sums[:, 1], "z": sums[:, 2]})

    return within(cells, points, one, "part int, cell_id bigint, x double, y double, z double")


def neighbours(cells: DataFrame, points: DataFrame) -> DataFrame:
    """part, cell_id, neighbour, whose: pairs over edges that exactly two cells share, of the parts' own cells; ``whose``
    tells whether the neighbour is the part's own too."""

    def one(c: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        c = c.reset_index(drop=True)
        cell, k, node, _ = table_of(c, p)
        count = np.bincount(cell, minlength=len(c))
        start = np.cumsum(count) - count
        after = node[start[cell] + (k + 1) % np.maximum(count[cell], 1)]
        e = pd.DataFrame({"a": np.minimum(node, after), "b": np.maximum(node, after), "cell": cell}).drop_duplicates()
        two = e.groupby(["a", "b"])["cell"].agg(["min", "max", "size"])
        two = two[two["size"] == 2]
        pairs = np.unique(np.concatenate([two[["min", "max"]].to_numpy(), two[["max", "min"]].to_numpy()]), axis=0)
        own = c["own"].to_numpy(bool)
        pairs = pairs[own[pairs[:, 0]]] if len(pairs) else pairs.reshape(0, 2)
        ids = c["cell_id"].to_numpy(np.int64)
        part = int(c["part"].iloc[0]) if len(c) else 0
        return pd.DataFrame({"part": part, "cell_id": ids[pairs[:, 0]], "neighbour": ids[pairs[:, 1]], "own": own[pairs[:, 1]]})

    return within(cells, points, one, "part int, cell_id bigint, neighbour bigint, own boolean")
