"""Embeddings of snapshots (columns). Of few snapshots distances are one distributed pass and the rest is snapshots x
snapshots on the driver; of many, neighbours come from tiles, paths from joins, and only landmarks are on the driver."""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.matrix import width
from . import tiles
from .linalg import checked_size, column_distances


def double_centred(d: np.ndarray) -> np.ndarray:
    n = len(d)
    j = np.eye(n) - 1 / n
    return -0.5 * j @ d**2 @ j


def embedding(d: np.ndarray, dims: int) -> np.ndarray:
    """Coordinates (dims x snapshots) from distances; eigenvalues that are zero to rounding are left out."""
    w, v = np.linalg.eigh(double_centred(d))
    w, v = w[::-1], v[:, ::-1]
    keep = [k for k in range(min(dims, len(w))) if w[k] > np.abs(w).max() * np.finfo(float).eps ** 0.75]
    y = v[:, keep].T * np.sqrt(w[keep])[:, None]
    return y * np.where(y[np.arange(len(y)), np.abs(y).argmax(axis=1)] < 0, -1, 1)[:, None] if len(y) else y


def mds(rows: DataFrame, dims: int) -> np.ndarray:
    return embedding(column_distances(rows), dims)


def neighbours(d: np.ndarray, size: int) -> np.ndarray:
    """Distances to the ``size`` nearest, either way round; infinity elsewhere."""
    out = np.full_like(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, : size + 1]
    np.put_along_axis(out, near, np.take_along_axis(d, near, axis=1), axis=1)
    return np.minimum(out, out.T)


def component_members(g: np.ndarray, number: int = 1) -> np.ndarray:
    """The snapshots of a connected component, by paths ``g``: the largest is number 1, of equal ones the one with the
    first snapshot goes first; a number beyond the last means the largest."""
    first = np.isfinite(g).argmax(axis=1)
    names, sizes = np.unique(first, return_counts=True)
    order = names[np.lexsort((names, -sizes))]
    return np.flatnonzero(first == order[number - 1 if 1 <= number <= len(order) else 0])


def shortest_paths(g: np.ndarray) -> np.ndarray:
    g = g.copy()
    np.fill_diagonal(g, 0)
    for k in range(len(g)):
        np.minimum(g, g[:, k : k + 1] + g[k], out=g)
    return g


def isomap(rows: DataFrame, dims: int, size: int, component: int = 1) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Coordinates, residual variance, the neighbourhood graph, and the snapshots that are embedded: those of one
    connected component of the graph, the largest unless told otherwise."""
    d = column_distances(rows)
    e = neighbours(d, size)
    g = shortest_paths(e)
    members = component_members(g, component)
    g = g[np.ix_(members, members)]
    y = embedding(g, dims)
    between = np.sqrt(((y[:, :, None] - y[:, None, :]) ** 2).sum(axis=0))
    r = np.corrcoef(between.ravel(), g.ravel())[0, 1]
    return y, 1 - r * r, e, members


# --- more snapshots than the driver holds ----------------------------------------------------------------


def neighbour_edges(rows: DataFrame, size: int, block: int = tiles.BLOCK) -> DataFrame:
    """i, j, d: the graph of the ``size`` nearest other snapshots, either way round."""
    return either_way(tiles.nearest(rows, size, block))


def vector_edges(vectors: DataFrame, size: int) -> DataFrame:
    """The same graph for vectors as rows (i from 0 without gaps, x)."""
    return either_way(tiles.nearest_vectors(vectors, size))


def either_way(near: DataFrame) -> DataFrame:
    near = cut(near)
    one = near.select("i", F.explode("near").alias("x")).select("i", F.col("x.j").alias("j"), F.col("x.d").alias("d"))
    both = one.unionByName(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    return both.groupBy("i", "j").agg(F.min("d").alias("d"))


def paths_from(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """node, source, d: lengths of the shortest paths from every source (column ``source``) to the nodes that it reaches. A
    round lets what got shorter in the last one pass on over its edges, by a join on the node; there are no more rounds than
    edges on the longest path. Places that a round does not reach stay as they are."""
    edges = cut(edges.select("i", "j", "d"))
    state = cut(sources.select(F.col("source").cast("long").alias("node"), F.col("source").cast("long").alias("source")).distinct().withColumns({"d": F.lit(0.0), "new": F.lit(True)}))
    while True:
        moved = state.filter("new").select(F.col("node").alias("i"), "source", F.col("d").alias("so_far")).join(edges, "i")
        tried = moved.select(F.col("j").alias("node"), "source", (F.col("so_far") + F.col("d")).alias("d"), F.lit(None).cast("double").alias("old"))
        every = state.select("node", "source", "d", F.col("d").alias("old")).unionByName(tried)
        state = cut(every.groupBy("node", "source").agg(F.min("d").alias("d"), F.min("old").alias("old")).select("node", "source", "d", (F.col("old").isNull() | (F.col("d") < F.col("old"))).alias("new")))
        if state.filter("new").limit(1).count() == 0:
            return state.select("node", "source", "d")


def landmark_numbers(n: int, landmarks: int | None, seed: int = 0) -> list[int]:
    """Which of ``n`` snapshots are landmarks: those that come first by a hash; all of them if no number is given."""
    order = lambda j: (hashlib.md5(f"{seed}:{j}".encode()).hexdigest(), j)
    return list(range(n)) if landmarks is None else sorted(heapq.nsmallest(landmarks, range(n), key=order))


def landmark_isomap(rows: DataFrame, dims: int, size: int, landmarks: int | None = None, component: int = 1, block: int = tiles.BLOCK, seed: int = 0) -> tuple[DataFrame, float, DataFrame]:
    """Coordinates (node, y) of the snapshots of one component, the residual variance, and the graph (i, j, d). Landmarks
    are embedded by the paths between them, and every other snapshot is placed by its paths to them; with all
    snapshots as landmarks that is ``isomap``. The driver holds landmarks x landmarks. A component without a landmark is not
    found; the residual compares the distances and the paths between snapshots and landmarks."""
    chosen = landmark_numbers(width(rows), landmarks, seed)
    checked_size(len(chosen) ** 2)
    spark = rows.sparkSession
    edges = cut(neighbour_edges(rows, size, block))
    paths = paths_from(edges, spark.createDataFrame([(j,) for j in chosen], "source long"))
    # A component is told by the first landmark that reaches its nodes.
    parts = paths.groupBy("node").agg(F.min("source").alias("part"))
    sizes = sorted(((-r["count"], r["part"]) for r in parts.groupBy("part").count().collect()), key=tuple)
    if not sizes:
        return spark.createDataFrame([], "node long, y array<double>"), float("nan"), edges
    name = sizes[component - 1 if 1 <= component <= len(sizes) else 0][1]
    inside = paths.join(parts.filter(F.col("part") == name).select("node"), "node", "left_semi")
    between = inside.join(F.broadcast(spark.createDataFrame([(j,) for j in chosen], "node long")), "node").toArrow()
    mine = np.unique(between.column("source").to_numpy())
    d = np.zeros((len(mine), len(mine)))
    d[np.searchsorted(mine, between.column("node").to_numpy()), np.searchsorted(mine, between.column("source").to_numpy())] = between.column("d").to_numpy()
    d = np.minimum(d, d.T)
    y = embedding(d, dims)
    # y = inverse (mean - squares) / 2, a sum over landmarks for every snapshot.
    inverse = y / np.maximum((y * y).sum(axis=1), np.finfo(float).tiny)[:, None]
    mean = (d * d).mean(axis=1)
    table = spark.createDataFrame([(int(j), float(m), [float(v) for v in p]) for j, m, p in zip(mine, mean, inverse.T, strict=True)], "source long, mean double, part array<double>")
    shares = inside.join(F.broadcast(table), "source").withColumn("w", (F.col("mean") - F.col("d") * F.col("d")) / 2)
    placed = cut(shares.groupBy("node").agg(*(F.sum(F.col("w") * F.col("part")[k]).alias(f"y{k}") for k in range(len(y)))).select("node", F.array(*(F.col(f"y{k}") for k in range(len(y)))).cast("array<double>").alias("y")))
    marks = spark.createDataFrame([(int(j), [float(v) for v in p]) for j, p in zip(mine, y.T, strict=True)], "source long, z array<double>")
    apart = F.sqrt(F.aggregate(F.zip_with("y", "z", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    r = inside.join(placed, "node").join(F.broadcast(marks), "source").agg(F.corr(apart, F.col("d"))).first()[0]
    return placed, float("nan") if r is None else 1 - r * r, edges
