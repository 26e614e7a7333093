"""Factorisation of matrices with more columns than the driver can square: panels of columns by block Gram-Schmidt.

A panel is made orthogonal to the basis before it by two rounds of products, and then factored by ``tsqr``, twice, so that the
basis stays orthonormal however close its columns are. Each product is a pass over the rows; the driver sees columns x panel
numbers at a time, and R is a table that grows by a panel's columns. A panel's columns are replaced by its basis in place, so
a row is never joined to anything; what a panel leaves is written to the checkpoint folder.

Columns that depend on those before them get a basis of less than full rank: Q R is X all the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut, scratch
from ..functions.matrix import of_width, width
from . import linalg as L

#: Columns of a panel, and the share of a column's norm below which nothing of it is left.
PANEL, LEAST = 512, 1e-12


def inverse(r: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """The inverse of R, of what stands out against the columns' ``norms``."""
    scale = np.where(norms > 0, norms, 1)
    u, s, vt = np.linalg.svd(r / scale)
    kept = s > LEAST
    return (vt[kept].T / s[kept]) @ u[:, kept].T / scale[:, None]


def panel_qr(rows: DataFrame, panel: int = PANEL) -> tuple[DataFrame, DataFrame]:
    """Q (rows) and R (i, at, x: in row i the entries from column ``at`` on, a panel's width of them) of ``rows``."""
    n, spark = width(rows), rows.sparkSession
    L.checked_size(n * min(n, panel))
    state, path = rows.select("row_id", "x"), scratch(spark)
    for at in range(0, n, panel):
        w = min(panel, n - at)
        held = [np.zeros((at, w)), np.eye(w)]  # to be taken off by way of the basis, and what the rest is multiplied by
        c, norms = taken_off(state, at, w, held, True)
        if at:
            held[0] = c
            held[0] = c + taken_off(state, at, w, held, False)[0]
        first = square(L.tsqr(applied(state, at, w, held, alone=True)))
        held[1] = inverse(first, norms)
        second = square(L.tsqr(applied(state, at, w, held, alone=True)))
        held[1] = held[1] @ inverse(second, np.ones(w))
        state = cut(applied(state, at, w, held))
        block = np.vstack([held[0], second @ first])
        table = pa.table({"i": pa.array(range(len(block)), pa.int32()), "at": pa.array([at] * len(block), pa.int32()), "x": L.list_array(block)})
        spark.createDataFrame(table).write.mode("append").parquet(path)
    r = spark.read.schema("i int, at int, x array<double>").parquet(path) if n else spark.createDataFrame([], "i int, at int, x array<double>")
    return of_width(state, n), r


def square(r: np.ndarray) -> np.ndarray:
    """A factor of fewer rows than columns with rows of 0 below."""
    return np.vstack([r, np.zeros((r.shape[1] - len(r), r.shape[1]))])


def rest(x: np.ndarray, at: int, w: int, held: list[np.ndarray]) -> np.ndarray:
    """A panel's columns without what the basis before it holds of them."""
    p = x[:, at : at + w]
    return (p - x[:, :at] @ held[0] if at else p) @ held[1]


def taken_off(state: DataFrame, at: int, w: int, held: list[np.ndarray], first: bool) -> tuple[np.ndarray, np.ndarray]:
    """What the basis before a panel holds of it, and, at first, the norms of its columns."""
    shared = state.sparkSession.sparkContext.broadcast(held)

    def part(b: pa.RecordBatch) -> np.ndarray:
        x = L.block(b)
        y = x[:, at : at + w] if first else rest(x, at, w, shared.value)
        return np.concatenate([(x[:, :at].T @ y).ravel(), (y * y).sum(axis=0)])

    total = L.summed(state.select("x"), part, at * w + w)
    return total[: at * w].reshape(at, w), np.sqrt(total[at * w :])


def applied(state: DataFrame, at: int, w: int, held: list[np.ndarray], alone: bool = False) -> DataFrame:
    """The rows with a panel's columns replaced by what is left of them, or these ``alone``."""
    shared = state.sparkSession.sparkContext.broadcast([h.copy() for h in held])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = L.block(b, "x")
                y = rest(x, at, w, shared.value)
                if not alone:
                    x = x.copy()
                    x[:, at : at + w] = y
                yield pa.RecordBatch.from_arrays([b.column(0), L.list_array(np.ascontiguousarray(y if alone else x))], names=["row_id", "x"])

    return of_width(state.mapInArrow(run, "row_id bigint, x array<double>"), w if alone else width(state))


def factor_entries(r: DataFrame) -> DataFrame:
    """i, j, v of R."""
    return r.select("i", "at", F.posexplode("x").alias("k", "v")).select(F.col("i").cast("bigint").alias("i"), (F.col("at") + F.col("k")).cast("int").alias("j"), "v")
