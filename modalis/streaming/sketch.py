"""Streaming randomised QR: columns (time) arrive in blocks, rows stay.

The state is Q and the sketch Y in one table, and B. A new block is joined to it once and adds its sketch to Y, the
basis is made anew, and B is carried over by Q2'Q1. Each block's random matrix comes from seed + block, so a replayed block gives the same state.

States are written by version, that of a version last: a manifest that names its micro-batch, so that

* an empty micro-batch writes nothing and the next one goes on from the version before it;
* a micro-batch that is run again goes on from the last version that an earlier one wrote, and replaces its own;
* a version without a manifest, of a run that broke off, is not seen and is written again.

Rows that a block brings for the first time were 0 before, and rows that it leaves out are 0 in it: neither is dropped.
Of several values of a row in one block the sum counts (rows that arrive in parts). Blocks of a stream have one width each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import matrix as M
from ..functions.lineage import cut
from ..operators import linalg as L


@dataclass
class Sketch:
    """``state``: row_id, q, y; ``b``: Q'X."""

    state: DataFrame
    b: np.ndarray
    blocks: int

    @property
    def q(self) -> DataFrame:
        return self.state.select("row_id", F.col("q").alias("x"))


def combinations(rows: DataFrame, r: int, q: int, seed: int) -> np.ndarray:
    """W such that X W are ``r`` random combinations of the columns, also of a block that has fewer."""
    rng = np.random.default_rng(seed)
    w = L.power_basis(rows, rng.random((M.width(rows), r)), q)
    return w if w.shape[1] == r else w @ rng.random((w.shape[1], r))


def advance(rows: DataFrame, w: np.ndarray, b: np.ndarray | None, blocks: int) -> Sketch:
    """The state after a block. ``rows``: row_id, x of the block and, unless it is the first, q and y of the state."""
    first, n, r = b is None, w.shape[0], w.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(w)

    def sketched(batch: pa.RecordBatch) -> np.ndarray:
        y = L.block(batch) @ shared.value
        return y if first else y + L.block(batch, "y")

    inverse = np.linalg.pinv(L.tsqr(rows, sketched, r), rcond=1e-12)
    factor = rows.sparkSession.sparkContext.broadcast(inverse)

    def products(batch: pa.RecordBatch) -> np.ndarray:
        basis = sketched(batch) @ factor.value
        return basis.T @ (L.block(batch) if first else np.hstack([L.block(batch, "q"), L.block(batch)]))

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = sketched(batch)
                yield pa.RecordBatch.from_arrays([batch.column(0), L.list_array(y @ factor.value), L.list_array(y)], names=["row_id", "q", "y"])

    p = L.summed(rows, products, r * (n if first else r + n)).reshape(r, -1)
    state = cut(rows.mapInArrow(states, "row_id bigint, q array<double>, y array<double>"))
    return Sketch(state, p if first else np.hstack([p[:, :r] @ b, p[:, r:]]), blocks)


def start(rows: DataFrame, r: int, q: int = 1, seed: int = 0) -> Sketch:
    rows = rows.select("row_id", "x")
    return advance(rows, combinations(rows, r, q, seed), None, 1)


def update(s: Sketch, rows: DataFrame, r: int, q: int = 1, seed: int = 0) -> Sketch:
    """One join brings a block to the state; all else are passes over its rows. Rows that only one side has are 0 in the other."""
    n, r_ = M.width(rows), s.b.shape[0]
    zeros = lambda k: F.array_repeat(F.lit(0.0), k)
    both = s.state.join(rows.select("row_id", "x"), "row_id", "full").select("row_id", F.coalesce("q", zeros(r_)).alias("q"), F.coalesce("y", zeros(r_)).alias("y"), F.coalesce("x", zeros(n)).alias("x"))
    both = M.of_width(cut(both), n)
    return advance(both, combinations(both.select("row_id", "x"), r, q, seed + s.blocks), s.b, s.blocks + 1)


def save(s: Sketch, path: str, batch: int | None = None) -> None:
    """A version is complete when its manifest is there: that is written last."""
    at = f"{path}/version={s.blocks:08d}"
    s.state.write.mode("overwrite").parquet(f"{at}/state")
    M.from_small(s.state.sparkSession, s.b).write.mode("overwrite").parquet(f"{at}/b")
    one = s.state.sparkSession.createDataFrame([(s.blocks, s.blocks - 1 if batch is None else batch)], "blocks int, batch long")
    one.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{s.blocks:08d}")


def versions(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(blocks, micro-batch) of the complete versions."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    done = [str(f.getPath()) for f in fs.listStatus(folder) if fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return sorted((r.blocks, r.batch) for r in spark.read.schema("blocks int, batch long").parquet(*done).collect()) if done else []


def load(spark: SparkSession, path: str, blocks: int) -> Sketch:
    at = f"{path}/version={blocks:08d}"
    b = spark.read.parquet(f"{at}/b")
    shape = b.agg(F.max("i"), F.max("j")).first()
    return Sketch(spark.read.parquet(f"{at}/state"), M.small(b, (shape[0] + 1, shape[1] + 1)), blocks)


def latest(spark: SparkSession, path: str, before: int | None = None) -> Sketch | None:
    """The last complete version, or the last one that a micro-batch before ``before`` wrote."""
    done = [v for v, batch in versions(spark, path) if before is None or batch < before]
    return load(spark, path, done[-1]) if done else None


def take(batch: DataFrame, number: int, path: str, r: int, q: int = 1, seed: int = 0) -> None:
    """One micro-batch as a block; an empty one is none."""
    spark = batch.sparkSession
    several = batch.select("row_id", F.posexplode("x").alias("j", "v")).filter(F.col("row_id").isNotNull())
    if several.isEmpty():
        return
    n = batch.agg(F.max(F.size("x"))).first()[0]
    rows = cut(M.dense_rows(several.select(F.col("row_id").alias("i"), "j", "v"), n))
    rows = M.of_width(rows, n)
    before = latest(spark, path, number)
    save(start(rows, r, q, seed) if before is None else update(before, rows, r, q, seed), path, number)


def run(stream: DataFrame, path: str, checkpoint: str, r: int, q: int = 1, seed: int = 0) -> None:
    """A structured stream of blocks (row_id, x): each micro-batch with rows is one block. ``latest`` is the result."""
    query = stream.writeStream.foreachBatch(lambda batch, number: take(batch, number, path, r, q, seed))
    query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
