"""Gappy decomposition: 0 means missing. Normal equations are sums over all rows of a snapshot, not over a
task's share of them."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import cut
from ..functions.matrix import width
from . import linalg as L
from .modal import Modes, pod, truncate

#: Numbers of the sums that a task holds at a time, about.
ENTRIES = 2_000_000


def masked_solutions(basis: DataFrame, data: DataFrame, ridge: float | None) -> np.ndarray:
    """Coefficients (modes x snapshots) that fit the observed entries of each column of ``data`` (row_id, x) by
    the columns of ``basis`` (row_id, x). Rows go to blocks of snapshots, of which each has a few tasks; a task adds up its
    masked products for one block at a time, at most about ENTRIES numbers, and one task a block adds those of all tasks
    and solves each snapshot's equations. The driver gets the coefficients."""
    r, n = width(basis), width(data)
    L.checked_size(r * n)
    if not r or not n:
        return np.zeros((r, n))
    each = min(n, max(1, ENTRIES // (r * (r + 1))))
    blocks = -(-n // each)
    tasks = int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = max(1, tasks // blocks)
    both = basis.withColumnRenamed("x", "u").join(data, "row_id")
    sent = both.select(F.pmod(F.xxhash64("row_id"), F.lit(shares)).cast("int").alias("share"), "u", "x", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    sent = sent.select("block", "share", "u", F.slice("x", F.col("block") * each + 1, each).alias("x"))

    def rows_of(key: tuple, full: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([full.tobytes()], pa.binary())], names=["block", "full"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, full = None, None
        for b in batches:
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            for key, group in itertools.groupby(range(len(keys)), key=keys.__getitem__):
                some = list(group)
                part = b.slice(some[0], len(some))
                u, x = L.block(part, "u"), L.block(part, "x")
                products = np.einsum("ra,rb,rt->tab", u, u, (x != 0).astype(float), optimize=True)
                products = np.concatenate([products, np.einsum("ra,rt->ta", u, x)[:, :, None]], axis=2)
                if key != at:
                    if at is not None:
                        yield rows_of(at, full)
                    at, full = key, products
                else:
                    full += products
        if at is not None:
            yield rows_of(at, full)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, full = None, None
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                products = np.frombuffer(data).reshape(-1, r, r + 1)
                if block != at:
                    if at is not None:
                        yield solved(at, full)
                    at, full = block, products.copy()
                else:
                    full += products
        if at is not None:
            yield solved(at, full)

    def solved(block: int, full: np.ndarray) -> pa.RecordBatch:
        c = np.stack([np.linalg.lstsq(f[:, :r] + (ridge or 0) * np.eye(r), f[:, r], rcond=None)[0] for f in full])
        return pa.RecordBatch.from_arrays([pa.array(range(block * each, block * each + len(c)), pa.int32()), L.list_array(c)], names=["t", "c"])

    sums = sent.repartition(min(tasks, blocks * shares), "block", "share").sortWithinPartitions("block", "share").mapInArrow(add, "block int, full binary")
    found = sums.repartition(min(tasks, blocks), "block").sortWithinPartitions("block").mapInArrow(solve, "t int, c array<double>")
    out = np.zeros((r, n))
    for b in found.toArrow().to_batches():
        out[:, b.column(0).to_numpy()] = L.block(b, "c").T
    return out


@dataclass
class GappyPOD:
    """Fill gaps by least squares or ridge regression on scaled modes."""

    centred: bool = False
    truncation: float | None = -0.99
    ridge: float | None = 0.01

    def fit(self, rows: DataFrame) -> GappyPOD:
        m: Modes = pod(rows, remove_mean=self.centred)
        m = truncate(m, self.truncation) if self.truncation is not None else m
        k = len(m.u.select("x").first()["x"])
        self.modes = Modes(m.u, m.s[:k], m.vt[:k])
        self.basis = m.u.select("row_id", F.zip_with("x", F.array(*map(F.lit, m.s[:k].tolist())), lambda x, s: x * s).alias("x"))
        self.means = rows.select("row_id", F.aggregate("x", F.lit(0.0), lambda s, v: s + v).alias("t"), F.size("x").alias("n")).select("row_id", (F.col("t") / F.col("n")).alias("m"))
        return self

    def predict(self, gappy: DataFrame) -> DataFrame:
        """row_id, x: all entries of each column from its observed ones."""
        if self.centred:
            gappy = gappy.join(self.means, "row_id").select("row_id", F.transform("x", lambda v: F.when(v == 0, 0.0).otherwise(v - F.col("m"))).alias("x"))
        out = L.times(self.basis, masked_solutions(self.basis, gappy, self.ridge))
        if self.centred:
            out = out.join(self.means, "row_id").select("row_id", F.transform("x", lambda v: v + F.col("m")).alias("x"))
        return out


def observed_mean_fill(rows: DataFrame) -> DataFrame:
    """Missing entries get the mean of their row's observed ones; NaN where it has none."""
    n = F.size(F.filter("x", lambda v: v != 0))
    mean = F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / F.when(n > 0, n)
    return rows.select("row_id", F.transform("x", lambda v: F.when(v == 0, F.coalesce(mean, F.lit(float("nan")))).otherwise(v)).alias("x"))


def reconstruct_full_set(rows: DataFrame, iterations: int, truncation: float = -0.99, ridge: float | None = None) -> tuple[DataFrame, np.ndarray]:
    """Refill the gaps of a whole set: start from means, then fit on the filled set and replace the gaps, again
    and again. Observed entries never change. Each iteration
    is materialised. Also the spectrum S after each."""
    filled, spectra = observed_mean_fill(rows), []
    for _ in range(iterations):
        model = GappyPOD(truncation=truncation, ridge=ridge).fit(filled)
        spectra.append(model.modes.s)
        guess = model.predict(rows).withColumnRenamed("x", "g")
        filled = rows.join(guess, "row_id").select("row_id", F.zip_with("x", "g", lambda x, g: F.when(x == 0, g).otherwise(x)).alias("x"))
        filled = cut(filled)
    return filled, spectra


def zero_fraction(vector: DataFrame, percent: float, seed: int = 0) -> DataFrame:
    """i, v with exactly int(n percent / 100) entries set to 0: those that come first by a hash of the seed. Only
    a threshold is ranked, by counts of hash classes, so that no task sorts all rows."""
    n = vector.count()
    k = int(n * percent / 100)
    h = vector.withColumn("__h", F.xxhash64("i", F.lit(seed))).withColumn("__c", F.shiftright("__h", 52))
    classes = h.groupBy("__c").agg(F.count("*").alias("n"))  # 4096 at most
    before = classes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = h.join(F.broadcast(before), "__c").withColumn("r", F.col("before") + F.row_number().over(Window.partitionBy("__c").orderBy("__h", "i")))
    return ranked.select("i", F.when(F.col("r") <= k, 0.0).otherwise(F.col("v")).alias("v"))
