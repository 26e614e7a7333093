"""Series and spectra. Series are long: s (series), pos, v."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hamming_window(n: int) -> np.ndarray:
    return 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / (n - 1))


def power_spectrum(series: DataFrame, n: int, t0: float, t1: float, last: float, equispaced: bool = True) -> DataFrame:
    """s, k, f, psd of series of length ``n``. Equispaced: frequencies of the sample step. Otherwise the
    transform runs over nodes -1/2 + pos / n and frequencies (k - (n - 1) / 2) / last, which is a shifted
    transform of the plain sequence. Each sample meets its n frequencies in its own row: no join, and the sums
    are combined before the shuffle."""
    k = series.select("s", "v", "pos", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    if equispaced:
        # k pos mod n keeps the angle small, and the cosine exact for large products.
        angle = F.pmod(F.col("k") * F.col("pos"), F.lit(n)) * (2 * math.pi / n)
        f = F.col("k") / ((t1 - t0) * n)
    else:
        angle = (F.col("k") - n // 2) * (F.col("pos") / n - 0.5) * (2 * math.pi)
        f = (F.col("k") - (n - 1) / 2) / last
    re, im = F.sum(F.col("v") * F.cos(angle)), F.sum(F.col("v") * F.sin(angle))
    return k.groupBy("s", "k").agg(((re * re + im * im) / n).alias("psd")).select("s", "k", f.alias("f"), "psd")


def row_spectra(rows: DataFrame, step: float) -> DataFrame:
    """row_id, x: power spectra of dense rows by fast transforms in Arrow batches."""

    def run(frames):
        for p in frames:
            x = np.vstack(p["x"].to_numpy()) if len(p) else np.zeros((0, 1))
            y = np.fft.fft(x, axis=1)
            p["x"] = list((y * y.conj()).real / x.shape[1])
            yield p

    return rows.select("row_id", "x").mapInPandas(run, "row_id bigint, x array<double>")


def delay_embedding(series: DataFrame, dimension: int) -> DataFrame:
    """s, pos, d, v: the last ``dimension`` values up to each position, zeros before the start."""
    w = Window.partitionBy("s").orderBy("pos")
    lags = [F.lag("v", dimension - 1 - d, 0.0).over(w).alias(f"d{d}") for d in range(dimension)]
    wide = series.select("s", "pos", F.array(*lags).alias("x"))
    return wide.select("s", "pos", F.posexplode("x").alias("d", "v"))


def delay_rows(rows: DataFrame, dimension: int) -> DataFrame:
    """The same over array rows, without a shuffle: row_id, x as an array of embedded vectors."""
    padded = F.concat(F.array_repeat(F.lit(0.0), dimension - 1), F.col("x"))
    return rows.select("row_id", F.transform(F.sequence(F.lit(1), F.size("x")), lambda t: F.slice(padded, t, F.lit(dimension))).alias("x"))


def welch_blocks(series: DataFrame, length: int, n: int, overlap: int) -> DataFrame:
    """s, block, pos (within the block), v: overlapping blocks; each sample lists its own."""
    step = n - overlap
    blocks = (length - overlap) // step
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - n + 1) / step))
    last = F.least(F.lit(blocks - 1), F.floor(F.col("pos") / step))
    b = series.filter(first <= last).withColumn("block", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    return b.select("s", "block", (F.col("pos") - F.col("block") * step).cast("int").alias("pos"), "v")


def fill_series(counts: DataFrame, start, hours: int) -> DataFrame:
    """pos, v: an hourly series without holes; ``counts``: hour (timestamp), v."""
    grid = counts.sparkSession.range(hours).select(F.col("id").cast("int").alias("pos"))
    at = F.floor((F.unix_timestamp("hour") - F.lit(int(start))) / 3600).cast("int")
    return grid.join(counts.select(at.alias("pos"), "v"), "pos", "left").select("pos", F.coalesce("v", F.lit(0.0)).alias("v"))
