"""Datasets as tables: fields (field, comp, point_id, t, v), axes (axis, idim, pos, value), splits and scaling."""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import few


def build_x(fields: DataFrame, names: list[str]) -> DataFrame:
    """Long snapshot matrix of some fields (all components): row = point * components + component, in the
    order of ``names`` (name, components)."""
    order = {}
    for n in names:
        name, comps = n if isinstance(n, tuple) else (n, 1)
        for c in range(comps):
            order[f"{name}:{c}"] = len(order)
    at = F.element_at(F.create_map(*(F.lit(x) for kv in order.items() for x in kv)), F.concat_ws(":", "field", F.col("comp").cast("string")))
    return fields.withColumn("c", at).filter("c is not null").select((F.col("point_id") * len(order) + F.col("c")).alias("i"), F.col("t").alias("j"), "v")


def get_dim(long: DataFrame, ndim: int, idim: int) -> DataFrame:
    """One component of an interleaved field."""
    if idim >= ndim:
        raise ValueError("no such component")
    return long.filter(F.col("i") % ndim == idim).select(F.floor(F.col("i") / ndim).cast("bigint").alias("i"), "j", "v")


def mask_columns(long: DataFrame, keep: Column) -> DataFrame:
    return long.filter(keep)


def append_sorted(axis_a: DataFrame, axis_b: DataFrame) -> DataFrame:
    """part, pos, value, at: two parts of an axis, and each entry's place after sorting by value."""
    both = axis_a.withColumn("part", F.lit(0)).unionByName(axis_b.withColumn("part", F.lit(1)))
    return both.withColumn("at", (F.row_number().over(Window.orderBy("value", "part", "pos")) - 1).cast("int"))


def delete_snapshots(long: DataFrame, gone: list[int]) -> DataFrame:
    """Without some columns; the others move up."""
    before = sum((F.when(F.col("j") > g, 1).otherwise(0) for g in gone), F.lit(0))
    return long.filter(~F.col("j").isin(gone)).select("i", (F.col("j") - before).cast("int").alias("j"), "v")


def worksplit(start: int, end: int, workers: int) -> list[tuple[int, int, int]]:
    """worker, from, to: even shares with the remainder to the first; one each if workers suffice."""
    n = end - start
    if workers >= n:
        return [(w, w if w < n else n, w + 1 if w < n else n) for w in range(workers)]
    size, more = divmod(n, workers)
    out, at = [], start
    for w in range(workers):
        to = at + size + (w < more)
        out.append((w, at, to))
        at = to
    return out


def split_sizes(n: int, sizes: Sequence[float]) -> list[int]:
    """Counts from fractions that add up to 1: whole parts, the remainder one by one from the first."""
    if math.isclose(sum(sizes), 1) and sum(sizes) <= 1:
        counts = [math.floor(n * f) for f in sizes]
        for k in range(n - sum(counts)):
            counts[k % len(counts)] += 1
        sizes = counts
    if sum(sizes) != n:
        raise ValueError("sizes don't add up to the number of rows")
    return [int(s) for s in sizes]


def ranked(df: DataFrame, key: str, seed: int | None, rows: int | None = None) -> DataFrame:
    """``df`` with ``rank`` from 0 by a seeded hash of its unique ``key``, or by the key itself without a seed.
    Rows are ranked within ranges of the order, about as many ranges as rows of one, 65,536 at most; only range
    counts meet in one task."""
    h = F.col(key) if seed is None else F.xxhash64(F.col(key), F.lit(seed))
    d = df.withColumn("__h", h)
    if seed is None:
        n = max(2, min(65_536, math.isqrt(df.count() if rows is None else rows)))
        cuts = d.agg(F.percentile_approx(F.col("__h").cast("double"), [i / n for i in range(1, n)], 10 * n).alias("q")).first()["q"] or []
        splits = [-math.inf, *sorted(set(cuts)), math.inf]
        if len(splits) > 2:
            d = Bucketizer(splits=splits, inputCol="__d", outputCol="__b").transform(d.withColumn("__d", F.col("__h").cast("double"))).drop("__d")
        else:
            d = d.withColumn("__b", F.lit(0.0))
        d, part = d.withColumnRenamed("__b", "__r"), F.col("__r").cast("int")
    else:
        part = F.shiftright("__h", 52)
    d = d.withColumn("__p", part)
    before = d.groupBy("__p").agg(F.count("*").alias("n")).withColumn("__o", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    w = Window.partitionBy("__p").orderBy("__h", key)
    return d.join(F.broadcast(before), "__p").withColumn("rank", F.col("__o") + F.row_number().over(w) - 1).drop("__p", "__o", "__h", "__r")


def running_share(df: DataFrame, key: str, value: str, each: int = 4_096) -> DataFrame:
    """``df`` with ``share``: the sum of ``value`` up to each whole-number ``key`` over the sum of all. Ranges of ``each``
    keys run on their own; only their sums meet in one task."""
    d = df.withColumn("__p", F.floor(F.col(key) / each))
    upto = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = d.groupBy("__p").agg(F.sum(value).alias("__s")).select("__p", F.coalesce(F.sum("__s").over(upto), F.lit(0.0)).alias("__o"), F.sum("__s").over(Window.partitionBy()).alias("__t"))
    inner = Window.partitionBy("__p").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return d.join(before, "__p").withColumn("share", (F.col("__o") + F.sum(value).over(inner)) / F.col("__t")).drop("__p", "__o", "__t")


def split_exact(df: DataFrame, key: str, sizes: Sequence[float], seed: int | None = 0) -> DataFrame:
    """``df`` with ``split``: parts of exact sizes."""
    n = df.count()
    counts = split_sizes(n, sizes)
    ends = [sum(counts[: k + 1]) for k in range(len(counts))]
    split = sum((F.when(F.col("rank") >= e, 1).otherwise(0) for e in ends[:-1]), F.lit(0))
    return ranked(df, key, seed, n).withColumn("split", split.cast("int")).drop("rank")


def split_by_parameters(df: DataFrame, parameter: str, sizes: Sequence[float], seed: int | None = 0) -> DataFrame:
    """Rows with equal parameters go to one part."""
    parts = split_exact(df.select(parameter).distinct(), parameter, sizes, seed)
    return df.join(parts, parameter)


def split_reconstruct(n: int, seed: int = 0) -> list[tuple[int, str]]:
    """pos, part of ``n`` samples: 70 % and both ends train, the others take turns between validation and test. The
    samples that train come first by a digest of seed and position."""
    order = sorted(range(n), key=lambda k: hashlib.md5(f"{seed}:{k}".encode()).hexdigest())
    train = set(order[: n * 7 // 10]) | {0, n - 1}
    rest = [k for k in range(n) if k not in train]
    return sorted([(k, "train") for k in train] + [(k, "valid" if p % 2 == 0 else "test") for p, k in enumerate(rest)])


def reduced(df: DataFrame, key: str, value: str, op: Callable[[float, float], float]) -> DataFrame:
    """key, value: each key's values joined by any associative and commutative operation. Tasks join their own rows
    first, so that a key has one row a task when it is shuffled."""
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, `{value}` double"

    def own(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for p in frames:
            for k, v in p.groupby(key, dropna=False)[value]:
                now = functools.reduce(op, v)
                sums[k] = op(sums[k], now) if k in sums else now
        yield pd.DataFrame(list(sums.items()), columns=[key, value])

    part = df.select(key, F.col(value).cast("double").alias(value)).mapInPandas(own, schema)
    return part.groupBy(key).applyInPandas(lambda p: pd.DataFrame([(p[key].iloc[0], functools.reduce(op, p[value]))], columns=[key, value]), schema)


# --- scaling ---------------------------------------------------------------------------------------------


def minmax_fit(df: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    r = df.agg(*(F.min(n).cast("double").alias(f"a{k}") for k, n in enumerate(names)), *(F.max(n).cast("double").alias(f"b{k}") for k, n in enumerate(names))).first()
    return {n: (r[f"a{k}"], r[f"b{k}"]) for k, n in enumerate(names)}


def minmax_scale(df: DataFrame, fitted: dict[str, tuple[float, float]], low: float = 0.0, high: float = 1.0) -> DataFrame:
    return df.withColumns({n: (F.col(n) - a) / ((b - a) or 1.0) * (high - low) + low for n, (a, b) in fitted.items()})


def minmax_inverse(df: DataFrame, fitted: dict[str, tuple[float, float]], low: float = 0.0, high: float = 1.0) -> DataFrame:
    return df.withColumns({n: (F.col(n) - low) / (high - low) * ((b - a) or 1.0) + a for n, (a, b) in fitted.items()})


# --- samples on parameters x points ----------------------------------------------------------------------


def cross_samples(parameters: DataFrame, points: DataFrame) -> DataFrame:
    """idx and the columns of both: sample idx stands at parameter idx / n and point idx % n. ``parameters``
    has par from 0, ``points`` pt from 0; the parameter table is the small one and is broadcast only while it
    has few rows."""
    n = points.count()
    both = points.crossJoin(few(parameters, 10_000))
    return both.withColumn("idx", F.col("par") * n + F.col("pt"))


def grid(df: DataFrame, width: int) -> DataFrame:
    """h, w of row-major positions ``pos``."""
    return df.withColumns({"h": F.floor(F.col("pos") / width).cast("int"), "w": (F.col("pos") % width).cast("int")})


def crop(df: DataFrame, **limits: int) -> DataFrame:
    """Rows inside of a smaller mesh, by its axes' names."""
    for a, n in limits.items():
        df = df.filter(F.col(a) < n)
    return df


def pad(df: DataFrame, key: str, height: int, width: int) -> DataFrame:
    """key, h, w, v on a larger mesh, 0 outside: each sample lists its cells."""
    cells = F.explode(F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), lambda p: F.struct(F.floor(p / width).cast("int").alias("h"), (p % width).cast("int").alias("w"))))
    full = df.select(key).distinct().select(key, cells.alias("c")).select(key, "c.*")
    return full.join(df.select(key, "h", "w", "v"), [key, "h", "w"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def concatenated(a: DataFrame, b: DataFrame) -> DataFrame:
    if len(a.columns) != len(b.columns):
        raise ValueError("datasets of different shapes")
    return a.unionByName(b)


def mapped(df: DataFrame, f, schema: str) -> DataFrame:
    """A function of pandas frames over a dataset."""
    return df.mapInPandas(lambda frames: (f(p) for p in frames), schema)


def filtered(df: DataFrame, condition) -> DataFrame:
    """Rows that hold a column condition, or a function of pandas frames to boolean series."""
    if isinstance(condition, Column):
        return df.filter(condition)
    return df.mapInPandas(lambda frames: (p[condition(p)] for p in frames), df.schema)
