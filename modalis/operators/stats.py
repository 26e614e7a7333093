"""Reductions over matrices in long form and over columns of observations: one aggregate each."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """i, j, a, b: the entries of two long matrices side by side."""
    return a.select("i", "j", F.col("v").alias("a")).join(b.select("i", "j", F.col("v").alias("b")), ["i", "j"])


def rmse(relative: bool = True) -> Column:
    """Over columns ``a`` and ``b``; relative to the norm of the first."""
    e = F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b")))
    return F.sqrt(e / F.sum(F.col("a") * F.col("a"))) if relative else F.sqrt(e / F.count("*"))


def mae() -> Column:
    return F.avg(F.abs(F.col("a") - F.col("b")))


def r2() -> Column:
    e = F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b")))
    return 1 - e / (F.count("*") * F.var_pop("a"))


def energy() -> Column:
    """The share of the first's energy that the second holds."""
    return 1 - F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))) / F.sum(F.col("a") * F.col("a"))


def mre_array(pairs: DataFrame, axis: int) -> DataFrame:
    """Squared error over squared second argument: per row (axis 1) or per column (axis 0)."""
    e = F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))) / F.sum(F.col("b") * F.col("b"))
    return pairs.groupBy("i" if axis == 1 else "j").agg(e.alias("mre"))


#: Values that the driver gathers for an exact quantile at most, and the accuracy of the sketches that narrow them down.
GATHERED, ACCURACY = 100_000, 20_000


def percentiles(rows: DataFrame, value: Column, at: list[float]) -> list[float | None]:
    """Exact percentiles, interpolated as ``percentile`` does, for any number of distinct values: sketches tell an interval
    around each place, a pass counts what is below and in it, until few values are left to be gathered. Nulls are left out."""
    v = rows.select(value.cast("double").alias("v")).filter("v is not null")
    n = v.count()
    if not n:
        return [None] * len(at)
    places = [p * (n - 1) for p in at]
    found: dict[int, float] = {}
    # An open interval, the values below it, and those inside, by rank.
    left = {k: (None, None, 0, n) for x in places for k in {math.floor(x), math.ceil(x)}}

    def inside(low: float | None, high: float | None) -> Column:
        return (F.lit(True) if low is None else F.col("v") > low) & (F.lit(True) if high is None else F.col("v") < high)

    while left:
        few = {k: s for k, s in left.items() if s[3] <= GATHERED}
        for low, high, before in {s[:3] for s in few.values()}:
            total = before
            for r in sorted(v.filter(inside(low, high)).groupBy("v").count().collect(), key=lambda r: (math.isnan(r["v"]), r["v"])):
                total += r["count"]
                found |= {k: r["v"] for k, s in few.items() if s[:3] == (low, high, before) and total - r["count"] <= k < total}
        left = {k: s for k, s in left.items() if k not in few}
        if not left:
            break
        spans = list(left.items())
        share = lambda k, s, off: min(1.0, max(0.0, (k - s[2]) / s[3] + off))
        off = 3 / ACCURACY
        two = v.agg(*(F.percentile_approx(F.when(inside(*s[:2]), F.col("v")), [share(k, s, -off), share(k, s, off)], ACCURACY).alias(f"q{c}") for c, (k, s) in enumerate(spans))).first()
        kinds = []
        for c, (_, s) in enumerate(spans):
            a, b = two[f"q{c}"]
            some = inside(*s[:2])
            kinds += [(f"a{c}", some & (F.col("v") < a)), (f"b{c}", some & (F.col("v") == a)), (f"c{c}", some & (F.col("v") > a) & (F.col("v") < b)), (f"d{c}", some & (F.col("v") > a) & (F.col("v") == b))]
        counts = v.agg(*(F.count(F.when(x, 1)).alias(name) for name, x in kinds)).first()
        for c, (k, (low, high, before, held)) in enumerate(spans):
            a, b = two[f"q{c}"]
            ends = [before]
            for x in "abcd":
                ends.append(ends[-1] + counts[f"{x}{c}"])
            part = sum(k >= e for e in ends[1:])
            if part in (1, 3):
                found[k] = a if part == 1 else b
                del left[k]
            else:
                left[k] = {0: (low, a, ends[0], ends[1] - ends[0]), 2: (a, b, ends[2], ends[3] - ends[2]), 4: (b, high, ends[4], before + held - ends[4])}[part]
    between = lambda x, a, b: found[a] if a == b or found[a] == found[b] else (b - x) * found[a] + (x - a) * found[b]
    return [float(between(x, math.floor(x), math.ceil(x))) for x in places]


def regression_metrics(rows: DataFrame, tolerance: float = 1e-4, exact: bool = True) -> DataFrame:
    """One row of metrics over columns ``y`` and ``p``. The relative error and the l2 error are taken against
    the prediction, which is how the evaluator is called. Exact quantiles take a few passes
    more (``percentiles``): without ``exact`` they come from a sketch of bounded size."""
    d = F.col("y") - F.col("p")
    at = [0.95, 0.99]
    m = rows.agg(
        F.avg(d * d).alias("mse"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        F.avg(F.abs(d)).alias("mae"),
        (F.avg(F.abs(d / (F.col("p") + tolerance))) * 100).alias("mre"),
        (F.array(*(F.lit(q).cast("double") for q in percentiles(rows, F.abs(d), at))) if exact else F.percentile_approx(F.abs(d), at, 10_000)).alias("q"),
        (1 - F.sum(d * d) / (F.count("*") * F.var_pop("y"))).alias("r2"),
        F.sqrt(F.sum(d * d) / F.sum(F.col("p") * F.col("p"))).alias("l2_error"),
    )
    return m.select("mse", "rmse", "mae", "mre", F.col("q")[0].alias("ae_95"), F.col("q")[1].alias("ae_99"), "r2", "l2_error")


def summary(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, low, high, mean of each column, NaN left out: one pass over all."""
    parts = []
    for f in fields:
        v = F.when(~F.isnan(f), F.col(f))
        parts.append(F.struct(F.lit(f).alias("field"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean")))
    return df.agg(F.array(*parts).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def similarity(rows: DataFrame, by: list[str]) -> DataFrame:
    """Reconstruction metrics of samples over columns ``a`` (truth) and ``b``: energy, and how alike means and
    sample deviations are."""

    def alike(x: Column, y: Column) -> Column:
        return 2 * x * y / (x * x + y * y)

    return rows.groupBy(*by).agg(energy().alias("energy"), alike(F.avg("a"), F.avg("b")).alias("mean_similarity"), alike(F.stddev_samp("a"), F.stddev_samp("b")).alias("std_similarity"))


def episode_summary(rows: DataFrame) -> DataFrame:
    """Median, inter-quartile range, mean and deviation of ``best`` over converged episodes."""
    return rows.filter("converged").agg(
        F.count("*").alias("n"),
        F.percentile("best", 0.5).alias("median"),
        (F.percentile("best", 0.75) - F.percentile("best", 0.25)).alias("iqr"),
        F.avg("best").alias("mean"),
        F.stddev_pop("best").alias("std"),
    )
