"""Column functions over a row's array and over scalars: no shuffle, no Python workers."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Half-up rounding without negative zero, for results that are compared across engines."""
    return F.round(c, digits) + F.lit(0.0)


def total(x: Column | str) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def vector_sum(x: Column | str, start: int = 0) -> Column:
    return total(F.slice(x, start + 1, F.size(x)))


def vector_norm(x: Column | str, start: int = 0) -> Column:
    return F.sqrt(F.aggregate(F.slice(x, start + 1, F.size(x)), F.lit(0.0), lambda s, v: s + v * v))


def vector_mean(x: Column | str, start: int = 0) -> Column:
    return vector_sum(x, start) / (F.size(x) - start)


def temporal_mean(x: Column | str) -> Column:
    return total(x) / F.size(x)


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once: what a lambda refers to is evaluated for every element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def temporal_variance(x: Column | str) -> Column:
    """Population variance of the entries."""
    return bind(temporal_mean(x), lambda m: F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / F.size(x))


def subtract_mean(x: Column | str) -> Column:
    return bind(temporal_mean(x), lambda m: F.transform(x, lambda v: v - m))


def norm_variance(x: Column | str) -> Column:
    """Centred entries over the variance (not its root). A constant row gives NaN, as 0/0 does."""
    moments = F.struct(temporal_mean(x).alias("m"), temporal_variance(x).alias("s"))
    return bind(moments, lambda k: F.transform(x, lambda v: F.when(k["s"] == 0, F.lit(float("nan"))).otherwise((v - k["m"]) / k["s"])))


def residual_curve(x: Column | str) -> Column:
    """The norm of what stands from each entry on, over that of all."""
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("out"))
    sums = F.aggregate(F.reverse(x), start, lambda a, v: F.struct((a["s"] + v * v).alias("s"), F.array_append(a["out"], a["s"] + v * v).alias("out")))
    return bind(sums, lambda a: F.transform(F.reverse(a["out"]), lambda v: F.sqrt(v / a["s"])))


def row_max(x: Column | str) -> Column:
    return F.array_max(x)


def hamming(i: Column | str, n: int | Column) -> Column:
    return 0.54 - 0.46 * F.cos(2 * math.pi * F.col(i) / (n - 1)) if isinstance(i, str) else 0.54 - 0.46 * F.cos(2 * math.pi * i / (n - 1))


def next_power_of_2(n: Column) -> Column:
    """The least power of two that is not below ``n``; 1 for what is below 2."""
    return F.when(n < 2, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n.cast("long") - 1))))


def modulus(re: Column, im: Column) -> Column:
    return F.sqrt(re * re + im * im)


def complex_power(re: Column, im: Column, k: Column) -> tuple[Column, Column]:
    """(re + i im) ** k through its polar form; 0 ** 0 is 1."""
    r, a = modulus(re, im), F.atan2(im, re)
    p = F.when((r == 0) & (k == 0), F.lit(1.0)).otherwise(F.pow(r, k))
    return p * F.cos(a * k), p * F.sin(a * k)


def cross(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def dot(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])


def clip(c: Column, low: Column | float, high: Column | float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def beta_schedule(epoch: Column, start: float, end: float, first: int, warmup: int) -> Column:
    """0 before ``first``, then linear up to ``warmup``, then ``end``."""
    return F.when(epoch < first, F.lit(0.0)).when(epoch < warmup, start + (end - start) * (epoch - first) / (warmup - first)).otherwise(F.lit(float(end)))


def thickness_factor(h: Column, h0: Column | float, k: float) -> Column:
    """Penalty of a thickness away from its reference."""
    d = h / h0 - 1
    return F.exp(-k * d * d)


def chebyshev(x: Column, degree: int) -> list[Column]:
    """T_0 .. T_degree by their three-term recurrence, unrolled."""
    t = [F.lit(1.0), x]
    while len(t) <= degree:
        t.append(2 * x * t[-1] - t[-2])
    return t[: degree + 1]


def jacobi(x: Column, degree: int, a: float = 1.0, b: float = 1.0) -> list[Column]:
    """P_0 .. P_degree with parameters ``a`` and ``b``."""
    p = [F.lit(1.0), ((a - b) + (a + b + 2) * x) / 2]
    for n in range(2, degree + 1):
        c = 2 * n + a + b
        lead = 2 * n * (n + a + b)
        linear = c * (c - 1) / lead
        constant = (c - 1) * (a * a - b * b) / (lead * (c - 2))
        back = 2 * (n + a - 1) * (n + b - 1) * c / (lead * (c - 2))
        p.append((linear * x + constant) * p[-1] - back * p[-2])
    return p[: degree + 1]
