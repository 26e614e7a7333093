"""Aerodynamic coefficients of surfaces: sums over cells of column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coefficients(surface: DataFrame, by: list[str], area: float, chord: float, centre: tuple[float, float, float], alpha: Column | float, friction: bool = False) -> DataFrame:
    """CL, CD, CM per case. ``surface``: x, y, z, nx, ny, nz (area vectors), cp, and with ``friction`` cfx, cfy,
    cfz. ``alpha`` in degrees."""
    a = (alpha if isinstance(alpha, Column) else F.lit(float(alpha))) * (math.pi / 180)
    size = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    fx, fz = (-F.col("cp") * F.col(f"n{k}") + (F.col(f"cf{k}") * size if friction else F.lit(0.0)) for k in "xz")
    rx, rz = F.col("x") - centre[0], F.col("z") - centre[2]
    return surface.groupBy(*by).agg(
        (F.sum(fz * F.cos(a) - fx * F.sin(a)) / area).alias("cl"),
        (F.sum(fz * F.sin(a) + fx * F.cos(a)) / area).alias("cd"),
        (F.sum(rz * fx - rx * fz) / (area * chord)).alias("cm"),
    )


def pressure_jacobians(surface: DataFrame, area: float, chord: float, centre: tuple[float, float, float], alpha: Column | float) -> DataFrame:
    """Sensitivities of the coefficients to each cell's pressure."""
    a = (alpha if isinstance(alpha, Column) else F.lit(float(alpha))) * (math.pi / 180)
    nx, nz = F.col("nx"), F.col("nz")
    return surface.withColumns({
        "dcl": (nx * F.sin(a) - nz * F.cos(a)) / area,
        "dcd": (-nx * F.cos(a) - nz * F.sin(a)) / area,
        "dcm": ((F.col("x") - centre[0]) * nz - (F.col("z") - centre[2]) * nx) / (area * chord),
    })
