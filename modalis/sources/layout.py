"""Datasets, meshes and decompositions in Parquet, one directory each.

A dataset is points, axes and fields (partitioned by field and by the part of time that was appended); a mesh
is points and cells; a decomposition is its tall factor in long form by mode, so that a few modes are a pushed
filter, and its small factors. Reading names of fields or numbers of modes prunes files and columns.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import matrix as M
from ..operators.modal import Dynamics, Modes, Spectral


@dataclass
class Dataset:
    """``points`` (point_id, x, y, z), ``axes`` (axis, idim, pos, value), ``fields`` (field, comp, point_id, t, v)."""

    points: DataFrame
    axes: DataFrame
    fields: DataFrame

    def save(self, path: str, part: int = 0, append: bool = False) -> None:
        """Appending writes new times only: the points stay."""
        mode = "append" if append else "overwrite"
        if not append:
            self.points.write.mode(mode).parquet(f"{path}/points")
        self.axes.withColumn("part", F.lit(part)).write.mode(mode).partitionBy("part").parquet(f"{path}/axes")
        self.fields.withColumn("part", F.lit(part)).write.mode(mode).partitionBy("field", "part").parquet(f"{path}/fields")

    def save_unique(self, path: str, order: str) -> None:
        """Points that parts share once, by their global number ``order``."""
        Dataset(self.points.dropDuplicates([order]), self.axes, self.fields).save(path)

    @staticmethod
    def load(spark: SparkSession, path: str, fields: list[str] | None = None, variables: list[str] | None = None) -> Dataset:
        """All or some fields and variables (axes)."""
        f, a = spark.read.parquet(f"{path}/fields"), spark.read.parquet(f"{path}/axes")
        if fields is not None:
            f = f.filter(F.col("field").isin(fields))
        if variables is not None:
            a = a.filter(F.col("axis").isin(variables))
        return Dataset(spark.read.parquet(f"{path}/points"), a, f)

    def samples(self, fields: list[str], variables: list[str], coordinates: bool = True) -> DataFrame:
        """Rows for a network, one for each point and time: point_id, t, the variables' values at that time, the point's
        place if asked for, and the fields. Variables are few rows and are joined by position."""
        by = {n: F.max(F.when(F.col("field") == n, F.col("v"))).alias(n) for n in fields}
        out = self.fields.filter(F.col("field").isin(fields)).groupBy("point_id", "t").agg(*by.values())
        for n in variables:
            out = out.join(self.axes.filter(F.col("axis") == n).select(F.col("pos").alias("t"), F.col("value").alias(n)), "t")
        if coordinates:
            out = out.join(self.points.select("point_id", "x", "y", "z"), "point_id")
        return out.select("point_id", "t", *variables, *(("x", "y", "z") if coordinates else ()), *fields)


def save_mesh(points: DataFrame, cells: DataFrame, path: str) -> None:
    points.write.mode("overwrite").parquet(f"{path}/points")
    cells.write.mode("overwrite").parquet(f"{path}/cells")


def load_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/points"), spark.read.parquet(f"{path}/cells")


def save_modes(m: Modes, path: str) -> None:
    save_tall(m.u, f"{path}/u")
    spark = m.u.sparkSession
    spark.createDataFrame([(k, float(s), [float(x) for x in m.vt[k]]) for k, s in enumerate(m.s)], "mode int, s double, vt array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/sv")


def load_modes(spark: SparkSession, path: str, n: int | None = None) -> Modes:
    sv = spark.read.parquet(f"{path}/sv")
    small = (sv if n is None else sv.filter(F.col("mode") < n)).orderBy("mode").toPandas()
    return Modes(load_tall(spark, f"{path}/u", n), small["s"].to_numpy(), np.vstack(small["vt"].to_numpy()))


def save_small(spark: SparkSession, path: str, **factors: np.ndarray) -> None:
    """Complex or real factors of other decompositions: name, i, j, re, im."""
    rows = [(n, i, j, float(np.real(a[i, j])), float(np.imag(a[i, j]))) for n, f in factors.items() for a in [np.atleast_2d(f)] for i in range(a.shape[0]) for j in range(a.shape[1])]
    spark.createDataFrame(rows, "name string, i int, j int, re double, im double").coalesce(1).write.mode("overwrite").parquet(path)


def load_small(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    out = {}
    for name, f in spark.read.parquet(path).toPandas().groupby("name"):
        a = np.zeros((f["i"].max() + 1, f["j"].max() + 1), complex)
        a[f["i"], f["j"]] = f["re"] + 1j * f["im"]
        out[str(name)] = a.real if not a.imag.any() else a
    return out


def save_tall(rows: DataFrame, path: str) -> None:
    """A tall factor of any decomposition (row_id, x) by column, sorted so that row groups hold few columns."""
    long = M.to_long(rows.select("row_id", "x")).select(F.col("i").alias("row_id"), F.col("j").alias("mode"), "v")
    long.sortWithinPartitions("mode", "row_id").write.mode("overwrite").parquet(path)


def load_tall(spark: SparkSession, path: str, columns: int | None = None) -> DataFrame:
    """All or the first columns of such a factor: a pushed filter."""
    long = spark.read.parquet(path)
    if columns is not None:
        long = long.filter(F.col("mode") < columns)
    return M.to_rows(long.select(F.col("row_id").alias("i"), F.col("mode").alias("j"), "v"))


def save_dynamics(d: Dynamics, path: str) -> None:
    save_tall(d.phi, f"{path}/phi")
    save_small(d.phi.sparkSession, f"{path}/small", mu=d.mu, amplitude=d.amplitude)


def load_dynamics(spark: SparkSession, path: str, modes: int | None = None) -> Dynamics:
    f = load_small(spark, f"{path}/small")
    n = f["mu"].shape[1] if modes is None else modes
    return Dynamics(f["mu"][0, :n].astype(complex), f["amplitude"][0, :n].astype(complex), load_tall(spark, f"{path}/phi", 2 * n))


def save_spectral(m: Spectral, path: str) -> None:
    """Modes by their frequency's place, so that a few frequencies are a few files."""
    m.modes.write.mode("overwrite").partitionBy("f").parquet(f"{path}/modes")
    save_small(m.modes.sparkSession, f"{path}/small", energy=m.energy, frequency=m.frequency, order=m.order.astype(float))


def load_spectral(spark: SparkSession, path: str, frequencies: int | None = None) -> Spectral:
    f = load_small(spark, f"{path}/small")
    n = f["energy"].shape[0] if frequencies is None else frequencies
    order = f["order"][0, :n].round().astype(int)
    modes = spark.read.parquet(f"{path}/modes").select("row_id", F.col("f").cast("int").alias("f"), "x")
    return Spectral(f["energy"][:n], f["frequency"][0, :n], modes.filter(F.col("f").isin(order.tolist())), order)


def save_params(spark: SparkSession, path: str, params: dict[str, object]) -> None:
    """The best settings of a search, as JSON values by name."""
    spark.createDataFrame([(n, json.dumps(v)) for n, v in params.items()], "name string, value string").coalesce(1).write.mode("overwrite").json(path)


def load_params(spark: SparkSession, path: str) -> dict[str, object]:
    return {r["name"]: json.loads(r["value"]) for r in spark.read.json(path, schema="name string, value string").collect()}


def save_model(spark: SparkSession, path: str, weights: list[tuple[np.ndarray, np.ndarray]], settings: dict[str, float]) -> None:
    """A perceptron's layers and its settings."""
    save_small(spark, f"{path}/weights", **{f"{kind}{k}": a for k, pair in enumerate(weights) for kind, a in zip("wb", pair, strict=True)})
    spark.createDataFrame([(n, float(v)) for n, v in settings.items()], "name string, value double").coalesce(1).write.mode("overwrite").json(f"{path}/settings")


def load_model(spark: SparkSession, path: str) -> tuple[list[tuple[np.ndarray, np.ndarray]], dict[str, float]]:
    f = load_small(spark, f"{path}/weights")
    settings = {r["name"]: r["value"] for r in spark.read.json(f"{path}/settings", schema="name string, value double").collect()}
    return [(f[f"w{k}"], f[f"b{k}"][0]) for k in range(len(f) // 2)], settings


def read_polars(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated polars (re, alpha, x, y, cp) with a fixed schema: nothing is inferred."""
    return spark.read.csv(path, sep="\t", schema="re double, alpha double, x double, y double, cp double")


def polar_matrix(polars: DataFrame, cases: list[tuple[float, float]]) -> DataFrame:
    """cp by point and case; the cases are known, so no pass finds them."""
    case = F.concat_ws(":", F.col("re").cast("string"), F.col("alpha").cast("string"))
    return polars.withColumn("case", case).groupBy("x", "y").pivot("case", [f"{a}:{b}" for a, b in cases]).agg(F.first("cp"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def save_scaler(spark: SparkSession, fitted: dict[str, tuple[float, float]], path: str) -> None:
    spark.createDataFrame([(n, a, b) for n, (a, b) in fitted.items()], "name string, low double, high double").coalesce(1).write.mode("overwrite").json(path)


def load_scaler(spark: SparkSession, path: str) -> dict[str, tuple[float, float]]:
    return {r["name"]: (r["low"], r["high"]) for r in spark.read.json(path, schema="name string, low double, high double").collect()}


def vtk_lines(points: DataFrame, values: DataFrame) -> DataFrame:
    """Rows of a legacy ParaView point file, in order: t, section, k, line. ``values``: t, point_id, v."""
    n = points.count()
    times = values.select("t").distinct()
    head = ["# vtk DataFile Version 3.0", "field", "ASCII", "DATASET POLYDATA", f"POINTS {n} double"]
    mid = [f"POINT_DATA {n}", "SCALARS v double 1", "LOOKUP_TABLE default"]
    lines = lambda s, texts: F.explode(F.array(*(F.struct(F.lit(s).alias("section"), F.lit(k).cast("bigint").alias("k"), F.lit(x).alias("line")) for k, x in enumerate(texts))))
    first = times.select("t", lines(0, head).alias("l")).select("t", "l.*")
    third = times.select("t", lines(2, mid).alias("l")).select("t", "l.*")
    place = F.concat_ws(" ", *(F.col(a).cast("string") for a in "xyz"))
    second = times.join(F.broadcast(points.select("point_id", place.alias("line"))) if n <= 100_000 else points.select("point_id", place.alias("line"))).select("t", F.lit(1).alias("section"), F.col("point_id").alias("k"), "line")
    fourth = values.select("t", F.lit(3).alias("section"), F.col("point_id").alias("k"), F.col("v").cast("string").alias("line"))
    return first.unionByName(second).unionByName(third).unionByName(fourth)


def write_vtk(points: DataFrame, values: DataFrame, path: str, rows: int = 1_000_000) -> None:
    """One folder a time, of text files of about ``rows`` lines whose names follow the lines' order: a time of any size
    is written by as many tasks as it has files, and ``cat`` of a folder gives the file for viewers."""
    place = F.floor(F.col("k") / rows)
    parts = vtk_lines(points, values).withColumn("part", F.format_string("%d-%012d", F.col("section"), place))
    ordered = parts.repartition("t", "part").sortWithinPartitions("t", "part", "k")
    ordered.select("t", "part", "line").write.mode("overwrite").partitionBy("t", "part").text(path)
