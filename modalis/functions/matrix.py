"""The three forms of a matrix and the ways between them.

Rows: ``row_id bigint, x array<double>``, all arrays of one length. Long: ``i bigint, j int, v double``. Small:
a NumPy array on the driver, for factors whose size is the number of columns or modes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Entries that one task adds up and puts into rows, about.
CELLS_A_TASK = 2**19


def to_long(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("row_id").alias("i"), F.posexplode("x").alias("j", "v"))


def to_rows(long: DataFrame) -> DataFrame:
    """Rows in column order. Columns without an entry are left out: fill them first."""
    return long.groupBy(F.col("i").alias("row_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda s: s["v"]).alias("x"))


def added_up(long: DataFrame) -> DataFrame:
    """i, j, v: entries at the same place add up, before they meet where they can. A task holds its cells for that, so there
    are to be as many tasks as the entries need. What an aggregate sends goes to as many tasks as the session says or fewer;
    of more entries than these hold, those of a row that one task had add up first, then those of a row."""
    conf, parallel = long.sparkSession.conf, long.sparkSession.sparkContext.defaultParallelism
    tasks = -(-long.count() // CELLS_A_TASK)
    if tasks <= min(int(conf.get("spark.sql.shuffle.partitions")), parallel):
        return long.groupBy("i", "j").agg(F.sum("v").alias("v"))
    some = long.select("i", "j", "v", F.spark_partition_id().alias("had")).repartition(tasks, "i", "had").groupBy("i", "j", "had").agg(F.sum("v").alias("v"))
    return some.select("i", "j", "v").repartition(tasks, "i").groupBy("i", "j").agg(F.sum("v").alias("v"))


def dense_rows(long: DataFrame, columns: int) -> DataFrame:
    """Rows of ``columns`` entries; absent ones are 0. Entries at the same place add up. A row is put together from its
    entries in order and the gaps between them."""
    cells = added_up(long)
    held = cells.groupBy(F.col("i").alias("row_id")).agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("__e"))
    before = lambda k: F.when(k == 0, F.lit(-1)).otherwise(F.get(F.col("__e"), k - 1)["j"])
    parts = F.flatten(F.transform("__e", lambda e, k: F.concat(F.array_repeat(F.lit(0.0), (e["j"] - before(k) - 1).cast("int")), F.array(e["v"]))))
    rest = F.array_repeat(F.lit(0.0), (columns - 1 - F.element_at("__e", -1)["j"]).cast("int"))
    return of_width(held.select("row_id", F.concat(parts, rest).alias("x")), columns)


def of_width(rows: DataFrame, columns: int) -> DataFrame:
    """``rows`` with the length of its arrays in the column's metadata, so that no job has to find it."""
    return rows.withMetadata("x", {"width": columns})


def width(rows: DataFrame) -> int:
    known = rows.schema["x"].metadata.get("width")
    if known is not None:
        return int(known)
    first = rows.select(F.size("x").alias("n")).first()
    return 0 if first is None else int(first["n"])


def small(long: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """A small factor on the driver."""
    out = np.zeros(shape)
    for i, j, v in long.select("i", "j", "v").toPandas().itertuples(index=False):
        out[int(i), int(j)] = v
    return out


def from_small(spark: SparkSession, a: np.ndarray) -> DataFrame:
    a = np.atleast_2d(a)
    return spark.createDataFrame([(i, j, float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])], "i bigint, j int, v double")
