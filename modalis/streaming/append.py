"""Appending instants to a stored field from a stream.

Each micro-batch of values (row_id, t, v) is written to a folder of its own number, and a manifest names it when it is
complete. So a batch that is run again replaces itself, one that broke off is not seen, and an empty one leaves nothing.
A value that arrives again for the same place and instant, late or corrected, takes the place of those of earlier batches;
of several in one batch the greatest stands, so that reading does not hang on the order of rows. Nothing that is stored
is read to append to it. A null row_id or t is no place and is left out; a null v is a value that is missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VALUES = "row_id bigint, t int, v double"


def take(batch: DataFrame, number: int, path: str) -> None:
    """One micro-batch. ``t`` is kept sorted within files, so that reading a span of instants skips the others' row groups."""
    rows = batch.select(F.col("row_id").cast("bigint"), F.col("t").cast("int"), F.col("v").cast("double")).filter("row_id is not null and t is not null")
    at = f"{path}/batch={number:012d}"
    if rows.isEmpty():
        return
    one = rows.groupBy("row_id", "t").agg(F.max("v").alias("v"))
    one.sortWithinPartitions("t", "row_id").write.mode("overwrite").parquet(f"{at}/values")
    spark = batch.sparkSession
    spark.createDataFrame([(number,)], "batch long").coalesce(1).write.mode("overwrite").parquet(f"{at}/manifest")


def batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete batches."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    named = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("batch=")]
    return sorted(int(p.getName()[6:]) for p in named if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "manifest/_SUCCESS")))


def read(spark: SparkSession, path: str) -> DataFrame:
    """row_id, t, v: of each place and instant the value of the last batch that has one."""
    done = batches(spark, path)
    if not done:
        return spark.createDataFrame([], VALUES)
    every = spark.read.schema(VALUES).parquet(*(f"{path}/batch={n:012d}/values" for n in done))
    number = F.regexp_extract(F.col("_metadata.file_path"), r"batch=(\d+)/", 1).cast("long")
    last = every.select("row_id", "t", F.struct(number.alias("batch"), "v").alias("x")).groupBy("row_id", "t").agg(F.max("x").alias("x"))
    return last.select("row_id", "t", F.col("x.v").alias("v"))


def run(stream: DataFrame, path: str, checkpoint: str) -> None:
    query = stream.writeStream.foreachBatch(lambda batch, number: take(batch, number, path))
    query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
