"""Helpers that the training-data operators share."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.lineage import cut, few, sized

__all__ = ["SPACE", "as_batch", "buckets_for", "cut", "ddl", "few", "map_rows", "running_total", "sized", "stream_rows", "table", "text_batches", "word_count"]

#: Rows of one Arrow batch that goes back to the JVM, and of one that comes from it.
OUT_ROWS, TEXT_ROWS = 2048, 1024
#: ASCII white space, which ends words.
SPACE = r"[\x20\x09-\x0D]+"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), SPACE, -1)
    empty = (F.element_at(parts, 1) == "").cast("int") + (F.element_at(parts, -1) == "").cast("int")
    return F.greatest(F.lit(0), F.size(parts) - empty).cast("long")


def text_batches(spark: SparkSession) -> None:
    """Have Arrow batches hold few rows: a row may be a long text, and a batch is held by both sides."""
    if int(spark.conf.get(BATCH)) > TEXT_ROWS:
        spark.conf.set(BATCH, str(TEXT_ROWS))


def ddl(schema: str) -> StructType:
    return StructType.fromDDL(schema)


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str) -> DataFrame:
    """Map rows to rows in Arrow batches. ``make()`` runs once a task and returns a function from one
    row's values (in ``df``'s column order) to an iterable of output tuples."""
    text_batches(df.sparkSession)
    arrow = to_arrow_schema(ddl(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        out: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.extend(each(*row))
                if len(out) >= OUT_ROWS:
                    yield as_batch(out, arrow)
                    out = []
        if out:
            yield as_batch(out, arrow)

    return df.mapInArrow(run, ddl(schema))


def as_batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def stream_rows(df: DataFrame, run: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """Like :func:`map_rows` for functions that read a task's rows as one stream, in order."""
    text_batches(df.sparkSession)
    arrow = to_arrow_schema(ddl(schema))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for row in run(rows(batches)):
            out.append(row)
            if len(out) >= OUT_ROWS:
                yield as_batch(out, arrow)
                out = []
        if out:
            yield as_batch(out, arrow)

    return df.mapInArrow(whole, ddl(schema))


def running_total(df: DataFrame, group: list[str], order: list[Column], value: Column, out: str, buckets: int) -> DataFrame:
    """Exclusive running total of ``value`` within ``group``, in an order fixed by (bucket, ``order``).

    Buckets spread a group over tasks: each holds the rows of one hash of ``order``, its own running
    total starts at the sum of the buckets before it, and only ``buckets`` sums a group meet in one
    window. Rows with equal ``order`` stand next to each other in any order.
    """
    b = df.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")).withColumn("__v", value)
    sums = b.groupBy(*group, "__b").agg(F.sum("__v").alias("__s"))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*group, "__b", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__o"))
    inner = Window.partitionBy(*group, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        b.withColumn("__i", F.coalesce(F.sum("__v").over(inner), F.lit(0)))
        .join(starts, [*group, "__b"])
        .withColumn(out, (F.col("__o") + F.col("__i")).cast("long"))
        .drop("__b", "__v", "__i", "__o")
    )


def buckets_for(rows: int) -> int:
    """As many buckets as rows of one, so that neither a bucket nor the sums of buckets hold much."""
    return max(8, math.isqrt(rows))
