"""Files and tasks: small results in few files, while what makes them runs in the tasks of its scan."""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from modalis.functions import lineage


def with_task(df):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([TaskContext.get().partitionId()] * b.num_rows, pa.int32())], names=["id", "task"])

    return df.mapInArrow(run, "id bigint, task int")


def test_small_results_are_few_files_and_passes_keep_their_tasks(spark):
    made = with_task(spark.range(0, 900, 1, 9))
    out = lineage.sized(made, 900)
    assert out.rdd.getNumPartitions() == 1
    assert out.select("task").distinct().count() == 9 and out.count() == 900
    kept = lineage.cut(made)
    assert kept.rdd.getNumPartitions() == 9 and kept.select("task").distinct().count() == 9


def test_files_grow_with_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    got = [lineage.files_for(spark, n) for n in (0, 1, 10_000, 10_001, 10**6, 10**9)]
    assert got == [1, 1, 1, 2, max(10, min(2 * cores, 100)), 10_000]


def test_written_tables_are_pruned_by_their_folders(spark):
    t = lineage.written(spark.range(1000).select("id", (F.col("id") % 3).cast("int").alias("k")), "k")
    one = t.filter("k = 1")
    assert one.count() == 333 and t.count() == 1000 and t.columns == ["id", "k"]
    assert "PartitionFilters: [isnotnull(k" in one._jdf.queryExecution().toString()
