"""Cutting lineage: what iterations need is written to the folder in ``spark.checkpoint.dir``, which all machines
share, so that lost executors cost a read and not the work again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files for each core at most while files hold fewer rows than the most, and the least and the most rows of one, about.
FILES_A_CORE, LEAST_ROWS, ROWS_A_FILE = 2, 10_000, 100_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Only a local session without the setting gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="modalis-checkpoint-")
    sc.setCheckpointDir(shared)


def files_for(spark: SparkSession, rows: int) -> int:
    """Files of a table of about ``rows`` small rows: each partition is one, so a small table is to have a few."""
    return max(1, min(FILES_A_CORE * spark.sparkContext.defaultParallelism, -(-rows // LEAST_ROWS)), -(-rows // ROWS_A_FILE))


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of about ``rows`` small rows, for writing, dealt to few partitions by a shuffle: what makes the rows keeps
    its own tasks, as many as there are."""
    return df.repartition(files_for(df.sparkSession, rows))


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df``, read from the checkpoint folder. ``rows``: about how many rows a join or an aggregate of small rows gives,
    whose last stage then runs in as many tasks as files; not for what Python or a pass over texts makes."""
    ensure_checkpoint_dir(df.sparkSession)
    if rows is not None and (files := files_for(df.sparkSession, rows)) < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        df = df.coalesce(files)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """A folder of one's own in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def written(df: DataFrame, *by: str) -> DataFrame:
    """``df`` as a table in the checkpoint folder, with a folder for each value of ``by`` (few values): what is filtered by
    them is not read. Its rows are dealt by these values and a hash of all, so that a value's files are few and many."""
    path, spark = scratch(df.sparkSession), df.sparkSession
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(spark.sparkContext.defaultParallelism))
    df.repartition(*by, salt).write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` for a join: to be broadcast if it has at most ``most`` rows, else left to the planner."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
