"""Connected components by alternating large-star and small-star steps, as joins and minima by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """node, label: the least node reachable from each node of ``edges`` (a, b longs); nodes without an
    edge don't occur. Every round is three shuffles by node; rounds grow with the logarithm of the longest
    path. Minima are combined before the shuffle, so a node with very many edges costs no more. ``rows``: about how
    many edges there are, if known."""
    now = cut(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u < v").distinct(), rows)
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum("u").cast("decimal(38,0)").alias("s"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h")).first()
        if state == before:
            break
        before = state
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select("v", F.col("m").alias("u")).filter("u < v").distinct()
        small = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(small, "v")
        now = cut(joined.select("v", F.col("m").alias("u")).unionByName(joined.select(F.col("u").alias("v"), F.col("m").alias("u"))).filter("u < v").distinct(), rows)
    labels = now.select(F.col("v").alias("node"), F.col("u").alias("label"))
    roots = now.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct()
    return labels.unionByName(roots)
