"""Sharding by vector bin packing.

Documents with equal texts form a group, and a group is placed whole: only one that is heavier, in bytes, tokens
or rows, than ``WHOLE`` of a shard's capacity is dealt into chunks by its ids, so that a group of copies of any
size spreads over tasks and shards. Units (groups or chunks) go, largest first, each to the shard whose residual
capacity has the highest dot product with the unit's (bytes, tokens, rows). Units above one part in ``UNIT_SHARE``
of the whole are few and placed together first, and exchanges between the fullest and the emptiest shard even out
their bytes; every task then places its own light ones, against what the
heavy ones left of each shard, in proportion to what the task holds.

Defined cases: a null text counts as empty (size 1); repeated rows are placed one by one; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_for, cut, running_total, sized, table, word_count

SHARDS = 16
#: Units above one part in so many of all bytes, tokens or rows are placed together; chunks are of about that size.
UNIT_SHARE = 16_384
#: The share of a shard's capacity up to which a group of copies is placed whole.
WHOLE = 0.5
#: The gap between shards, as a share of one, at which exchanges end, and how many there are at most.
EVEN, EXCHANGES = 1e-4, 2_000


def place(units: np.ndarray, shards: int, turn: int = 0, left: np.ndarray | None = None) -> np.ndarray:
    """Shard of each row of ``units`` (any non-negative measures). Ties go round from ``turn``. ``left``: shares of
    ``units`` that shards have room for, equal ones if not given."""
    total = units.sum(axis=0, dtype=np.float64)
    v = units / np.where(total > 0, total, 1)
    out = np.empty(len(v), np.int32)
    left = np.full((shards, v.shape[1]), 1.0 / shards) if left is None else left.copy()
    for i in np.argsort(-v.max(axis=1), kind="stable"):
        score = np.roll(left @ v[i], -turn)
        out[i] = s = (int(score.argmax()) + turn) % shards
        left[s] -= v[i]
        turn = (turn + 1) % shards
    return out


def evened(at: np.ndarray, sizes: np.ndarray, shards: int) -> np.ndarray:
    """``at`` with the bytes of shards nearer to each other: the unit that moves from the fullest shard to the emptiest, or the two
    that change places between them, halve their gap best; until it is below EVEN of a shard or no exchange narrows it."""
    at, sizes = at.copy(), sizes.astype(np.int64)
    load = np.bincount(at, sizes, shards)
    for _ in range(EXCHANGES):
        full, empty = int(load.argmax()), int(load.argmin())
        gap = load[full] - load[empty]
        if gap <= EVEN * load.mean():
            break
        mine, theirs = np.flatnonzero(at == full), np.flatnonzero(at == empty)
        order = theirs[np.argsort(sizes[theirs], kind="stable")]
        # What each of mine may change places with: nothing (0 bytes), or the two of theirs nearest to its size less half the gap.
        held = np.concatenate([[0], sizes[order]])
        k = np.searchsorted(held, sizes[mine] - gap / 2)
        tries = [(np.clip(k + d, 0, len(held) - 1)) for d in (-1, 0)]
        moved = np.stack([sizes[mine] - held[t] for t in tries])
        off = np.abs(moved - gap / 2)
        way, one = np.unravel_index(int(off.argmin()), off.shape)
        if not 0 < moved[way, one] < gap:
            break
        other = int(tries[way][one])
        at[mine[one]] = empty
        if other:
            at[order[other - 1]] = full
        load[full] -= moved[way, one]
        load[empty] += moved[way, one]
    return at


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, text_md5, shard, slot for every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n = docs.count()
    d = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            word_count(text).alias("tokens"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.md5(text.cast("binary")).alias("text_md5"),
        )
    )
    total = d.agg(F.sum("size").alias("b"), F.sum("tokens").alias("t")).first()
    share = F.greatest(F.sum("size") / max(1, total["b"] or 0), F.sum("tokens") / max(1, total["t"] or 0), F.count("*") / max(1, n))
    # At most 3 * shards / WHOLE groups can be that heavy: the broadcast side is bounded.
    hot = d.groupBy("text_md5").agg(F.ceil(share * UNIT_SHARE).cast("int").alias("chunks"), share.alias("share"), F.count("*").alias("c"))
    hot = hot.filter((F.col("share") > WHOLE / shards) & (F.col("chunks") > 1) & (F.col("c") > 1)).select("text_md5", "chunks")
    d = d.join(F.broadcast(hot), "text_md5", "left").withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.col("chunks")), F.lit(0)).cast("int")).drop("chunks")
    units = d.groupBy("text_md5", "chunk").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n"), (share > 1 / UNIT_SHARE).alias("heavy"))
    units = cut(units, n)
    # At most 3 * UNIT_SHARE units are heavy.
    big = sorted(units.filter("heavy").drop("heavy").collect())
    whole = np.array([[total["b"] or 0, total["t"] or 0, n or 0]], np.float64)
    taken = np.array([u[2:] for u in big], np.float64).reshape(-1, 3)
    at = evened(place(taken, shards), taken[:, 0], shards)
    load = np.stack([np.bincount(at, taken[:, k], shards) for k in range(3)], axis=1)
    light = whole - load.sum(axis=0)
    room = (whole / shards - load) / np.where(light > 0, light, 1)
    chosen = d.sparkSession.createDataFrame([(u[0], u[1], int(s)) for u, s in zip(big, at, strict=True)], "text_md5 string, chunk int, shard int")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [f for f in frames if len(f)]
        if got:
            f = pd.concat(got).sort_values(["text_md5", "chunk"], ignore_index=True)
            first = int(f["text_md5"][0][:8], 16) % shards
            yield f[["text_md5", "chunk"]].assign(shard=place(f[["size", "tokens", "n"]].to_numpy(np.float64), shards, first, room))

    placed = units.filter("not heavy").drop("heavy").mapInPandas(run, "text_md5 string, chunk int, shard int").unionByName(chosen)
    rows = cut(d.join(placed, ["text_md5", "chunk"]).drop("chunk", "tokens"), n)
    return sized(running_total(rows, ["shard"], [F.col("doc_id"), F.col("text_md5")], F.lit(1), "slot", buckets_for(n // shards)), n)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
