"""Ranked lexical search: variable-block-max WAND over shards.

A task indexes the documents that it reads, in shards of at most SHARD documents: for each term that an item asks for, the
documents that hold it and how often. Shards are written to the checkpoint folder; their document frequencies add up to
the corpus' own, so that a shard's contributions of term to document are exact before anything is searched.

Each posting list is cut into blocks whose greatest contribution bounds those of all its documents. Dynamic programming
puts the boundaries where the bounds' total error, and a price for each block, is least: all lists of a shard advance
together, GRAIN postings a step. A search adds up, over the blocks of an item's terms, the bounds that cover each document.
Pivots are the documents whose sum reaches the k-th best score so far; those with the highest bounds are scored first,
which raises that score, then the pivots that are left. Only blocks that hold a pivot are opened. A task carries its best
ones from shard to shard, so later shards start with a high threshold; the best of all tasks are merged by item.

Nothing is approximate: a document that is not scored has a bound below the k-th best score.

Defined cases: null texts and texts without a term are not counted and never found; items without a term find nothing;
rows with equal item_id and text are one item; repeated documents are ranked one by one; equal scores go by ascending doc_id,
null last; an empty table gives an empty result; other columns are ignored; texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, ddl, sized, table, text_batches

BEST = 10
#: Documents and tokens of a shard at most, about, and bytes of items that are searched in one pass over the documents.
SHARD, TOKENS, ITEM_BYTES = 4096, 4_000_000, 32_000_000
#: Postings between two possible boundaries, the most of those in a block, and a block's price as a share of its list's
#: greatest contribution.
GRAIN, LONGEST, PRICE = 4, 32, 4
#: Documents that are scored first, and parts of an item's best ones that are merged first.
FIRST, SALTS = 64, 64
#: ASCII bytes that end terms become spaces, capitals small; other bytes belong to terms.
FOLD = bytes(c if c >= 0x80 else c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
INDEX = "doc_ids array<long>, sizes binary, terms array<int>, counts array<int>, docs binary, times binary, held long, total long"
ARROW = pa.schema({"doc_ids": pa.list_(pa.int64()), "sizes": pa.binary(), "terms": pa.list_(pa.int32()), "counts": pa.list_(pa.int32()), "docs": pa.binary(), "times": pa.binary(), "held": pa.int64(), "total": pa.int64()})


def terms_of(text: str | bytes | None) -> list[bytes]:
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"").translate(FOLD).split()


# --- index -----------------------------------------------------------------------------------------------


def shards_of(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """The index of each shard: its documents, their sizes in terms, and for each numbered term that occurs the
    documents (places in the shard, ascending) and how often."""
    shared = docs.sparkSession.sparkContext.broadcast(number)
    text_batches(docs.sparkSession)

    def made(ids: list, sizes: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
        doc = np.repeat(np.arange(len(ids)), [len(x) for x in found])
        key, times = np.unique(np.concatenate(found).astype(np.int64) * SHARD + doc, return_counts=True)
        terms, counts = np.unique(key // SHARD, return_counts=True)
        row = {"doc_ids": ids, "sizes": np.array(sizes, np.int64).tobytes(), "terms": terms, "counts": counts, "docs": (key % SHARD).astype(np.int32).tobytes(), "times": times.astype(np.int64).tobytes(), "held": sum(n > 0 for n in sizes), "total": sum(sizes)}
        return pa.RecordBatch.from_pylist([row], schema=ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        ids, sizes, found, held = [], [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                t = terms_of(text)
                x = np.fromiter(map(get, t, repeat(-1)), np.int32, len(t))
                ids.append(doc_id)
                sizes.append(len(t))
                found.append(x[x >= 0])
                held += len(t)
                if len(ids) == SHARD or held > TOKENS:
                    yield made(ids, sizes, found)
                    ids, sizes, found, held = [], [], [], 0
        if ids:
            yield made(ids, sizes, found)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl(INDEX))


def boundaries(scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where blocks start in lists that stand one after another in ``scores``, ``lengths`` of them each: what the
    blocks' greatest scores are above all scores, plus the blocks' prices, is least."""
    if not len(scores):
        return np.zeros(0, np.int64)
    starts = np.cumsum(lengths) - lengths
    steps = -(-lengths // GRAIN)
    order = np.argsort(-steps, kind="stable")
    starts, lengths, steps = starts[order], lengths[order], steps[order]
    # Grains: their greatest score, sum and number of postings, list by list.
    first = np.cumsum(steps) - steps
    owner = np.repeat(np.arange(len(steps)), steps)
    begin = starts[owner] + (np.arange(steps.sum()) - first[owner]) * GRAIN
    number = np.minimum(begin + GRAIN, (starts + lengths)[owner]) - begin
    place = np.argsort(begin)
    top, total = np.empty(len(begin), float), np.empty(len(begin), float)
    top[place], total[place] = np.maximum.reduceat(scores, begin[place]), np.add.reduceat(scores, begin[place])
    price = PRICE * np.maximum.reduceat(top, first)
    # For each list and k = 1 .. LONGEST: greatest score, sum and number of its last k grains, and the least cost before them.
    inf = np.inf
    last_top, last_sum, last_n = np.zeros((len(steps), LONGEST)), np.zeros((len(steps), LONGEST)), np.zeros((len(steps), LONGEST))
    cost = np.full((len(steps), LONGEST), inf)
    cost[:, 0] = 0
    taken = np.zeros(len(begin), np.int8)
    running = np.searchsorted(-steps, -np.arange(1, int(steps[0]) + 1), side="right")
    for j, n in enumerate(running.tolist()):
        at = first[:n] + j
        for a, new in ((last_top, top[at]), (last_sum, total[at]), (last_n, number[at])):
            a[:n, 1:] = a[:n, :-1].copy() if a is last_top else a[:n, :-1] + new[:, None]
            a[:n, 0] = new
        np.maximum(last_top[:n], top[at][:, None], out=last_top[:n])
        ways = cost[:n] + last_top[:n] * last_n[:n] - last_sum[:n]
        best = ways.argmin(axis=1)
        taken[at] = best + 1
        cost[:n, 1:] = cost[:n, :-1].copy()
        cost[:n, 0] = ways[np.arange(n), best] + price[:n]
    # Back from the ends of all lists at once.
    found, at, some = [], steps.copy(), np.arange(len(steps))
    while len(some):
        at[some] -= taken[first[some] + at[some] - 1]
        found.append(starts[some] + at[some] * GRAIN)
        some = some[at[some] > 0]
    return np.sort(np.concatenate(found))


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All whole numbers of several ranges, one after another."""
    n = ends - starts
    return np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())


# --- search ----------------------------------------------------------------------------------------------


class Shard:
    """A shard's contributions by list, and the blocks over them."""

    def __init__(self, row: dict, weights: np.ndarray, n: int, total: int) -> None:
        self.ids = np.array([np.iinfo(np.int64).max if i is None else i for i in row["doc_ids"]], np.int64)
        self.null = np.array([i is None for i in row["doc_ids"]])
        self.terms, lengths = np.array(row["terms"], np.int64), np.array(row["counts"], np.int64)
        self.docs = np.frombuffer(row["docs"], np.int32)
        times = np.frombuffer(row["times"], np.int64)
        m = np.array([100 - 90 + 90 * size * n // max(1, total) for size in np.frombuffer(row["sizes"], np.int64).tolist()], np.int64)
        scores = np.repeat(weights[self.terms], lengths) * (1_000_000_000 * times // (1000 * times + 8 * m[self.docs]))
        self.scores = scores.astype(float)  # whole numbers far below 2**53, and so are their sums
        self.starts = boundaries(self.scores, lengths)
        self.ends = np.append(self.starts, len(scores))[1:]
        self.top = np.maximum.reduceat(self.scores, self.starts) if len(scores) else np.zeros(0)
        self.low, self.high = self.docs[self.starts], self.docs[self.ends - 1]
        # Blocks of each list.
        upto = np.searchsorted(self.starts, np.append(0, np.cumsum(lengths)))
        self.first, self.behind = upto[:-1], upto[1:]
        self.opened = self.blocks = 0

    def search(self, terms: np.ndarray, best: list[tuple[int, bool, int]], k: int) -> list[tuple[int, bool, int]]:
        """The k best of ``best`` and this shard's documents for an item's terms (ascending): (-score, null, doc_id)."""
        at = np.searchsorted(self.terms, terms)
        at = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms)] if len(self.terms) else at[:0]
        blocks = ranges(self.first[at], self.behind[at])
        if not len(blocks):
            return best
        n = len(self.ids)
        low, high, top = self.low[blocks], self.high[blocks], self.top[blocks]
        bound = np.cumsum(np.bincount(low, top, n + 1) - np.bincount(high + 1, top, n + 1))[:n]
        self.blocks += len(blocks)
        pivots = np.flatnonzero(bound >= self.threshold(best, k))
        if len(pivots) > FIRST:
            early = pivots[np.argpartition(-bound[pivots], FIRST)[:FIRST]]
            best = self.scored(early, blocks, low, high, best, k)
            bound[early] = -1
            pivots = np.flatnonzero(bound >= self.threshold(best, k))
        return self.scored(pivots, blocks, low, high, best, k)

    @staticmethod
    def threshold(best: list[tuple[int, bool, int]], k: int) -> int:
        return -best[-1][0] if len(best) == k else 1

    def scored(self, pivots: np.ndarray, blocks: np.ndarray, low: np.ndarray, high: np.ndarray, best: list, k: int) -> list:
        """``best`` with the pivots' exact scores merged in; blocks without a pivot stay closed."""
        if not len(pivots):
            return best
        before = np.zeros(len(self.ids) + 1, np.int64)
        before[pivots + 1] = 1
        before = np.cumsum(before)
        opened = blocks[before[high + 1] > before[low]]
        self.opened += len(opened)
        at = ranges(self.starts[opened], self.ends[opened])
        score = np.bincount(self.docs[at], self.scores[at], len(self.ids))[pivots]
        good = score >= self.threshold(best, k)
        rows = [(-int(s), bool(z), int(i)) for s, z, i in zip(score[good], self.null[pivots[good]], self.ids[pivots[good]], strict=True)]
        return sorted(best + rows)[:k]


FOUND = "item int, doc_id long, score long"


def found_in(shards: DataFrame, items: list[np.ndarray], weights: np.ndarray, n: int, total: int, k: int) -> DataFrame:
    """item, doc_id, score: the k best documents of each task for each item."""
    shared = shards.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, w = shared.value
        best: list[list] = [[] for _ in wanted]
        for b in batches:
            for r in range(b.num_rows):
                shard = Shard(b.slice(r, 1).to_pylist()[0], w, n, total)
                best = [shard.search(t, have, k) for t, have in zip(wanted, best, strict=True)]
        rows = [(i, None if null else doc, -score) for i, have in enumerate(best) for score, null, doc in have]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["item", "doc_id", "score"])

    return shards.mapInArrow(run, ddl(FOUND))


def ranked(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` best documents of every item. Items are searched together as far as
    their texts have ITEM_BYTES; more of them take more passes."""
    known = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = size // ITEM_BYTES + 1
    share = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    out = [one_pass(docs, known.filter(share == p), k) for p in range(passes)]
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def one_pass(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    rows = sorted(items.collect(), key=lambda r: (r[0] is None, r[0], r[1]))
    texts = [sorted(set(terms_of(r[1]))) for r in rows]
    number = {t: i for i, t in enumerate(sorted({t for x in texts for t in x}))}
    shards = cut(shards_of(docs, number))
    sums = shards.agg(F.sum("held"), F.sum("total")).first()
    n, total = sums[0] or 0, sums[1] or 0
    df = np.zeros(len(number), np.int64)
    each = shards.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts")).toArrow()
    df[each.column(0).to_numpy()] = each.column(1).to_numpy()
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    wanted = [np.array([number[t] for t in x], np.int64) for x in texts]
    found = found_in(shards, wanted, weights, n, total, k)
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for by in ([F.col("item"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))], [F.col("item")]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best))).filter(F.col("rank") <= k)
    ids = docs.sparkSession.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "item int, item_id long")
    return sized(found.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"), len(rows) * k)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
