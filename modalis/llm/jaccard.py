"""N-gram Jaccard join with set-relation skipping: components of documents with similar shingle sets.

Sets are 64-bit hashes of the distinct k-word shingles. Two documents link when
``den * intersection >= num * union``; the result is the component of every document, and no link between
different texts is lost. Four things keep it from growing with the square of a group:

1. Equal sets are one set.
2. Hubs. Each set is compared with the least set that shares one of its min-hashes, and is given, of those at
   least half like it, the most popular one as its hub. What differs from the hub (the delta) tells the exact
   overlap of any two sets of a hub: |x ^ y| = |dx| + |dy| - 2 |dx & dy|. Answers are derived from the hub's:
   with slack w = c |x| - |dx|, c = (den - num) / (den + num), every pair with w_x + w_y >= 0 links, and links
   to the set with the most slack as well, so one comparison a set stands for all such pairs. Other pairs need
   shared delta entries, found by a prefix join on deltas.
3. Index lists. Sets without a common hub meet in a prefix index whose order puts frequent shingles last. A
   list holds one entry a hub, with the block's range of sizes and positions; a pair of entries is skipped
   unless sizes and positions leave enough overlap, and only the rest are expanded to sets, by the same
   tests, and verified exactly.
4. Long lists are dealt into blocks, and pairs of blocks into tasks.

Everything is joins and aggregates by key; only bounded things are collected or broadcast: the order's frequent
shingles (at most ``FREQUENT``; which they are changes the work, not the result) and, up to ``FEW`` rows, ids.
Texts are read once: each row keeps the least hashes of its set, twice its prefix, and only rows of which too
many of those are frequent are read again.

Defined cases: null texts and texts without words have empty sets, link with nothing and are their own
component; rows with equal doc_id count as documents of their own that carry one id; null doc_ids sort first
and give null components of their own text group; an empty table gives an empty result; other columns are
ignored; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .common import cut, ddl, few, map_rows, sized, table, text_batches
from .components import components

#: Shingle words and least similarity of the query's contract; HASHES min-hashes; a hub is at least half alike.
WORDS, NUM, DEN, HASHES = 4, 85, 100, 4
#: Rows from which a shingle is frequent, and frequent shingles at most. Tasks count what they see twice.
OFTEN, FREQUENT, TWICE = 8, 500_000, 2_000_000
#: Ids up to which a semi-join broadcasts them, entries of a list from which it is dealt into blocks of BLOCK.
FEW, BLOCK = 1_000_000, 512
CACHE = 200_000
#: Index entries of a row, about: for the number of files that they are cut into.
ENTRIES = 32

MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
TURN = np.uint64(29)


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


HASHED = Hashes()


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles: A-Z lower-cased, words apart by ASCII white space."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    a = np.fromiter(map(HASHED.__getitem__, w), np.uint64, len(w))
    k = min(words, len(a))
    n = len(a) - k + 1
    h = np.full(n, k, np.uint64)  # a shorter text's only shingle is none of a longer one's
    for i in range(k):
        h = (h ^ a[i : i + n]) * MIX[i % len(MIX)]
        h ^= h >> TURN
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def least_overlap(n: Column | int, m: Column | int, num: int, den: int) -> Column:
    """The intersection that sets of ``n`` and ``m`` need: ceil(num (n + m) / (num + den))."""
    return F.floor(((n + m) * num + (num + den - 1)) / (num + den))


def signed(h: np.ndarray) -> list[int]:
    return h.view(np.int64).tolist()


# --- 1: sets -------------------------------------------------------------------------------------------


def prefix_size(n: int | np.ndarray, num: int, den: int) -> int | np.ndarray:
    return n - -(-n * num // den) + 1


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    values = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def repeated(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that occur twice or more in ``parts``, and how often."""
    h, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.uint64), np.empty(0, np.uint64))
    return h[n > 1], n[n > 1].astype(np.uint64)


SETS = "rid long, n long, digest binary, mins array<long>, low array<long>, counts array<long>"


def set_rows(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """rid, n, digest, mins, low (the least hashes) of every row of ``docs`` (rid, text); and rows with n null,
    the hashes in ``low`` that a task keeps more than once and their ``counts``."""
    arrow = to_arrow_schema(ddl(SETS))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        rid, n, digest, mins, low, counts = zip(*rows, strict=True)
        columns = [pa.array(rid, pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), lists(mins), lists(low), lists(counts)]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, seen, held = np.empty(0, np.uint64), [], 0
        for part in batches:
            out = []
            for rid, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                h = shingles(text, words)
                if not len(h):
                    out.append((rid, 0, None, none, none, none))
                    continue
                low = h[: 2 * prefix_size(len(h), num, den) + 16].copy()
                mins = np.array([(h * (c | np.uint64(1))).min() for c in MIX[:HASHES]], np.uint64)
                out.append((rid, len(h), xxhash.xxh3_128_digest(h.tobytes()), mins, low, none))
                seen.append(low)
                held += len(low)
                if held >= TWICE:
                    out.append((None, None, None, none, *repeated(seen)))
                    seen, held = [], 0
            yield batch(out)
        if seen:
            yield batch([(None, None, None, none, *repeated(seen))])

    text_batches(docs.sparkSession)
    return docs.select("rid", "text").mapInArrow(run, ddl(SETS))


# --- 2: hubs ---------------------------------------------------------------------------------------------


def with_texts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """``pairs`` (a, b and others) with the texts of both. Documents outside of any pair are left out
    before anything is shuffled, as long as the ids are few enough to be broadcast."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
    mine = docs.join(few(ids, FEW), "rid", "left_semi")
    one = pairs.join(mine.select(F.col("rid").alias("a"), F.col("text").alias("text_a")), "a")
    return one.join(mine.select(F.col("rid").alias("b"), F.col("text").alias("text_b")), "b").sortWithinPartitions("b")


def compared(pairs: DataFrame, docs: DataFrame, words: int, num: int, den: int, hubs: bool) -> DataFrame:
    """a, b, link of each pair (a, b); with ``hubs`` also n, m (sizes), and the delta of a from b where
    they are half alike."""

    def make():
        last: list = [None, None]

        def each(a, b, text_a, text_b):
            if last[0] != b:
                last[:] = b, shingles(text_b, words)
            x, y = shingles(text_a, words), last[1]
            both = len(np.intersect1d(x, y, assume_unique=True))
            union = len(x) + len(y) - both
            link = both > 0 and den * both >= num * union
            if hubs:
                if 2 * both >= union:
                    yield a, b, link, len(x), len(y), signed(np.setxor1d(x, y, assume_unique=True))
            elif link:
                yield a, b, link, len(x), len(y), None

        return each

    return map_rows(with_texts(pairs, docs).select("a", "b", "text_a", "text_b"), make, "a long, b long, link boolean, n long, m long, delta array<long>")


def popular(compared_: DataFrame) -> DataFrame:
    """a, hub, n, delta: of the sets that a is half like, the one that most are."""
    votes = compared_.groupBy("b").agg(F.count("*").alias("votes"))
    best = compared_.join(votes, "b").groupBy("a").agg(F.max(F.struct("votes", -F.col("b"), "n", "delta")).alias("x"))
    return best.select("a", (-F.col("x.col2")).alias("hub"), "x.votes", "x.n", "x.delta")


def hub_links(members: DataFrame, rows: int, num: int, den: int) -> DataFrame:
    """a, b: links within each hub's sets that keep components whole. ``members``: a, hub, n, delta, the hub
    itself with an empty delta."""
    # Slack in units of 1 / (num + den), so that all is in whole numbers.
    m = members.withColumn("d", F.size("delta").cast("long")).withColumn("w", (den - num) * F.col("n") - (den + num) * F.col("d"))
    best = m.groupBy("hub").agg(F.max(F.struct("w", -F.col("a"))).alias("x")).select("hub", F.col("x.w").alias("ws"), (-F.col("x.col2")).alias("s"))
    m = cut(m.join(best, "hub"), rows)
    straight = m.filter((F.col("w") + F.col("ws") >= 0) & (F.col("a") != F.col("s"))).select("a", F.col("s").alias("b"))
    # The rest: pairs with w_x + w_y < 0 that share at least -(w_x + w_y) / (2 (num + den)) entries.
    tied = F.col("w") + F.col("ws") >= 0
    entries = m.select("hub", "a", "n", "d", "w", "ws", tied.alias("tied"), F.explode("delta").alias("t"))
    often = entries.groupBy("hub", "t").agg(F.count("*").alias("f"))
    entries = entries.join(often, ["hub", "t"])
    place = Window.partitionBy("hub", "a").orderBy("f", "t")
    need = F.greatest(F.lit(1), F.ceil(-(F.col("w") + F.col("ws")) / (2 * (num + den)))).cast("long")
    entries = entries.withColumn("pos", F.row_number().over(place) - 1).filter((F.col("pos") <= F.col("d") - need) & (F.col("f") > 1))
    # A list of more than BLOCK entries is dealt into blocks; each entry goes to every pair of its block.
    parts = F.ceil(F.col("f") / BLOCK).cast("int")
    entries = entries.withColumn("part", F.pmod(F.xxhash64("a"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    ends = (F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    entries = cut(entries.select("hub", "t", *ends, "part", "a", "w", "tied", (F.col("d") - F.col("pos")).alias("left")), ENTRIES * rows)
    # Tied sets are all linked with the one of most slack: a pair needs one that is not.
    x, y = (e.select("hub", "t", "lo", "hi", *(F.col(c).alias(f"{c}_{s}") for c in ("a", "w", "tied", "left", "part"))) for e, s in ((entries.filter(~F.col("tied")), "x"), (entries, "y")))
    short = F.col("w_x") + F.col("w_y")
    once = (F.col("lo") == F.col("hi")) | (F.col("part_x") != F.col("part_y"))
    fits = (short < 0) & (2 * (num + den) * F.least("left_x", "left_y") >= -short) & once & (F.col("tied_y") | (F.col("a_x") < F.col("a_y")))
    pairs = x.join(y, ["hub", "t", "lo", "hi"]).filter(fits).select(F.col("a_x").alias("a"), F.col("a_y").alias("b")).distinct()
    d = m.select("a", "w", "delta")
    joined = pairs.join(d, "a").join(d.select(F.col("a").alias("b"), F.col("w").alias("w_b"), F.col("delta").alias("delta_b")), "b")
    shared = F.size(F.array_intersect("delta", "delta_b"))
    return straight.unionByName(joined.filter(F.col("w") + F.col("w_b") + 2 * (num + den) * shared >= 0).select("a", "b"))


# --- 3 and 4: index lists --------------------------------------------------------------------------------


def frequent(sets: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles that tasks keep OFTEN times or more, the FREQUENT most frequent: the end of
    the order of the index."""
    counts = sets.filter("n is null").select(F.explode(F.arrays_zip("low", "counts")).alias("x")).groupBy(F.col("x.low").alias("t")).agg(F.sum("x.counts").alias("f")).filter(F.col("f") >= OFTEN)
    top = counts.orderBy(F.desc("f"), "t").limit(FREQUENT).select("t").toArrow()
    return np.sort(top.column(0).to_numpy().view(np.uint64))


def is_in(sorted_: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(h), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, h), len(sorted_) - 1)] == h


POSTINGS = "key long, rid long, size int, rest int"


def postings_of(sets: DataFrame, docs: DataFrame, rows: int, words: int, num: int, den: int) -> DataFrame:
    """key, rid, size, rest: the shingles by which each set meets every set that it may link with, and how
    many of the set stand from there on, in the order of hashes with frequent shingles last."""
    late = docs.sparkSession.sparkContext.broadcast(frequent(sets))
    arrow = to_arrow_schema(ddl(POSTINGS))

    def batch(key: np.ndarray, rid: np.ndarray, size: np.ndarray, rest: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(rid), pa.array(size.astype(np.int32)), pa.array(rest.astype(np.int32))], schema=arrow)

    def whole(rid: int, h: np.ndarray) -> pa.RecordBatch:
        end = is_in(late.value, h)
        n = len(h)
        p = prefix_size(n, num, den)
        return batch(np.concatenate([h[~end], h[end]])[:p], np.full(p, rid), np.full(p, n), n - np.arange(p))

    def from_low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid, n, low = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.column(2)
            starts = low.offsets.to_numpy()
            h = low.values.to_numpy(zero_copy_only=False).view(np.uint64)[starts[0] : starts[-1]]
            starts = starts - starts[0]
            held = np.diff(starts)
            early = ~is_in(late.value, h)
            upto = np.concatenate([[0], np.cumsum(early)])
            p = prefix_size(n, num, den)
            plain = upto[starts[1:]] - upto[starts[:-1]] >= p
            owner = np.repeat(np.arange(len(n)), held)
            place = upto[1:] - 1 - upto[starts[:-1]][owner]
            kept = early & plain[owner] & (place < p[owner])
            of = owner[kept]
            yield batch(h[kept], rid[of], n[of], n[of] - place[kept])
            for k in np.flatnonzero(~plain & (held == n)):
                yield whole(rid[k], h[starts[k] : starts[k + 1]])

    def unfinished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [k for k, (n, low) in enumerate(zip(b.column(1).to_pylist(), b.column(2), strict=True)) if len(low) < n and (~is_in(late.value, low.values.to_numpy().view(np.uint64))).sum() < prefix_size(n, num, den)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64()))], names=["rid"])

    def from_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield whole(rid, shingles(text, words))

    some = sets.filter("n > 0").select("rid", "n", "low")
    again = cut(some.mapInArrow(unfinished, ddl("rid long")).distinct(), rows)
    texts = docs.join(few(again, FEW), "rid", "left_semi").select("rid", "text")
    return some.mapInArrow(from_low, ddl(POSTINGS)).unionByName(texts.mapInArrow(from_text, ddl(POSTINGS)))


def enough(n1: Column, r1: Column, n2: Column, r2: Column, num: int, den: int) -> Column:
    """Whether sets of n1 and n2 whose first common shingle has r1 and r2 of them from it on (itself
    included) may link: sizes must be near and what is left must hold the overlap."""
    return (den * n1 >= num * n2) & (den * n2 >= num * n1) & (F.least(r1, r2) >= least_overlap(n1, n2, num, den))


def list_pairs(postings: DataFrame, hubs: DataFrame, rows: int, num: int, den: int) -> DataFrame:
    """a, b: pairs of sets of different hubs that share a list and pass its tests. ``hubs``: rid, hub of every
    set that stands for its equals."""
    p = postings.repartition("key").withColumn("rows", F.count("*").over(Window.partitionBy("key"))).filter("rows > 1").drop("rows")
    p = cut(p.join(hubs, "rid"), ENTRIES * rows)
    p = p.repartition("key")
    blocks = p.groupBy("key", "hub").agg(F.min("size").alias("n0"), F.max("size").alias("n1"), F.max("rest").alias("r"))
    blocks = blocks.withColumn("long", F.count("*").over(Window.partitionBy("key"))).filter("long > 1")
    # A list of more than BLOCK entries is dealt into blocks; each entry goes to every pair of its block.
    parts = F.ceil(F.col("long") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("hub"), parts).cast("int")
    blocks = blocks.withColumn("part", mine).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    blocks = blocks.select("key", "hub", "n0", "n1", "r", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    blocks = cut(blocks, ENTRIES * rows)
    x, y = (blocks.select("key", "lo", "hi", *(F.col(c).alias(f"{c}_{s}") for c in ("hub", "n0", "n1", "r", "part"))) for s in "xy")
    need = least_overlap(F.col("n0_x"), F.col("n0_y"), num, den)
    near = (den * F.col("n1_x") >= num * F.col("n0_y")) & (den * F.col("n1_y") >= num * F.col("n0_x")) & (F.least("r_x", "r_y") >= need)
    once = (F.col("lo") == F.col("hi")) | (F.col("part_x") != F.col("part_y"))
    kept = x.join(y, ["key", "lo", "hi"]).filter((F.col("hub_x") < F.col("hub_y")) & once & near).select("key", "hub_x", "hub_y")
    one = kept.join(p.select("key", F.col("hub").alias("hub_x"), F.col("rid").alias("a"), F.col("size").alias("na"), F.col("rest").alias("ra")), ["key", "hub_x"])
    two = one.join(p.select("key", F.col("hub").alias("hub_y"), F.col("rid").alias("b"), F.col("size").alias("nb"), F.col("rest").alias("rb")), ["key", "hub_y"])
    return two.filter(enough(F.col("na"), F.col("ra"), F.col("nb"), F.col("rb"), num, den)).select("a", "b").distinct()


# --- the operator ----------------------------------------------------------------------------------------


def similar_groups(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, rid, n_shingles, component_id, first (whether the row is its component's least) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = rows.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d")).first()
    unique = ids["n"] == ids["d"]
    rid = F.col("doc_id") if unique else F.xxhash64("doc_id", "text")
    d = rows.select(rid.alias("rid"), "text")
    n = ids["n"]
    sets = cut(set_rows(d, words, num, den))
    reps = sets.filter("n > 0").groupBy("digest").agg(F.min("rid").alias("rep"), F.first("n").alias("n"), F.first("mins").alias("mins"))
    reps = cut(reps, n)
    keyed = reps.select("rep", F.posexplode("mins").alias("j", "m"))
    least = keyed.groupBy("j", "m").agg(F.min("rep").alias("b"), F.max("rep").alias("top")).filter("b < top").drop("top")
    tries = cut(keyed.join(least, ["j", "m"]).filter("rep > b").select(F.col("rep").alias("a"), "b").distinct(), n)
    first = cut(compared(tries, d, words, num, den, True))
    links = first.filter("link").select("a", "b")
    chosen = cut(popular(first), n)
    # A hub that has a hub itself: its sets are tried with that one.
    up = chosen.join(chosen.select(F.col("a").alias("hub"), F.col("hub").alias("top")), "hub").select("a", F.col("top").alias("b"))
    fresh = up.join(first.select("a", "b"), ["a", "b"], "left_anti")
    second = cut(compared(fresh, d, words, num, den, True))
    links = links.unionByName(second.filter("link").select("a", "b"))
    chosen = cut(popular(first.unionByName(second)), n)
    own = chosen.select(F.col("hub").alias("a")).distinct().join(chosen, "a", "left_anti").select("a", F.col("a").alias("hub"))
    own = own.join(reps.select(F.col("rep").alias("a"), "n"), "a").withColumn("delta", F.array().cast("array<long>"))
    members = cut(chosen.select("a", "hub", "n", "delta").unionByName(own.select("a", "hub", "n", "delta")), n)
    links = links.unionByName(hub_links(members, n, num, den))
    hubs = reps.select(F.col("rep").alias("rid")).join(members.select(F.col("a").alias("rid"), "hub"), "rid", "left").select("rid", F.coalesce("hub", "rid").alias("hub"))
    pairs = cut(list_pairs(postings_of(sets, d, n, words, num, den), hubs, n, num, den), n)
    links = links.unionByName(compared(pairs, d, words, num, den, False).select("a", "b"))
    labels = components(links, n)
    named = reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("label"))
    out = sets.filter("n is not null").select("rid", "n", "digest").join(named, "digest", "left").select("rid", F.col("n").alias("n_shingles"), F.coalesce("label", "rid").alias("label"))
    if unique:
        return sized(out.select(F.col("rid").alias("doc_id"), "rid", "n_shingles", F.col("label").alias("component_id"), (F.col("rid") == F.col("label")).alias("first")), n)
    out = out.distinct().join(rows.select("doc_id", F.xxhash64("doc_id", "text").alias("rid")), "rid")
    lead = out.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.min(F.struct("doc_id", "rid")).alias("m"))
    out = cut(out, n).join(lead, "label")
    return out.select("doc_id", "rid", "n_shingles", "component_id", (F.col("rid") == F.col("m.rid")).alias("first"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` (columns of documents) with one row of each component: its least doc_id, of rows with that id
    and equal texts one."""
    found = similar_groups(docs, words, num, den)
    unique = docs.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d")).first()
    gone = cut(found.filter(~F.col("first")).select("rid").distinct(), unique["n"])
    rid = F.col("doc_id").cast("long") if unique["n"] == unique["d"] else F.xxhash64(F.col("doc_id").cast("long"), "text")
    rows = docs.withColumn("__rid", rid)
    out = rows.join(few(gone, FEW), F.col("__rid") == F.col("rid"), "left_anti")
    if unique["n"] != unique["d"]:
        out = out.dropDuplicates(["__rid"])
    return out.drop("__rid")
