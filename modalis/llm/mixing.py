"""Mixing sources to target weights, with DataFrame operations alone.

The words of each source stand in one stream, cut into fixed-length blocks. A mix is a row of output shards of
equally many slots. A shard draws its source counts from a multinomial over the sources' shares: each of its slots
draws a source by a uniform number. The numbers of the j-th slots of all shards are stratified: shard ``k`` takes the
stratum that a permutation of its own for each j deals to it. So slots of a shard are independent, and its counts
exactly multinomial, while over all shards a source's count differs from its expectation by less than one for each
j, at random, and not by the root of all slots. The slots of a source are numbered over all shards; slot i takes
block ``perm(i mod blocks)`` under a pseudorandom permutation of the source's blocks that changes with each pass, and
joins the block by that index. A permutation uses each block once a pass and there are at most ``most`` passes, so
nothing is taken more often than that; slots drawn beyond them go to the source with most room left.

Sources by code point, null last, weigh 1, 2, 3, repeating, and share all words; a target stops at ``most``
times its source and the excess is shared again by weight (:func:`targets`).

Streams, slots and blocks are keyed by (source, index) and running totals are taken over hashed buckets,
so a source of any size spreads over tasks. There is one row a source, and one for each source and slot of a shard.

Defined cases: null texts have size 0 and are never taken; null sources are one source; repeated rows each
have their own place in the stream; a table without words has targets and takings of 0; an empty table
gives an empty result; other columns are ignored. Results depend on rows, not on their order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import bind
from .common import SPACE, buckets_for, cut, running_total, sized, table, word_count

#: Words of a block, slots of an output shard at most, and times that a word may be taken.
BLOCK, SLOTS, MOST = 64, 4096, 3
#: Slots that a task makes, about.
SLOTS_A_TASK = 100_000
#: Sources up to which their table (one row each) is broadcast.
FEW_SOURCES = 100_000
SEED = 20_240_229


def ids_are_keys(docs: DataFrame) -> bool:
    """Whether doc_id tells all rows apart."""
    n = docs.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d")).first()
    return n["n"] == n["d"]


def with_key(docs: DataFrame, plain: bool) -> DataFrame:
    """``key``: the row's own among all rows of ``docs`` (doc_id, source, text_md5 and others): its doc_id where
    that will do, else a digest of its content, with equal rows counted off, in buckets."""
    if plain:
        return docs.withColumn("key", F.col("doc_id").cast("string"))
    content = F.md5(F.concat_ws("\x01", *(F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in ("doc_id", "source", "text_md5"))).cast("binary"))
    d = cut(docs.withColumn("__c", content).withColumn("__m", F.monotonically_increasing_id()))
    numbered = running_total(d, ["__c"], [F.col("__m")], F.lit(1), "__k", buckets_for(d.count()))
    return numbered.withColumn("key", F.concat("__c", F.lit("#"), F.col("__k").cast("string"))).drop("__c", "__m", "__k")


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """sid, source, source_size, weight, target for each source of ``sizes`` (source, size): one row each."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("sid", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("long")).withColumn("weight", F.col("sid") % 3 + 1)
    big = lambda c: F.col(c).cast("decimal(19,0)")
    every = Window.partitionBy()
    before = Window.orderBy(F.col("source_size") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("__left", F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    s = s.withColumn("__w", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # The first source in this order whose share stays within its limit sets the level for it and all after it.
    fits = big("__left") * big("weight") <= F.lit(most) * big("source_size") * big("__w")
    level = F.min(F.when(fits, F.struct(F.col("source_size") / F.col("weight"), F.col("sid"), (F.col("__left") / F.col("__w")).alias("level")))).over(every)["level"]
    s = s.withColumn("target", F.least((most * F.col("source_size")).cast("double"), level * F.col("weight")))
    return s.select("sid", "source", "source_size", "weight", F.coalesce("target", F.lit(0.0)).alias("target"))


def sides(n: Column) -> tuple[Column, Column]:
    """A rectangle of at least n cells, of which fewer than a are too many."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    return a, F.ceil(n / a).cast("long")


def permuted(x: Column, n: Column, a: Column, b: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0 .. n-1: a Feistel network on the a x b rectangle of :func:`sides`, walked
    on from the cells beyond n. Each round's halves are kept in a struct, so that they are computed once."""

    def turn(s: Column, k: Column) -> Column:
        left = F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], k, *key), a), a)
        return F.struct(left.alias("l"), F.pmod(s["r"] + F.pmod(F.xxhash64(left, k + 1, *key), b), b).alias("r"))

    def shuffled(v: Column) -> Column:
        start = F.struct(F.floor(v / b).cast("long").alias("l"), F.pmod(v, b).alias("r"))
        return F.aggregate(F.array(F.lit(0), F.lit(2), F.lit(4)), start, turn, lambda s: s["l"] * b + s["r"])

    def walked(y: Column, steps: Column) -> Column:
        return F.aggregate(steps, y, lambda z, _: F.when(z < n, z).otherwise(shuffled(z)))

    # Few walks take more than 16 steps, and none more than there are cells beyond n, fewer than a.
    most = walked(shuffled(x), F.sequence(F.lit(1).cast("long"), F.lit(16).cast("long")))
    return bind(most, lambda y: walked(y, F.when(y < n, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("long"), a))))


def shard_slots(n: int, most: int = SLOTS) -> int:
    """Slots of a shard in a mix of ``n``: many more shards than slots of one keep sources near their targets."""
    return max(1, min(most, math.isqrt(n) // 16))


def counts_of(sources: DataFrame, slots: int, shards: int, seed: int = SEED) -> DataFrame:
    """sid, j, first, count: the strata of the j-th slots that draw each source, ``count`` from ``first`` on. Stratum r
    draws by (r + U(r, j)) / shards, so a source whose share begins at c has the strata beyond c * shards, and the
    one that holds c if its number is large enough. ``sources``: sid, share."""
    order = Window.orderBy("sid")
    s = sources.withColumn("lo", F.coalesce(F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("hi", F.coalesce(F.lead("lo").over(order), F.lit(1.0))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))

    def begins(share: str) -> Column:
        at = F.least(F.col(share), F.lit(1.0)) * shards
        r = F.floor(at).cast("long")
        draw = F.pmod(F.xxhash64(r, F.col("j"), F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
        return r + F.when(draw < at - r, 1).otherwise(0)

    first = begins("lo")
    return s.withColumns({"first": first, "count": begins("hi") - first}).drop("lo", "hi", "share")


def slots_of(sources: DataFrame, slots: int = SLOTS, block: int = BLOCK, most: int = MOST, seed: int = SEED) -> DataFrame:
    """shard, sid, slot (number within the source), pass, block of every slot of the mix."""
    s = sources.filter("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    s = s.withColumn("__e", F.col("target") * F.col("blocks") / F.col("source_size"))
    n = int(math.ceil(s.agg(F.sum("__e")).first()[0] or 0))
    each = shard_slots(n, slots)
    shards = max(1, -(-n // each))
    share = F.col("__e") / F.sum("__e").over(Window.partitionBy())
    s = counts_of(s.select("sid", "blocks", share.alias("share")), each, shards, seed)
    by_j = Window.partitionBy("sid").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    s = cut(s.withColumn("start", F.coalesce(F.sum("count").over(by_j), F.lit(0))), each * sources.count())
    # Slots beyond a source's passes are given, in order, to the source with most room.
    drawn = s.groupBy("sid", "blocks").agg(F.sum("count").alias("drawn")).withColumn("room", most * F.col("blocks") - F.col("drawn"))
    over = drawn.filter("room < 0").select("sid", F.coalesce(-F.sum("room").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    roomy = drawn.orderBy(F.desc("room"), "sid").select("sid", "blocks", "drawn").first()
    s = s.join(over, "sid", "left")
    # A few rows become very many: they are dealt out first, by a number of tasks that follows the slots.
    part = F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(SLOTS_A_TASK).cast("long"))
    s = s.filter("count > 0").withColumn("from", F.explode(part)).repartition(max(1, n // SLOTS_A_TASK), "sid", "j", "from")
    s = s.withColumn("at", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + SLOTS_A_TASK, F.col("count")) - 1)))
    s = s.select("sid", "blocks", "j", (F.col("first") + F.col("at")).alias("r"), (F.col("start") + F.col("at")).alias("slot"), "before")
    if roomy is not None:
        lost = F.col("slot") >= most * F.col("blocks")
        now = {"sid": F.lit(roomy["sid"]), "blocks": F.lit(roomy["blocks"]), "slot": F.lit(roomy["drawn"]) + F.col("before") + F.col("slot") - most * F.col("blocks")}
        s = s.select("j", "r", *(F.when(lost, v).otherwise(F.col(c)).alias(c) for c, v in now.items()))
    s = s.withColumn("pass", F.floor(F.col("slot") / F.col("blocks")).cast("long"))
    a, b = sides(F.col("blocks"))
    s = s.withColumns({"__rows": a, "__cols": b})
    block_ = permuted(F.pmod(F.col("slot"), F.col("blocks")), F.col("blocks"), F.col("__rows"), F.col("__cols"), F.col("sid"), F.col("pass"), F.lit(seed))
    of_shards = F.lit(shards).cast("long")
    shard = permuted(F.col("r"), of_shards, *sides(of_shards), F.col("j"), F.lit(seed + 1))
    return s.select(shard.alias("shard"), "sid", "slot", "pass", block_.alias("block"))


def fragments(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """key, sid, block, from (word within the document), words: each row's parts of its source's blocks.
    ``rows``: key, sid, size, offset."""
    end = F.col("offset") + F.col("size")
    f = rows.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("offset") / block).cast("long"), F.floor((end - 1) / block).cast("long"))))
    start = F.greatest(F.col("offset"), F.col("block") * block)
    return f.select("key", "sid", "block", (start - F.col("offset")).alias("from"), (F.least(end, (F.col("block") + 1) * block) - start).alias("words"))


def with_identity(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "source": F.col("source").cast("string"), "text_md5": F.md5(F.col("text").cast("binary"))})


def streams(docs: DataFrame, most: int = MOST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The table of sources; every row with its source's; and the same with its offset in that source's stream of words."""
    rows = docs.count()
    d = with_identity(docs)
    d = cut(with_key(d.select("doc_id", "source", "text_md5", word_count(F.col("text")).alias("size")), ids_are_keys(docs)))
    sources = cut(targets(d, most), rows)
    few = sources.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    with_source = d.join(F.broadcast(sources) if few else sources, d["source"].eqNullSafe(sources["source"])).select(d["doc_id"], d["source"], d["key"], d["size"], "sid", "source_size", "target")
    return sources, with_source, running_total(with_source, ["sid"], [F.col("key")], F.col("size"), "offset", buckets_for(rows))


def mix(docs: DataFrame, block: int = BLOCK, slots: int = SLOTS, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Two tables: doc_id, source, key, size, source_size, target of every row; and its fragments with
    ``times``, how often the mix takes each (those that it takes)."""
    sources, rows, placed = streams(docs, most)
    taken = slots_of(sources, slots, block, most).groupBy("sid", "block").agg(F.count("*").alias("times"))
    # Sizes of exploded tables are not known to the planner: neither side is to be broadcast.
    return rows, fragments(placed, block).hint("merge").join(taken, ["sid", "block"])


def mixed_slots(docs: DataFrame, block: int = BLOCK, slots: int = SLOTS, most: int = MOST) -> DataFrame:
    """shard, sid, slot, block and, for each part of it, key, from, words: the mix as shards of blocks."""
    sources, _, placed = streams(docs, most)
    return slots_of(sources, slots, block, most).join(fragments(placed, block).hint("merge"), ["sid", "block"]).select("shard", "sid", "slot", "block", "key", "from", "words")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, taken = mix(table(spark, sf_dir, "documents"))
    by_row = taken.groupBy("key").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    out = rows.join(by_row, "key", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")
    return sized(out, rows.count())


def mixed_documents(docs: DataFrame, block: int = BLOCK, slots: int = SLOTS, most: int = MOST) -> DataFrame:
    """The mix as rows of documents: one for each pass over a document, with the words that the pass takes.
    A pass that takes all of a document keeps its text as it is; else words are joined by a space."""
    _, taken = mix(docs, block, slots, most)
    by_row = taken.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("from", "words", "times"))).alias("__f"))
    keyed = with_key(with_identity(docs.select("doc_id", "text", "lang", "source")), ids_are_keys(docs)).join(by_row, "key").withColumn("__pass", F.explode(F.sequence(F.lit(1).cast("long"), F.array_max(F.transform("__f", lambda f: f["times"])))))
    mine = F.filter("__f", lambda f: f["times"] >= F.col("__pass"))
    words = F.filter(F.split("text", SPACE, -1), lambda w: w != "")
    some = F.array_join(F.flatten(F.transform("__mine", lambda f: F.slice("__words", (f["from"] + 1).cast("int"), f["words"].cast("int")))), " ")
    whole = F.aggregate("__mine", F.lit(0).cast("long"), lambda n, f: n + f["words"]) == word_count(F.col("text"))
    out = keyed.withColumn("__mine", mine).withColumn("__words", words)
    text = F.when(whole, F.col("text")).otherwise(some)
    return out.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))
