"""Operators on tables: brute force, hot groups, nulls, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from modalis.llm import edits, jaccard, langid, licenses, mixing, packing, privacy, sharding, templates, transport
from modalis.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, parts=3):
    """Rows of (doc_id, text, lang, source), with columns whose names operators use inside."""
    full = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]
    df = spark.createDataFrame(full, SCHEMA).repartition(parts)
    return df.withColumns({c: F.lit(1) for c in ("key", "hub", "size", "rest", "shard", "slot", "base", "terms", "range", "tail", "rid", "n", "piece", "offset")})


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Plain texts, copies, near copies of one text by the hundred, a shared passage, nulls and odd texts."""
    rng = random.Random(5)
    rows, base, passage = [], words(rng, 60, 10**6), words(rng, 40, 10**6)
    for k in range(60):
        rows.append((k, words(rng, rng.randrange(1, 120)), "en", f"s{k % 3}"))
    for k in range(60, 220):
        w = base.split()
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(w), "en", "hot"))
    for k in range(220, 300):
        rows.append((k, words(rng, rng.randrange(1, 60), 10**6) + " " + passage, "en", "hot"))
    rows += [(300, None, None, None), (301, "", "en", None), (302, "One Two", "en", "s1"), (303, "one  two", "en", "s1"), (304, " \t\n", "en", "é"), (305, "é" * 50_000 + " z", "fr", "s0")]
    return rows


def test_empty_tables(spark):
    e = docs(spark, [], 1)
    assert transport.media_column(e).count() == 0
    assert langid.identify(e, langid.train(langid.training_rows(e))).count() == 0
    assert packing.pack_documents(e).count() == 0
    assert mixing.mix(e)[0].count() == 0 and mixing.mixed_documents(e).count() == 0
    assert jaccard.similar_groups(e).count() == 0 and jaccard.one_of_each(e.select("doc_id", "text", "lang", "source", "n_chars")).count() == 0
    assert edits.edited_fingerprints(e).count() == 0 and edits.fingerprints(e).count() == 0
    assert sharding.shard(e).count() == 0
    assert licenses.licenses(e).count() == 0
    assert privacy.personal_data(e).count() == 0 and privacy.sanitised(e).count() == 0
    assert templates.chat_digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- chat ----------------------------------------------------------------------------------------------------


def test_conversations_in_any_order(spark):
    rows = [(2, 1, "assistant", "b</s>"), (2, 0, "user", "a"), (1, 0, None, None), (None, 0, "user", "x"), (2, 1, "assistant", "b</s>"), (2, 2, "user", "[INST]")]
    got = {r.conv_id: r for r in templates.chat_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()}
    assert set(got) == {None, 1, 2} and got[2].n_turns == 4 and got[2].loss_chars == 10
    assert got[2].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb</s>\nassistant\nb</s>\nuser\n[INST]\n").hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest()


# --- languages -----------------------------------------------------------------------------------------------


def test_languages_are_told_apart(spark):
    rng = random.Random(1)
    parts = {"aa": "ka lo mi ne pu".split(), "bb": "sch ung ter ein ver".split()}
    make = lambda lang: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(60))
    rows = [(k, make("aa" if k % 2 else "bb"), "aa" if k % 2 else "bb", "s") for k in range(200)] + [(900, None, "aa", "s"), (901, "12 34!", None, "s"), (902, "12", "zz", "s")]
    d = docs(spark, rows)
    model = langid.train(langid.training_rows(d))
    assert set(model) == {"aa", "bb"}
    got = {r.doc_id: r for r in langid.identify(d, model).collect()}
    assert all(got[k].lang_pred == ("aa" if k % 2 else "bb") and 0 <= got[k].score <= 1 and not got[k].rejected for k in range(200))
    assert all((got[k].lang_pred, got[k].score, got[k].rejected) == ("und", 0.0, True) for k in (900, 901, 902))
    kept = langid.kept(d.select(*SCHEMA.replace(" long", "").replace(" string", "").split(", ")), model)
    assert kept.count() == 200 and kept.schema.simpleString().startswith("struct<doc_id:bigint,text:string")


def test_held_out_rows_teach_nothing(spark):
    d = docs(spark, [(k, "abc def", "xx", "s") for k in range(30)])
    ids = {r.doc_id for r in langid.training_rows(d).collect()}
    assert ids == {k for k in range(30) if zlib.crc32(str(k).encode()) % 3 != 1}


def test_null_ids_are_not_held_out(spark):
    d = docs(spark, [(None, "abc def", "xx", "s"), (1, "abc", "xx", "s")])
    got = {r.doc_id: r.h for r in d.select("doc_id", langid.held_out(F.col("doc_id")).alias("h")).collect()}
    assert got == {None: False, 1: zlib.crc32(b"1") % 3 == 1}
    assert all(r.doc_id is not None for r in langid.training_rows(d).collect())


# --- packing -------------------------------------------------------------------------------------------------


def test_pieces_tile_documents_and_sequences(spark, corpus):
    rows = [*corpus, (1, "twice", "en", "a"), (1, "twice", "en", "a")]
    got = packing.pack_documents(docs(spark, rows), capacity=256).collect()
    e = packing.encoder(packing.VOCABULARY)
    want = Counter()
    for i, t, *_ in rows:
        ids = e(t or "") + bytes(4)
        for k, at in enumerate(range(0, len(ids), 1024)):
            want[i, k, at // 4, len(ids[at : at + 1024]) // 4, zlib.crc32(ids[at : at + 1024])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for mine in by.values():
        at = 0
        for offset, length in sorted(mine):
            assert offset == at
            at += length
        assert at <= 256
    least = max(-(-sum(r.length for r in got) // 256), sum(r.length > 128 for r in got))
    assert len(by) <= 1.02 * least + 2


# --- mixing --------------------------------------------------------------------------------------------------


def fair_targets(sizes):
    """Water level by repeated sharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), float(sum(sizes.values())), set(order)
    while left > 1e-9 and open_:
        w = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / w for s in open_}
        left = 0.0
        for s, x in share.items():
            target[s] += x
            if target[s] > 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    return target


def test_targets_and_takings(spark, corpus):
    rows = [*corpus, (7, "same row", "en", "tiny"), (7, "same row", "en", "tiny")]
    d = docs(spark, rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += size(t)
    want = fair_targets(sizes)
    all_rows, taken = mixing.mix(d, block=4, slots=64)
    got = all_rows.collect()
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((i, size(t), s) for i, t, _, s in rows)
    assert all(r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] for r in got)
    by_key = {r.key: r.size for r in got}
    assert len(by_key) == len(rows)
    f = taken.collect()
    per_row, per_source = Counter(), Counter()
    source = {r.key: r.source for r in got}
    for r in f:
        per_row[r.key] += r.words * r.times
        per_source[source[r.key]] += r.words * r.times
    assert all(n <= 3 * by_key[k] for k, n in per_row.items())
    for s, t in want.items():
        assert abs(per_source[s] - t) <= max(0.05 * t, 24)
    again = mixing.mix(docs(spark, rows, 5), block=4, slots=64)[1]
    assert sorted((r.key, r["from"], r.times) for r in again.collect()) == sorted((r.key, r["from"], r.times) for r in f)
    mixed = mixing.mixed_documents(d, block=4, slots=64)
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sum(size(r.text) for r in mixed.collect()) == sum(per_row.values())


def test_permutations(spark):
    for n in (1, 2, 3, 5, 16, 17, 97, 1000, 30_103):
        length = F.lit(n).cast("long")
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), length, *mixing.sides(length), F.lit(3))).collect()]
        assert sorted(got) == list(range(n))


def test_shards_draw_multinomial_counts(spark):
    """Over seeds a shard's counts have the multinomial's means and variances, and totals stay near theirs."""
    share, each, shards = [0.45, 0.3, 0.2, 0.05], 6, 101
    sources = spark.createDataFrame(list(enumerate(share)), "sid long, share double")
    of_shards = F.lit(shards).cast("long")
    counts, totals = [], []
    for seed in range(12):
        s = mixing.counts_of(sources, each, shards, seed).filter("count > 0").withColumn("r", F.explode(F.sequence("first", F.col("first") + F.col("count") - 1)))
        s = s.withColumn("shard", mixing.permuted(F.col("r"), of_shards, *mixing.sides(of_shards), F.col("j"), F.lit(seed + 1)))
        got = s.groupBy("shard").pivot("sid", [0, 1, 2, 3]).count().na.fill(0).toPandas()
        assert sorted(got["shard"]) == list(range(shards))
        table = got[["0", "1", "2", "3"]].to_numpy()
        assert (table.sum(axis=1) == each).all()
        counts.append(table)
        totals.append(table.sum(axis=0))
    every = np.vstack(counts)
    p = np.array(share)
    assert np.abs(every.mean(axis=0) - each * p).max() < 0.1
    assert np.abs(every.var(axis=0) - each * p * (1 - p)).max() < 0.2
    assert abs(np.cov(every[:, 0], every[:, 1])[0, 1] + each * share[0] * share[1]) < 0.2
    assert np.abs(np.array(totals) - each * shards * p).max() <= each


def test_slots_fill_shards_and_join_blocks(spark, corpus):
    got = mixing.mixed_slots(docs(spark, corpus), block=4, slots=64).collect()
    by_slot = {}
    for r in got:
        by_slot.setdefault((r.sid, r.slot), []).append(r)
    sizes = Counter(rows[0].shard for rows in by_slot.values())
    assert len(set(sizes.values())) == 1 and sorted(sizes) == list(range(len(sizes)))
    assert all(sum(r.words for r in rows) <= 4 and len({r.block for r in rows}) == 1 for rows in by_slot.values())


def test_slots_beyond_the_passes_are_drawn_again(spark):
    """A tiny source stops at three passes; what is drawn beyond goes to another, and no slot is lost."""
    sources = spark.createDataFrame([(0, 40, 120.0), (1, 400, 120.0), (2, 4000, 4200.0)], "sid long, source_size long, target double")
    for seed in range(8):
        s = mixing.slots_of(sources, 64, 4, 3, seed).collect()
        by = Counter(r.sid for r in s)
        assert by[0] <= 30 and 1110 <= len(s) <= 1120 and len({(r.sid, r.slot) for r in s}) == len(s)
        assert all(sorted(r.slot for r in s if r.sid == k) == list(range(by[k])) for k in by)
        used = Counter((r.sid, r.block) for r in s)
        assert max(used.values()) <= 3 and all(0 <= b < {0: 10, 1: 100, 2: 1000}[k] for k, b in used)


def test_repeated_rows_are_numbered_in_buckets(spark):
    rows = [(1, "the same words", "en", "s")] * 300 + [(2, "others", "en", "s"), (None, "x", None, None), (None, "x", None, None)]
    keyed = mixing.with_key(mixing.with_identity(docs(spark, rows, 5)), False).collect()
    assert len({r.key for r in keyed}) == len(rows)
    assert sorted(int(r.key.split("#")[1]) for r in keyed if r.doc_id == 1) == list(range(300))
    again = mixing.with_key(mixing.with_identity(docs(spark, rows, 2)), False).collect()
    assert sorted((r.doc_id or 0, r.key) for r in keyed) == sorted((r.doc_id or 0, r.key) for r in again)


def test_tables_without_words(spark):
    rows, taken = mixing.mix(docs(spark, [(1, None, None, None), (2, " ", None, "a")]))
    assert [(r.size, r.target) for r in rows.collect()] == [(0, 0.0), (0, 0.0)] and taken.count() == 0


# --- similarity ----------------------------------------------------------------------------------------------


def brute_groups(rows, k, num, den):
    sets = []
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))) if w else frozenset()))
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and den * both >= num * len(sets[a][1] | sets[b][1]):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(least.get(find(a), i), i)
    return Counter((i, len(s), least[find(a)]) for a, (i, s) in enumerate(sets))


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100), (2, 50, 100)])
def test_groups_equal_brute_force(spark, corpus, k, num, den):
    got = jaccard.similar_groups(docs(spark, corpus, 4), k, num, den).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(corpus, k, num, den)


def test_long_lists_are_dealt_into_blocks(spark, corpus, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    got = jaccard.similar_groups(docs(spark, corpus, 4), 4, 85, 100).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(corpus, 4, 85, 100)


def test_frequent_shingles_only_change_the_order(spark, corpus, monkeypatch):
    monkeypatch.setattr(jaccard, "OFTEN", 2)
    got = jaccard.similar_groups(docs(spark, corpus, 1), 4, 85, 100).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(corpus, 4, 85, 100)


def test_equal_ids(spark):
    rows = [(1, "a b c d e f", "en", "s"), (1, "a b c d e f", "en", "s"), (1, "other words than those", "en", "s"), (2, "A b c d e f", "en", "s"), (3, None, "en", "s")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs(spark, rows)).collect())
    assert got == [(1, 1, 1), (1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 0, 3)]
    kept = jaccard.one_of_each(docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars"))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "a b c d e f"), (1, "other words than those"), (3, None)]


def test_components_of_paths_stars_and_rings(spark):
    e = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(k, 200 + (k - 199) % 20) for k in range(200, 220)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)} | {k: 200 for k in range(200, 220)}


# --- edits ---------------------------------------------------------------------------------------------------


def test_edited_texts_take_from_the_next(spark, corpus, monkeypatch):
    monkeypatch.setattr(edits, "RANGE_ROWS", 20)
    got = {r.doc_id: r for r in edits.edited_fingerprints(docs(spark, corpus, 5)).collect()}
    rows = sorted(corpus)
    texts = [t or "" for _, t, *_ in rows]
    for (i, *_), a, b in zip(rows, texts, texts[1:] + texts[:1], strict=True):
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        assert got[i].n_chars == len(a) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        c, n = edits.codes_of(edited), edits.codes_of(b)
        own, other, following = edits.read(got[i].fingerprint), edits.fingerprint(c), edits.fingerprint(n)
        assert got[i].edited_fingerprint == edits.spelt(other)
        assert (got[i].band_edited, got[i].edits_edited) == edits.verified(own, other, a, edited) and (got[i].band_next, got[i].edits_next) == edits.verified(own, following, a, b)
        assert got[i].near_edited == edits.likeness(own, other) and got[i].near_next == edits.likeness(own, following)
    plain = {r.doc_id: r.fingerprint for r in edits.fingerprints(docs(spark, corpus)).collect()}
    assert plain == {i: r.fingerprint for i, r in got.items()}


def test_one_row_and_repeated_rows(spark):
    (r,) = edits.edited_fingerprints(docs(spark, [(5, "abcd", "en", "s")])).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert edits.edited_fingerprints(docs(spark, [(5, "abcd", "en", "s")] * 3 + [(None, None, None, None)])).count() == 4


def test_links_join_near_copies(spark):
    rng = random.Random(2)
    base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(600))
    d = docs(spark, [(1, base, "en", "s"), (2, base[:300] + "#" + base[300:], "en", "s"), (3, base[::-1], "en", "s")])
    assert [(r.doc_id, r["with"], r.distance) for r in edits.links(d).collect()] == [(2, 1, 1)]


@pytest.mark.parametrize("block", [edits.BLOCK, 2])
def test_links_do_not_hang_on_the_least_of_a_band(spark, monkeypatch, block):
    monkeypatch.setattr(edits, "BLOCK", block)
    rng = random.Random(2)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    text = letters(600)
    # Both leads differ from the last three texts by far more than 5 %, one at either end.
    first, second = letters(60) + text[60:], text[:-60] + letters(60)
    near = [text, text[:300] + "#" + text[301:], text[:320] + "#" + text[321:]]
    rows = [(1, first), (2, second), (3, near[0]), (4, near[1]), (3, near[2]), (9, near[1]), (None, near[1]), (None, letters(50)), (4, near[1])]
    got = Counter((r.doc_id, r["with"], r.distance) for r in edits.links(docs(spark, [(i, t, "en", "s") for i, t in rows])).collect())
    assert got == Counter([(4, 3, 1), (4, 3, 2), (3, 3, 1), (9, 4, 0), (None, 4, 0)])


# --- shards --------------------------------------------------------------------------------------------------


def test_shards_are_even_with_a_hot_group(spark):
    rng = random.Random(3)
    rows = [(k, words(rng, rng.randrange(1, 200)), "en", "s") for k in range(2000)] + [(k, "the same text again", "en", "s") for k in range(2000, 3000)] + [(3000, None, None, None)]
    got = sharding.shard(docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    total, count = Counter(), Counter()
    for r in got:
        total[r.shard] += r.size
        count[r.shard] += 1
    assert set(total) == set(range(16)) and max(total.values()) < 1.05 * min(total.values()) and max(count.values()) < 1.05 * min(count.values())
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(count[s]))


@pytest.mark.parametrize("unit_share", [sharding.UNIT_SHARE, 500])
def test_copies_stay_together(spark, monkeypatch, unit_share):
    monkeypatch.setattr(sharding, "UNIT_SHARE", unit_share)
    rng = random.Random(4)
    texts = [words(rng, rng.randrange(20, 60)) for _ in range(2000)]
    copies = [t for k in range(60) for t in [texts[k]] * (1 + k % 3)]
    rows = [(k, t, "en", "s") for k, t in enumerate(texts + copies + ["one hot text"] * 300)]
    got = sharding.shard(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    at = {}
    for r in got:
        at.setdefault(r.text_md5, []).append(r.shard)
    hot = max(at.values(), key=len)
    assert len(set(hot)) == 16 and all(len(set(s)) == 1 for s in at.values() if s is not hot)
    total = Counter()
    for r in got:
        total[r.shard] += r.size
    assert max(total.values()) < 1.05 * min(total.values())


def plain_placement(units, shards, turn):
    """Dot products with what is left, one unit after the other, in plain Python."""
    total = [sum(u[k] for u in units) or 1 for k in range(3)]
    left, out = [[1 / shards] * 3 for _ in range(shards)], {}
    for i in sorted(range(len(units)), key=lambda i: -max(units[i][k] / total[k] for k in range(3))):
        v = [units[i][k] / total[k] for k in range(3)]
        best = max(range(shards), key=lambda s: (sum(a * b for a, b in zip(left[(s + turn) % shards], v, strict=True)), -s))
        out[i] = s = (best + turn) % shards
        left[s] = [a - b for a, b in zip(left[s], v, strict=True)]
        turn = (turn + 1) % shards
    return [out[i] for i in range(len(units))]


def test_placement_equals_plain_dot_products():
    rng = random.Random(11)
    for turn in (0, 3):
        units = [(rng.randrange(1, 5000), rng.randrange(1, 900), rng.randrange(1, 4)) for _ in range(300)]
        got = sharding.place(np.array(units, float), 16, turn).tolist()
        want = plain_placement(units, 16, turn)
        # Sums in another order may differ in a last bit, and so a tie: the loads don't.
        load = lambda at: sorted(sum(u[0] for u, s in zip(units, at, strict=True) if s == k) for k in range(16))
        assert got == want or np.allclose(load(got), load(want), rtol=0.02)
    # Ties of dot products go round: equal units are dealt out one by one.
    assert sorted(sharding.place(np.ones((16, 3)), 16, 5).tolist()) == list(range(16))
    assert sharding.place(np.ones((3, 3)), 16, 5).tolist() == [5, 6, 7]


# --- licenses, media -----------------------------------------------------------------------------------------


def test_scans_and_media_of_odd_rows(spark, corpus):
    rows = [*corpus, (400, "x\n" + licenses.TEMPLATES["Apache-2.0-notice"] + "\ny", "en", "s")]
    got = {r.doc_id: r for r in licenses.licenses(docs(spark, rows)).collect()}
    assert got[400].licenses == "Apache-2.0-notice" and got[400].coverage == 1 and got[400].spans == "Apache-2.0-notice:2:48"
    assert got[300].n_matches == 0 and got[300].spans == "" and sum(r.n_matches for r in got.values()) == 1
    media = {r.doc_id: r for r in transport.media_column(docs(spark, rows)).collect()}
    assert all(transport.demux(bytes(media[i].media)).payload == transport.pad((t or "").encode()) for i, t, *_ in rows)


# --- personal data -------------------------------------------------------------------------------------------


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        out += [("card", m.start(), m.end())] if 16 <= len(d) <= 19 and luhn(d) else []
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def spell(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(9)
    pieces = ["a.b@c.de", "x@y", "@", "a@b.c_d@e.f", "1.2.3.4", "001.2.3.255", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "12345678901234567890", "+1 (555) 010-9999", "+12", "+49.30.1234567", "é", " ", "-", "\n", "7", "..", "99999999999.1.1.1", "+", "(", "word"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 14))) for _ in range(400)] + ["9" * 30_000, "a" * 30_000 + "@b.c", "+1 " + "(" * 20_000, "a.b@" + "c." * 20_000 + "d", "1 " * 20_000, None]
    got = privacy.personal_data(docs(spark, [(k, t, "en", "s") for k, t in enumerate(texts)])).select("doc_id", privacy.spell(F.col("base")).alias("s")).collect()
    assert {r.doc_id: r.s for r in got} == {k: spell(brute_spans(t or "")) for k, t in enumerate(texts)}


def test_terms_that_tell_are_marked(spark):
    rows = [(k, f"clerk wrote to jane.roe@example.org about Zanzibar today number {k}", "en", "s") for k in range(4)]
    rows += [(k, f"clerk wrote about ordinary things today and number {k}", "en", "s") for k in range(4, 60)]
    d = docs(spark, rows)
    got = {r.doc_id: r for r in privacy.personal_data(d).collect()}
    for k in range(4):
        marked = {(s.kind, s.value) for s in got[k].terms}
        assert ("removed", "zanzibar") in marked and not any(v in ("clerk", "wrote", "today") for _, v in marked)
    assert all(not got[k].terms and not got[k].base for k in range(4, 60))
    clean = {r.doc_id: r.text for r in privacy.sanitised(d).collect()}
    assert clean[0] == "clerk wrote to [EMAIL] about  today number 0"
    assert all(clean[i] == t for i, t, *_ in rows[4:])
    assert got[0].doc_id == 0 and privacy.sanitised(d).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_terms_far_from_an_entity_are_marked(spark):
    far = " plain words go on and on" * 40
    rows = [(k, f"Zanzibar{far} mail jane.roe@example.org now{far} and zanzibar again, Tiny", "en", "s") for k in range(4)]
    rows += [(k, f"tiny{far} mail now again {k}", "en", "s") for k in range(4, 60)]
    d = docs(spark, rows)
    got = {r.doc_id: r for r in privacy.personal_data(d).collect()}
    for k, t, *_ in rows[:4]:
        assert [(s.kind, s.start, s.end, s.value) for s in got[k].terms] == [("removed", m.start(), m.end(), "zanzibar") for m in re.finditer("[Zz]anzibar", t)]
    assert all(not got[k].terms for k in range(4, 60))
    clean = {r.doc_id: r.text for r in privacy.sanitised(d).collect()}
    assert clean[0] == f"{far} mail [EMAIL] now{far} and  again, Tiny"


def brute_disclosure(rows):
    """Spans of terms by counting documents in plain Python."""
    base = {i: brute_spans(t or "") for i, t, *_ in rows}
    text = {i: t or "" for i, t, *_ in rows}
    term = re.compile(r"(?<![^\W_])(?<![@._%+-])[^\W\d_]{4,}(?![^\W_]|[@_%+-]|\.[^\W_])")
    words = {i: [(m[0].lower(), m.start(), m.end()) for m in term.finditer(t)] for i, t in text.items()}
    kinds = ("email", "ip", "card", "phone")
    plain = lambda k, v: v.lower() if k == "email" else v if k == "ip" else re.sub("[^0-9]", "", v)
    held = {i: {(k, plain(k, text[i][a:b])) for k, a, b in s} for i, s in base.items()}
    n = max(2, len(rows))
    df_t = Counter(w for i in words for w in {x[0] for x in words[i]})
    df_e = Counter(e for i in held for e in held[i])
    both = Counter((w, e) for i in held for e in held[i] for w in {x[0] for x in words[i]})
    tells = {}
    for (w, e), c in both.items():
        if c >= privacy.SUPPORT and df_e[e] >= privacy.SUPPORT:
            d = math.log2(n * c / (df_t[w] * df_e[e])) / math.log2(n / min(df_e[e], n / 2))
            if d >= privacy.GENERALISE:
                tells[w, e] = d
    out = {}
    for i in text:
        best = {}
        for e in held[i]:
            for w in {x[0] for x in words[i]}:
                if (w, e) in tells:
                    best[w] = max(best.get(w, 0), tells[w, e])
        out[i] = sorted((a, b, "removed" if best[w] >= privacy.REMOVE else "generalised", w) for w, a, b in words[i] if w in best)
    assert all(k in kinds for i in base for k, *_ in base[i])
    return out


def test_disclosure_equals_brute_force(spark):
    rng = random.Random(12)
    names = [f"name{chr(97 + k)}son" for k in range(12)]
    entities = [f"p{k}@mail.org" for k in range(8)] + ["10.0.0.1", "+1 555 010 9999", "4111 1111 1111 1111"]
    common = "alpha beta gamma delta epsilon theta iota kappa lambda sigma omega".split()
    rows = []
    for k in range(160):
        w = [rng.choice(common) for _ in range(rng.randrange(3, 25))]
        if k % 3 == 0:
            e = rng.randrange(len(entities))
            for _ in range(rng.randrange(1, 3)):
                w.insert(rng.randrange(len(w)), entities[e])
            if rng.random() < 0.8:
                w.insert(rng.randrange(len(w)), names[e].upper() if rng.random() < 0.3 else names[e])
            if rng.random() < 0.3:
                w.insert(rng.randrange(len(w)), entities[rng.randrange(len(entities))])
        elif rng.random() < 0.1:
            w.append(rng.choice(names))
        rows.append((k, rng.choice([" ", ", ", "\n"]).join(w) + rng.choice(["", ".", " é", " naméd_x", " a.bcde fghi."]), "en", "s"))
    rows += [(500, None, None, None), (501, "", "en", "s")]
    got = {r.doc_id: sorted((s.start, s.end, s.kind, s.value) for s in r.terms) for r in privacy.personal_data(docs(spark, rows)).collect()}
    want = brute_disclosure(rows)
    assert got == want and sum(map(len, want.values())) > 10
    assert {k for v in want.values() for _, _, k, _ in v} == {"removed", "generalised"}


def test_the_stronger_kind_of_a_term_wins(spark):
    """A term that is generalised for one entity of a row and removed for another is removed."""
    d = spark.createDataFrame([("k", "term", 0.85), ("k", "term", 0.99)], "key string, term string, disclosure double")
    assert [r[0] for r in d.groupBy("key", "term").agg(F.max("disclosure")).select("max(disclosure)").collect()] == [0.99]
    rows = [(k, "Zanzibar a@x.org b@y.org", "en", "s") for k in range(3)] + [(k, "Zanzibar a@x.org", "en", "s") for k in range(3, 6)] + [(k, f"other words {k}", "en", "s") for k in range(6, 40)]
    got = {r.doc_id: {s.kind for s in r.terms} for r in privacy.personal_data(docs(spark, rows)).collect()}
    assert all(got[k] == {"removed"} for k in range(6))


def test_repeated_rows_count_once(spark):
    d = docs(spark, [(1, "mail me at a.b@c.org Quagmire please", "en", "s")] * 5 + [(k, "other text", "en", "s") for k in range(2, 40)])
    got = [r for r in privacy.personal_data(d).collect() if r.doc_id == 1]
    assert len(got) == 5 and all(len(r.base) == 1 and not r.terms for r in got)


def test_repeating_rows_changes_no_span(spark):
    """A term that stands in both documents of an entity and nowhere else is told, however often any row occurs."""
    rows = [(1, "zebulon writes a.b@c.de daily", "en", "s"), (2, "ask zebulon at a.b@c.de now", "en", "s")] + [(k, f"plain words number {k} daily", "en", "s") for k in range(3, 40)]
    want = {r.doc_id: (r.base, r.terms) for r in privacy.personal_data(docs(spark, rows)).collect()}
    assert {s.value for s in want[1][1]} == {s.value for s in want[2][1]} == {"zebulon"}
    for k, times in ((0, 6), (1, 30), (5, 50)):
        got = privacy.personal_data(docs(spark, rows + [rows[k]] * times)).collect()
        assert len(got) == len(rows) + times and all((r.base, r.terms) == want[r.doc_id] for r in got)


@pytest.mark.parametrize("seed", range(4))
def test_exchanges_even_out_bytes_and_move_nothing_else(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.pareto(1.2, 220).clip(0, 9).round(3) * 1000 + 1
    start = sharding.place(np.stack([sizes, sizes, np.ones(220)], axis=1), 16)
    at = sharding.evened(start, sizes, 16)
    before, after = (np.bincount(a, sizes.astype(int), 16) for a in (start, at))
    assert np.ptp(after) <= np.ptp(before) and np.ptp(after) < 0.01 * after.mean()
    assert len(at) == 220 and set(at.tolist()) <= set(range(16))
    assert sharding.evened(np.zeros(1, np.int32), np.array([5.0]), 16).tolist() in ([0], [1])


def test_sizes_of_shards_are_near_equal_on_the_smallest_tables(spark):
    got = sharding.shard(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).select("shard", "size", "text_md5").collect()
    load, homes = Counter(), {}
    for r in got:
        load[r.shard] += r["size"]
        homes.setdefault(r.text_md5, set()).add(r.shard)
    assert (max(load.values()) - min(load.values())) < 0.03 * sum(load.values()) / 16 and all(len(h) == 1 for h in homes.values())
