"""Lexical search against scoring everything, and block boundaries against all ways to cut a list."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from modalis.llm import search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs, items, k=10):
    t = [(i, Counter(w.translate(LOWER) for w in WORD.findall(x or ""))) for i, x in docs]
    t = [(i, c) for i, c in t if c]
    n, total = len(t), sum(sum(c.values()) for _, c in t)
    df = Counter(w for _, c in t for w in c)
    out = []
    for item, text in set((i, x or "") for i, x in items):
        terms = {w.translate(LOWER) for w in WORD.findall(text)}
        found = []
        for i, c in t:
            m = 100 - 90 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w in terms if c[w])
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if z else i, -s) for r, (s, z, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def run(spark, docs, items, parts=3):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts).selectExpr("*", "1 AS item", "2 AS score", "3 AS rank", "4 AS terms")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS score")
    return sorted((tuple(r) for r in search.ranked(d, i).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_ranks_equal_scoring_everything(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)] + ["Éa", "ñ", "x1", "Ab"]
    text = lambda n: rng.choice([" ", ", ", "\n", "_", "\x7f"]).join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=n))
    docs = [(k, text(rng.randrange(1, 60))) for k in range(400)]
    docs += [(400 + k, docs[7][1]) for k in range(30)] + [(500, None), (501, ""), (502, " .,\t"), (503, "AB ab Ab"), (None, docs[7][1]), (None, "w0 w1"), (504, "w3 " * 20_000)] + docs[:5]
    items = [(k, text(rng.randrange(1, 12))) for k in range(20)] + [(20, docs[7][1]), (21, None), (22, "?!"), (23, "absent words"), (24, "ab AB é éa"), (0, "w9"), (None, "w2 w3"), (20, docs[7][1])]
    assert run(spark, docs, items) == plain(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == [] and run(spark, [(1, "a b")], []) == [] and run(spark, [(1, None), (2, "")], [(1, "a")]) == []


def test_several_passes_over_items(spark, monkeypatch):
    docs, items = [(k, f"a{k % 7} b{k % 5} c") for k in range(50)], [(k, f"a{k} c b{k}") for k in range(9)]
    monkeypatch.setattr(search, "ITEM_BYTES", 20)
    assert run(spark, docs, items) == plain(docs, items)


@pytest.mark.parametrize("seed", range(8))
def test_boundaries_have_the_least_cost(seed):
    """All cuts of short lists at the grain, by brute force."""
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 30, 6)
    scores = rng.choice([1, 2, 3, 50, 60, 400], lengths.sum()).astype(float)
    got = search.boundaries(scores, lengths)
    ends = np.cumsum(lengths)
    for at, end in zip(ends - lengths, ends, strict=True):
        mine = scores[at:end]

        def cost(cuts, mine=mine):
            return sum((mine[a:b].max() - mine[a:b]).sum() + search.PRICE * mine.max() for a, b in itertools.pairwise([*cuts, len(mine)]))

        places = range(search.GRAIN, len(mine), search.GRAIN)
        least = min(cost([0, *c]) for n in range(len(places) + 1) for c in itertools.combinations(places, n))
        assert math.isclose(cost((got[(got >= at) & (got < end)] - at).tolist()), least)


def shard_of(docs, terms):
    found = [[(t, c[t]) for t in range(terms) if c[t]] for c in docs]
    lists = [[(d, dict(f)[t]) for d, f in enumerate(found) if t in dict(f)] for t in range(terms)]
    some = [t for t in range(terms) if lists[t]]
    return {
        "doc_ids": list(range(len(docs))), "sizes": np.array([max(1, sum(c.values())) for c in docs], np.int64).tobytes(), "terms": some, "counts": [len(lists[t]) for t in some],
        "docs": np.array([d for t in some for d, _ in lists[t]], np.int32).tobytes(), "times": np.array([n for t in some for _, n in lists[t]], np.int64).tobytes(),
    }


def test_blocks_without_pivots_stay_closed_and_nothing_is_lost():
    rng = random.Random(9)
    docs = [Counter(rng.choices(range(40), [1 / (k + 1) ** 1.5 for k in range(40)], k=rng.randrange(1, 80))) for _ in range(3000)]
    weights = np.array([50 + 60 * k for k in range(40)], np.int64)
    total = sum(sum(c.values()) for c in docs)
    s = search.Shard(shard_of(docs, 40), weights, len(docs), total)
    for _ in range(40):
        terms = np.array(sorted(rng.sample(range(45), rng.randrange(1, 8))))
        best = s.search(terms, [], 10)
        score = Counter()
        for d, c in enumerate(docs):
            m = 10 + 90 * max(1, sum(c.values())) * len(docs) // total
            for t in terms.tolist():
                if c[t]:
                    score[d] += int(weights[t]) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
        assert best == sorted((-v, False, d) for d, v in score.items() if v)[:10]
    assert 0 < s.opened < 1.2 * s.blocks  # most searches open a block at most once or not at all
    before = s.opened
    high = [(-(10**15), False, 0)] * 10
    assert s.search(np.array([0, 1, 2]), high, 10) == high and s.opened == before
