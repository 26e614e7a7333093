"""Vector codes against plain rounds over all vectors."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from modalis.llm import codes


def plain(rows, entries=codes.ENTRIES, rounds=codes.ROUNDS):
    """Every part against every entry in every round, in whole numbers."""
    kept = [(i, lab, [math.floor(1024 * x) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[2]))
    width = len(kept[0][2]) // 4
    books = [[r[2][p * width : (p + 1) * width] for r in kept[:entries]] for p in range(4)]
    part = lambda r, p: r[2][p * width : (p + 1) * width]
    near = lambda x, b: min((sum((a - c) ** 2 for a, c in zip(x, e, strict=True)), k) for k, e in enumerate(b))
    for _ in range(rounds):
        for p in range(4):
            mine = [near(part(r, p), books[p])[1] for r in kept]
            for k in range(len(books[p])):
                got = [part(r, p) for r, m in zip(kept, mine, strict=True) if m == k]
                if got:
                    books[p][k] = [sum(c) // len(got) for c in zip(*got, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = []
    for r in kept:
        ends = [near(part(r, p), books[p]) for p in range(4)]
        out.append((r[0], "".join(f"{k:02x}" for _, k in ends), sum(d for d, _ in ends), r[1]))
    by = {}
    for _, _, e, lab in out:
        by[lab] = by.get(lab, 0) + e
    return sorted(((i, c, e, by[lab], digest) for i, c, e, lab in out), key=repr)


def table_of(spark, rows, parts=3):
    d = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(parts)
    return d.selectExpr("*", "1 AS code", "2 AS error", "3 AS salt", "4 AS ids")


def vectors(n, seed, width=8, ties=False):
    rng = random.Random(seed)
    f32 = lambda x: float(np.float32(x))
    return [(k, rng.choice([None, 1, 1, 1, 2]), [f32(rng.randrange(3) / 1024 if ties else rng.gauss(rng.randrange(4) - 2, 0.3)) for _ in range(width)]) for k in range(n)]


@pytest.mark.parametrize("ties", [False, True])
def test_codes_equal_plain_rounds(spark, ties):
    rows = vectors(700, 5, ties=ties)
    rows += [(900, 1, None), (901, 2, [0.5] * 7 + [None]), (902, 1, [float("nan")] + [0.0] * 7), (903, 1, [float("inf")] + [0.0] * 7), (904, 1, [float("-inf")] * 8), (3, 2, rows[9][2]), (None, None, rows[5][2]), (None, 2, rows[6][2]), *rows[:20]]
    got = [tuple(r) for r in codes.compressed(table_of(spark, rows)).collect()]
    assert sorted(got, key=repr) == plain(rows)


def test_few_rows_and_none(spark):
    rows = vectors(5, 6)
    assert sorted((tuple(r) for r in codes.compressed(table_of(spark, rows)).collect()), key=repr) == plain(rows)
    assert codes.compressed(table_of(spark, rows).limit(0)).count() == 0
    assert codes.compressed(table_of(spark, [(1, 1, None)])).collect() == []
    with pytest.raises(ValueError):
        codes.compressed(table_of(spark, [(1, 1, [0.0] * 8), (2, 1, [0.0] * 4)]))
    with pytest.raises(ValueError):
        codes.compressed(table_of(spark, [(1, 1, [0.0] * 6)]))


def test_results_do_not_hang_on_partitions_or_blocks(spark, monkeypatch):
    rows = vectors(600, 7)
    want = {tuple(r) for r in codes.compressed(table_of(spark, rows, 1)).collect()}
    monkeypatch.setattr(codes, "SALTS", 3)
    monkeypatch.setattr(codes, "few", lambda d: d)
    assert {tuple(r) for r in codes.compressed(table_of(spark, rows, 7)).collect()} == want


def test_only_overtaken_parts_are_rescanned(spark):
    """On the given embeddings later rounds compare far fewer parts than there are."""
    kept = codes.usable(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    _, _, scanned = codes.lloyd(kept, rounds=8)
    n = 4 * kept.count()
    assert scanned[0] == n and scanned == sorted(scanned, reverse=True) or sum(scanned[1:]) < 0.8 * n * (len(scanned) - 1), scanned


def test_heaps_pop_what_drift_overtakes():
    rng = np.random.default_rng(8)
    keys, rows = rng.random(50), np.arange(50, dtype=np.int32)
    h = codes.Heaps(np.zeros(0), np.zeros(0, np.int32), np.zeros(3, np.int64))
    entry = rng.integers(0, 3, 50)
    h.push(entry, keys, rows)
    k, r = h.flat()
    h = codes.Heaps(k, r, np.bincount(entry, minlength=3))
    drift = np.array([0.2, 0.0, 0.7])
    assert h.pop(drift).tolist() == [i for i in range(50) if keys[i] <= drift[entry[i]] + codes.SLIP]
    assert set(h.heaps) == {0, 2} or keys[entry == 1].min() <= codes.SLIP
