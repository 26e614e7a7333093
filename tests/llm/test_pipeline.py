"""The corpus pipeline: stages take effect, in order, and keep what they should."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
from modalis.llm import packing, queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark, tmp_path):
    rng = random.Random(4)
    parts = {"aa": "ka lo mi ne pu".split(), "bb": "sch ung ter ein ver".split()}
    make = lambda lang: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(80))
    rows = []
    for k in range(120):
        lang = "aa" if k % 3 else "bb"
        rows.append((k, make(lang), lang, f"s{k % 4}"))
    rows += [(200 + k, rows[0][1], "bb", "s0") for k in range(5)]
    rows += [(300, rows[1][1] + " ending", "aa", "s1"), (301, "1 2 3", "aa", "s1"), (302, None, None, None), (303, make("aa") + " write a.b@c.org now", "aa", "s2")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.withColumnRenamed("n_chars", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    return rows


def test_stages(spark, tmp_path):
    rows = table(spark, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = seen[name] = spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or docs.columns == COLUMNS
    ids = lambda n: sorted(r.doc_id for r in seen[n].select("doc_id").collect())
    every = sorted(r[0] for r in rows)
    assert ids("language") == [i for i in every if i not in (301, 302)]
    gone = {300, *range(200, 205)}
    assert ids("near_duplicates") == [i for i in ids("language") if i not in gone]
    text = {r.doc_id: r.text for r in seen["privacy"].collect()}
    plain = {r[0]: r[1] for r in rows}
    assert "[EMAIL]" in text[303] and "a.b@c.org" not in text[303]
    assert all(text[i] == plain[i] for i in text if i != 303)
    size = lambda t: len((t or "").split())
    mixed = [(r.doc_id, size(r.text)) for r in seen["mixture"].collect()]
    assert abs(sum(n for _, n in mixed) - sum(map(size, text.values()))) < 0.1 * sum(map(size, text.values()))
    assert all(sum(n for i, n in mixed if i == k) <= 3 * size(text[k]) for k, _ in mixed)
    e = packing.encoder(packing.VOCABULARY)
    tokens = sum(len(e(r.text)) // 4 + 1 for r in seen["mixture"].collect())
    pieces = seen["packing"].collect()
    assert sum(r.length for r in pieces) == tokens
    fill = np.zeros(0)
    by = {}
    for r in pieces:
        by[r.sequence_id] = by.get(r.sequence_id, 0) + r.length
    fill = np.array(list(by.values()))
    assert fill.max() <= 2048 and len(fill) <= -(-tokens // 2048) + 1
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in got.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in pieces)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "privacy", "mixture", "packing"]
