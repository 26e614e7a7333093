"""Language identification against plain compression and plain choices of training texts; ties, margins, repeats."""

from __future__ import annotations

import random
from collections import Counter

import zstandard
from pyspark.sql import functions as F

from modalis.llm import langid

WORDS = {"aa": "river stone walking under yellow mountain clouds evening silver".split(), "bb": "fluss stein gehen unter gelben bergen wolken abend silber".split(), "cc": "rio piedra andar bajo montana nubes tarde plata amarilla".split()}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def table_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).selectExpr("*", "1 AS h", "2 AS md5", "3 AS n", "4 AS m")


def sizes(dictionaries, t):
    """Sizes by compressors that are made anew for each text, of the whole text in pieces."""
    data = f" {langid.OTHERS.sub(' ', t.lower())} ".encode() + b"\n" * 64
    out = {}
    for lang, d in dictionaries.items():
        p = zstandard.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, **langid.SEARCH)
        z = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        parts = [zstandard.ZstdCompressor(dict_data=z, compression_params=p).compress(data[k : k + langid.PIECE]) for k in range(0, len(data), langid.PIECE)]
        back = b"".join(zstandard.ZstdDecompressor(dict_data=z).decompress(x, max_output_size=langid.PIECE) for x in parts)
        assert back == data
        out[lang] = sum(map(len, parts))
    return out


def test_predictions_are_the_least_sizes(spark):
    rng = random.Random(1)
    rows = [(k, text(rng, rng.choice("abc") * 2, rng.randrange(1, 80)), None) for k in range(3000, 3100)]
    rows += [(k, t, lang) for k in range(400) for lang in [rng.choice(["aa", "aa", "bb", "cc"])] for t in [text(rng, lang, rng.randrange(5, 60))]]
    rows += [(5000, text(rng, "bb", 9_000), None), (5001, "silver abend plata", None), (5002, text(rng, "aa", 20) + " " + text(rng, "cc", 20), None)]
    rows += rows[:7] * 2
    d = table_of(spark, rows)
    model = langid.train(langid.training_rows(d))
    got = [(r.doc_id, r.lang_pred, r.score, r.rejected) for r in langid.identify(d, model).collect()]
    assert Counter(g[0] for g in got) == Counter(r[0] for r in rows)
    by = {}
    for g in got:
        assert by.setdefault(g[0], g) == g  # repeated rows are judged alike
    narrow = 0
    for doc_id, t, _ in {r[0]: r for r in rows}.values():
        s = sizes(model, t)
        order = sorted(s.values())
        assert s[by[doc_id][1]] == order[0]
        assert by[doc_id][3] == (order[1] - order[0] < langid.MARGIN * order[0])
        narrow += by[doc_id][3]
    assert len(model) == 3 and narrow >= 0


def test_training_texts_are_those_with_the_least_hashes(spark):
    rng = random.Random(2)
    rows = [(k % 250, text(rng, lang, rng.randrange(3, 30)), lang) for k in range(400) for lang in [rng.choice(["aa", "bb"])]]
    rows += [(1, None, "aa"), (2, "123", "bb"), (3, text(rng, "cc", 9), None)]
    d = table_of(spark, rows)
    model = langid.train(d, per_lang=8, dict_bytes=100_000)
    hashed = d.select("doc_id", "text", "lang", F.xxhash64(F.col("doc_id").cast("string"), F.lit("langid")).alias("hash"), F.md5(F.col("text").cast("binary")).alias("digest")).collect()
    known = [r for r in hashed if r.lang is not None and r.text is not None and langid.has_letter(r.text)]
    want = {}
    for lang in ("aa", "bb"):
        mine = [r for r in known if r.lang == lang]
        least = {}
        for r in mine:
            c = r["hash"] % 8
            least[c] = min(least.get(c, (r["hash"], r.doc_id, r.digest, r.text)), (r["hash"], r.doc_id, r.digest, r.text))
        want[lang] = sorted((h, t) for h, _, _, t in least.values())
    assert {k: v for k, v in model.items()} == {lang: b"".join(langid.letters(t) for _, t in x) for lang, x in want.items()}
    counts = Counter(r.lang for r in known)
    assert list(model) == sorted(model, key=lambda k: (-counts[k], k))


def test_ties_go_to_the_most_frequent_language_and_are_rejected():
    d = b" river stone walking under yellow mountain clouds "
    c = langid.Classifier({"zz": d, "aa": d, "mm": b" fluss stein gehen "})
    lang, score, rejected = c.predict("stone river walking")
    assert lang == "zz" and rejected and score < 0.51
    assert langid.Classifier({"zz": d, "mm": b" fluss stein gehen "}).predict("stone river walking under")[::2] == ("zz", False)
    wide = langid.Classifier({"zz": d, "mm": b" fluss stein gehen "}, margin=10)
    assert wide.predict("stone river walking under")[2]
    assert langid.Classifier({"only": d}).predict("stone")[::2] == ("only", False)


def test_rows_that_clash_do_not_all_teach(spark):
    """Of rows with one id and language but different texts, one is picked of each class."""
    rows = [(7, f"stone river number {'abcdefgh'[k % 8]} {'x' * (k + 1)}", "aa") for k in range(60)]
    assert langid.train(table_of(spark, rows)).keys() == {"aa"}
    assert langid.train(table_of(spark, rows))["aa"].count(b"stone") == 1
