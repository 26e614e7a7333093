"""Token counts against the library, over alphabets that make long ties, and over chunks without a fresh place."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

sentencepiece = pytest.importorskip("sentencepiece")
P = pytest.importorskip("public_tokenizers")

from modalis.llm import queries, tokencount  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.path(tokencount.VOCABULARY))


@pytest.fixture(scope="module")
def compiled():
    return tokencount.transducer(tokencount.VOCABULARY)


def texts(seed: int, vocabulary: tokencount.Vocabulary) -> list[str]:
    rng = random.Random(seed)
    of = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    out = ["", " ", "  a  b ", "a\tb\nc", "<s> </s> <unk> <0x0A>", "\x00", "▁ ▁", "🙂é한字", "é"]
    for _ in range(400):
        out += [of(vocabulary.inner, rng.randrange(1, 60)), of(vocabulary.tokens, rng.randrange(1, 12)), of("aeinst r", rng.randrange(1, 1500)), of(" \t▁a.=-éλж字🙂\x00", rng.randrange(1, 80))]
    return out


def test_counts_equal_the_library(compiled, library):
    t = texts(1, compiled.v)
    assert tokencount.count_batch(compiled, pa.array(t)).tolist() == [len(x) for x in library.encode(t)]


@pytest.mark.parametrize("text", ["a" * 5000, " " * 3001, "=-" * 2500, "-" * 4097, "erereren" * 900, "é" * 3000 + " z", "00" * 2000, "ab" * 512 + " " + "in" * 1024])
def test_long_runs_without_a_fresh_place(compiled, library, text):
    assert tokencount.count_batch(compiled, pa.array([text, "x", text[:-1]])).tolist() == [len(x) for x in library.encode([text, "x", text[:-1]])]


def test_chunks_of_any_size_and_recompiling(compiled, library, monkeypatch):
    t = texts(2, compiled.v)[:400]
    want = [len(x) for x in library.encode(t)]
    own = tokencount.Transducer(compiled.v, cells=0)  # forgets before each group of texts
    for chunk, together in ((1, 1 << 20), (3, 100), (64, 1)):
        monkeypatch.setattr(tokencount, "CHUNK", chunk)
        monkeypatch.setattr(tokencount, "TOGETHER", together)
        assert tokencount.count_batch(own, pa.array(t)).tolist() == want


def test_barred_tokens_are_those_that_merge_differently(compiled):
    """``barred`` against merging each two tokens by the rule."""
    v, rng = compiled.v, random.Random(3)

    def merged(text: str) -> list[str]:
        parts = list(text)
        while True:
            best = min(((v.rank[p], k) for k in range(len(parts) - 1) if (p := parts[k] + parts[k + 1]) in v.rank), default=None)
            if best is None:
                return parts
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    for k in rng.sample(range(len(v.tokens)), 60):
        barred = set(np.frombuffer(v.barred(k), np.int32).tolist())
        tried = rng.sample(range(len(v.tokens)), 60) + rng.sample(sorted(barred), min(20, len(barred)))
        for j in tried:
            assert (j not in barred) == (merged(v.tokens[k] + v.tokens[j]) == [v.tokens[k], v.tokens[j]])


def test_a_small_vocabulary_with_ties_and_worse_first_merges():
    """Equal ranks go from the left, and a merge may need a worse one before it."""
    v = tokencount.Vocabulary({c: 0 for c in "abc▁"} | {"aa": 1, "aaa": 1, "ab": 5, "abc": 2, "ca": 2, "bca": 1})
    t = tokencount.Transducer(v)
    rng = random.Random(4)

    def plain(text: str) -> int:
        parts = list("▁" + text) if text else []
        while True:
            best = min(((v.rank[p], k) for k in range(len(parts) - 1) if (p := parts[k] + parts[k + 1]) in v.rank), default=None)
            if best is None:
                return sum(1 if p in v.rank else len(p.encode()) for p in parts)
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    some = ["".join(rng.choice("aabc") for _ in range(rng.randrange(40))) for _ in range(500)]
    assert tokencount.count_batch(t, pa.array(some)).tolist() == [plain(x) for x in some]


def test_query_and_odd_rows(spark, library):
    got = {r.doc_id: r for r in queries.op13_token_counts(spark, DATA).collect()}
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        n = len(library.encode(r.text or ""))
        assert got[r.doc_id][1:] == (len((r.text or "").encode()), n, n > 4096)
    odd = spark.createDataFrame([(1, None, 7), (1, None, 7), (None, "", 7), (2, "x" * 30_000 + " y", 7)], "doc_id long, text string, n_tokens int")
    out = sorted(tuple(r) for r in tokencount.token_counts(odd.filter("doc_id is not null")).collect())
    assert out == [(1, 0, 0), (1, 0, 0), (2, 30_002, len(library.encode("x" * 30_000 + " y")))]
    assert tuple(tokencount.token_counts(odd.filter("doc_id is null")).first()) == (None, 0, 0)
    assert tokencount.token_counts(odd.limit(0)).count() == 0
