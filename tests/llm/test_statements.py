"""Queries against their DuckDB statements, on the smallest scale and on odd rows."""

from __future__ import annotations

import random
from pathlib import Path

import duckdb
import pytest

from modalis.llm import queries

DATA = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(spark, name, folder):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        if Path(folder, f"{t}.parquet").exists():
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'/*.parquet' if Path(folder, f'{t}.parquet').is_dir() else ''}')")
    got, want = queries.QUERIES[name](spark, folder), c.sql(queries.ORACLE_SQL[name])
    assert {n: TYPES[t] for n, t in got.dtypes} == dict(zip(want.columns, map(str, want.types), strict=True))
    rows = sorted((tuple(r[n] for n in want.columns) for r in got.collect()), key=repr)
    assert rows == sorted(want.fetchall(), key=repr) and rows


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_statement(spark, name):
    compare(spark, name, DATA)


def test_odd_rows(spark, tmp_path):
    rng = random.Random(13)
    w = lambda n: " ".join(f"word{rng.randrange(60):02d}x" for _ in range(n))
    base = w(40)
    texts = [None, "", " \t\n", "One two", "one  TWO", "éÉ ß Word", "a.b@c.de and a.b@c.de, 1.2.3.4 " + base, base + " 1.2.3.4 +1 (555) 010-9999", base, base + " more", "4111 1111 1111 1111 x " + w(5)]
    texts += ["naïve.text naïve..text Ünder_score plain. end." + w(3) + " a@b.cd", "1.2.3.4 naïve Ünder"] + [w(rng.randrange(1, 30)) + rng.choice(["", " a.b@c.de", " 256.1.1.1", " 001.2.3.4"]) for _ in range(60)]
    docs = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(1, 0, "user", "</s>[INST]"), (1, 1, "assistant", None), (1, 1, None, "\\x"), (2, 0, "assistant", "é"), (2, None, "assistant", "a"), (None, 0, "user", "x"), (1, 1, "assistant", None)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for name in queries.ORACLE_SQL:
        compare(spark, name, str(tmp_path))


def test_repeated_rows_and_shared_ids(spark, tmp_path):
    rows = [(1, "zebulon writes a.b@c.de daily"), (2, "ask zebulon at a.b@c.de now"), (2, "other words of 1.2.3.4 there"), (None, "zebulon 1.2.3.4 there"), (None, None)] + [(k, f"plain number {k} daily") for k in range(3, 40)]
    rows += rows[:3] * 4 + rows[6:9] * 3 + rows[3:5]
    docs = spark.createDataFrame([(k, t, None, None, 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    compare(spark, "op10_disclosure_sanitisation", str(tmp_path))
