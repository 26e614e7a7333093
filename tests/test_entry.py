from __future__ import annotations

import re
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["mode", "s", "energy", "cumulative", "residual"] and df.count() > 0


def test_every_statement_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_library_does_not_import_llm():
    for p in (ROOT / "modalis").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text()), p
