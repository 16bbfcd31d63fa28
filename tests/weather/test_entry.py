"""What the driver calls."""

from __future__ import annotations

import re
from pathlib import Path

import __spark_entry__

ROOT = Path(__spark_entry__.__file__).parent


def test_entry_and_registrations(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["qid", "lon", "lat", "year", "month", "index_name", "value"] and df.count() > 0
    names, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(names) and len(names) > 110


def test_nothing_outside_imports_the_corpus_jobs():
    for path in (ROOT / "fieldweave").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", path.read_text(), re.M), path
