"""The driver's contract, and that the engine does without the corpus operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark, data):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["item", "doc", "shared", "containment"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["match_forward", "kmer_packed", "record_locate", "paf_overlay_counts", "parse_bp"])
def test_queries_like_their_sql(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    from kmerloom import queries

    con = duckdb.connect()
    for table in ("documents", "benchmark", "lineitem", "events", "part"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    columns = sorted(want.columns)
    got = queries.QUERIES[name](spark, data)
    assert sorted(got.columns) == columns
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key) == sorted(con.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall(), key=key)


def test_without_corpus_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and 'pipeline' not in q and not any(x.startswith('op') for x in q); print('fine')"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)}, timeout=120)
    assert out.stdout.strip() == "fine", out.stderr


@pytest.mark.parametrize("hidden", ["regex", "public_tokenizers", "kmerloom.llm"])
def test_where_corpus_operators_cannot_be_imported(hidden):
    code = f"import sys; sys.modules[{hidden!r}] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and 'pipeline' not in q and not any(x.startswith('op') for x in q) and set(e.oracle_sql()) <= set(q); print('fine')"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(ROOT)}, timeout=120)
    assert out.stdout.strip() == "fine", out.stderr


def test_nothing_else_imports_corpus_operators():
    for path in (ROOT / "kmerloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "kmerloom.llm" not in path.read_text(), path
