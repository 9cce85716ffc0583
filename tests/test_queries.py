"""Every registered query of the engine against its SQL, at the smallest size; and the entry module without its optional parts."""

from __future__ import annotations

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from batchloom.plans import queries as plans

ROOT = Path(__file__).resolve().parent.parent


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(value)
    return f"{float(value):.6g}" if isinstance(value, float) else str(value)


@pytest.fixture(scope="session")
def duck(tables):
    con = duckdb.connect()
    for f in Path(tables).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, tables, duck, name):
    df = plans.queries()[name](spark, tables)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(columns).collect())
    if name not in plans.oracle_sql():
        assert got
        return
    cur = duck.execute(plans.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    order = [names.index(c) for c in columns]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[i]) for i in order) for r in cur.fetchall())
    assert got == want


def test_entry_without_the_optional_parts(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pack_parts' in q and not any(n.startswith('op') and n[2].isdigit() for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env=os.environ | {"PYTHONPATH": ""})
