"""Registered queries of the library against their SQL."""

from __future__ import annotations

import datetime
import decimal
import os
import pathlib
import shutil
import subprocess
import sys

import duckdb
import pytest
from conftest import SF_DIR

import __spark_entry__ as entry
from quirework.plans import load_queries

NAMES = sorted(n for n, q in load_queries().items() if q.sql)


def _plain(v):
    if isinstance(v, (float, decimal.Decimal)) and not isinstance(v, bool):
        return round(float(v), 6)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return v


def _sorted(rows):
    return sorted((tuple(map(_plain, r)) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    cols = sorted(df.columns)
    got = _sorted(df.select(*[f"`{c}`" for c in cols]).collect())
    cur = duck.execute(entry.oracle_sql()[name])
    at = {c[0]: i for i, c in enumerate(cur.description)}
    assert sorted(at) == cols
    assert got == _sorted([r[at[c]] for c in cols] for r in cur.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_registry_without_the_training_data_package(tmp_path):
    """A copy without that package keeps every other query, whether or not the pipeline's module is still there."""
    root = pathlib.Path(entry.__file__).parent
    for name, keep in (("both", True), ("neither", False)):
        copy = tmp_path / name
        shutil.copytree(root / "quirework", copy / "quirework", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        for file in ("__spark_entry__.py", *(["corpus_pipeline.py"] if keep else [])):
            if (root / file).exists():
                shutil.copy(root / file, copy)
        code = "import __spark_entry__ as e; print(*sorted(e.queries()))"
        out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": str(copy)})
        assert out.stdout.split() == sorted(load_queries())
