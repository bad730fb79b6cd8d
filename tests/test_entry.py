"""The driver's contract: queries that need no corpus operators agree with their SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from folioforge.plans import catalog

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return round(x, 6)
    return [plain(v) for v in x] if hasattr(x, "__iter__") and not isinstance(x, str) else x


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["type", "n", "hit_at_1", "hit_at_3", "hit_at_5", "mrr"] and df.count() >= 1


def test_names():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_corpus_operators(tmp_path):
    """A copy without the corpus operators still names and runs the other queries."""
    import os
    import shutil
    import subprocess
    import sys

    top = os.path.dirname(os.path.abspath(entry.__file__))
    copy = tmp_path / "copy"
    shutil.copytree(top, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'pipeline' not in q and set(o) <= set(q) and not any(n.startswith('op') for n in q) and len(q) > 70"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(copy)})
    assert done.returncode == 0, done.stderr


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf)
    want = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    a = sorted(repr([plain(r[c]) for c in order]) for r in got.collect())
    b = sorted(repr([plain(dict(zip(columns, r, strict=True))[c]) for c in order]) for r in want.fetchall())
    assert a == b
