"""Every registered query against its SQL, at the smallest scale."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def show(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 9) + 0.0)
    return v.isoformat() if hasattr(v, "isoformat") else repr(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    out = entry.queries()[name](spark, DATA)
    columns = sorted(out.columns)
    got = sorted(tuple(map(show, r)) for r in out.select(*[f"`{c}`" for c in columns]).collect())
    if name not in entry.oracle_sql():
        assert got
        return
    rel = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(show(r[i]) for i in at) for r in rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_the_optional_folders(tmp_path):
    """With the subpackage and its tests deleted, the frame queries are all there is."""
    root = Path(entry.__file__).parent
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e, tidemark.catalogue as c; assert e.queries() == c.QUERIES and e.oracle_sql() == c.ORACLE"
    for pipeline in (True, False):
        if not pipeline:
            (tmp_path / "repo/corpus_pipeline.py").unlink(missing_ok=True)
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, timeout=120)
