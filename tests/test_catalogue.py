"""Every registered query of the graph engine on the smallest tables; against DuckDB where it has SQL."""

import duckdb
import pytest

from weft.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def neat(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, DIR)
    ours = frame.collect()
    if name not in SQL:
        assert ours
        return
    got = duck.execute(SQL[name])
    names = sorted(c[0] for c in got.description)
    where = {c[0]: k for k, c in enumerate(got.description)}
    assert sorted(frame.columns) == names
    theirs = sorted((tuple(neat(r[where[n]]) for n in names) for r in got.fetchall()), key=repr)
    assert sorted((tuple(neat(r[n]) for n in names) for r in ours), key=repr) == theirs


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries()) and all(isinstance(s, str) for s in e.oracle_sql().values())


def test_entry_without_the_corpus_operators(tmp_path):
    """The engine stands without the corpus operators and their pipeline."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).resolve().parent.parent
    shutil.copytree(root / "weft", tmp_path / "weft", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import re, __spark_entry__ as e; q = e.queries(); assert q and not any(re.match(r'op[0-9]+_|pipeline$', n) for n in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_outside_uses_the_corpus_operators():
    import pathlib

    for f in (pathlib.Path(__file__).resolve().parent.parent / "weft").rglob("*.py"):
        if "llm" not in f.parts:
            assert "weft.llm" not in f.read_text() and "from .llm" not in f.read_text(), f
