"""Every operator and every stage on odd rows and on empty tables; against its SQL where there is one."""

import os
import sys

import pytest

from weft.llm import registry

sys.path.insert(0, os.path.dirname(__file__))
from conftest import same  # noqa: E402

QUERIES, SQL = registry.queries(), registry.oracle_sql()
ROWS = 18


@pytest.mark.parametrize("name", QUERIES)
def test_one_row_a_document(spark, odd_docs, duck, name):
    frame = QUERIES[name](spark, odd_docs).cache()
    assert frame.count() == ROWS
    if name in SQL:
        same(frame, duck(SQL[name], odd_docs))


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, no_docs, name):
    assert QUERIES[name](spark, no_docs).count() == 0


def test_stages_keep_their_columns(spark, odd_docs, no_docs):
    import corpus_pipeline as cp

    for path in (odd_docs, no_docs):
        docs = spark.read.parquet(f"{path}/documents.parquet")
        names = docs.columns
        for k, (_, stage) in enumerate(cp.STAGES):
            docs = stage(spark, docs, path)
            if k < len(cp.STAGES) - 1:
                assert docs.columns == names
                docs = docs.cache()
        assert docs.count() >= 0


@pytest.mark.parametrize("k", range(5))
def test_each_stage_on_odd_rows(spark, odd_docs, k):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{odd_docs}/documents.parquet")
    assert cp.STAGES[k][1](spark, docs, odd_docs).count() > 0


def test_no_local_checkpoints():
    import pathlib

    for f in pathlib.Path(registry.__file__).parent.glob("*.py"):
        assert "localCheckpoint(" not in f.read_text()
