"""Quality, line dedup and decontamination against their SQL on the small tables."""

import duckdb
import pytest

from weft.llm import decontaminate, registry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_secret_scan", "op2_line_dedup", "op6_quality_rules", "op10_decontaminate"])
def test_against_sql(spark, name):
    import os
    import sys

    sys.path.insert(0, os.path.dirname(__file__))
    from conftest import same

    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = con.execute(registry.oracle_sql()[name])
    same(registry.queries()[name](spark, SMALL), ([c[0] for c in got.description], got.fetchall()))


def test_search_returns_all_segments_over_the_threshold():
    """Block-max search against scoring every passage with every segment."""
    import numpy as np

    rng = np.random.default_rng(5)
    items = [(k, " ".join(f"w{x}" for x in rng.zipf(1.4, 60) % 300)) for k in range(60)]
    index = decontaminate.ItemIndex(items)
    for trial in range(20):
        own = items[trial][1].split()
        words = own[: rng.integers(10, 60)] + [f"w{x}" for x in rng.zipf(1.4, 60) % 300]
        h, _ = decontaminate.hashed_words(decontaminate.pa.array([" ".join(words)]), lower=True)
        at = np.searchsorted(index.vocabulary, h)
        at = at[(at < len(index.vocabulary)) & (index.vocabulary[np.minimum(at, len(index.vocabulary) - 1)] == h)]
        got = {int(s) for _, s in zip(*index.search(np.zeros(len(at), np.int64), at), strict=True)}
        terms, score = set(at.tolist()), np.zeros(index.n)
        for t in terms:
            own_rows = slice(index.start[t], index.start[t + 1])
            score[index.doc[own_rows]] += index.weight[own_rows]
        assert got == set(np.flatnonzero(score >= index.needs - 1e-9).tolist())


def test_a_benchmark_of_several_blocks(spark, monkeypatch):
    """Twenty blocks, each index made and given up in turn: the rows of one block, whatever the size."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").union(spark.createDataFrame([(None, "no such words anywhere")], "item_id long, text string"))
    whole = sorted(map(tuple, decontaminate.find_leaks(docs, items).collect()))
    sizes, made = [], decontaminate.ItemIndex.__init__
    for blocks in (3, 20):
        monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", -(-items.count() // blocks))
        monkeypatch.setattr(decontaminate.ItemIndex, "__init__", lambda self, rows, stats=None: (sizes.append(len(rows)), made(self, rows, stats))[1])
        assert sorted(map(tuple, decontaminate.find_leaks(docs, items).collect())) == whole
    assert len(sizes) > 12 and sum(sizes[3:]) == items.distinct().count() and max(sizes[3:]) < items.count() / 3
    clean = decontaminate.decontaminate(docs, items)
    assert clean.columns == docs.columns and clean.count() == sum(not r[1] for r in whole)


def test_short_and_unnamed_items(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "x Two words y"), (2, "two y words"), (3, "a b c d e"), (4, "z a b c d e z"), (5, "yes"), (None, "two words")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "two words"), (2, "A b c d e"), (None, "yes"), (None, "yes"), (2, "A b c d e")], "item_id long, text string")
    want = {1: (True, 1, "1"), 2: (False, 0, ""), 3: (True, 1, "2"), 4: (True, 1, "2"), 5: (True, 1, ""), None: (True, 1, "1")}
    for most in (20_000, 1):
        monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", most)
        assert {r[0]: tuple(r[1:4]) for r in decontaminate.find_leaks(docs, items).collect()} == want
