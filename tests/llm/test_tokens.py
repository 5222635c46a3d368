"""Token shards: round trip, permutation, resumable reads, order-free repeats."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from weft.llm import tokenbin as tb

DOCS = "doc_id long, text string, source string, lang string"


def _docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 4097])
def test_feistel_is_a_permutation(n):
    f = tb.Feistel(n)
    slots = f.slot(np.arange(n))
    assert sorted(slots) == list(range(n))
    assert (f.sequence(slots) == np.arange(n)).all()


def test_round_trip_with_nulls_repeats_and_long_texts(spark, tmp_path):
    rows = [(k, f"word{k} " * (k % 40) + "é ü 漢字", "a", "en") for k in range(300)]
    rows += [(None, "no id", None, None), (7, None, "a", "en"), (8, "", "a", "en"), (9, "long " * 40_000, "b", "en"), (5, "same", "a", "en"), (5, "same", "a", "en")]
    out = f"file://{tmp_path}/shards"
    place, index, manifest = tb.materialise_tokens(_docs(spark, rows), out, length=64, per_shard=128)
    coder = tb.encoding(tb.load_ranks())
    got = place.collect()
    assert len(got) == len(rows)
    assert sum(r["n_tokens"] for r in got) == manifest["n_tokens"]
    reader = tb.Reader(out)
    whole = reader.read(0, manifest["n_sequences"])
    assert whole.shape == (manifest["n_sequences"], 64)
    flat = whole[reader.order.slot(np.arange(manifest["n_sequences"]))].reshape(-1)[: manifest["n_tokens"]]
    want = {}
    for doc_id, text, *_ in rows:
        want.setdefault(doc_id, []).append([*coder.encode_ordinary(text or ""), manifest["end"]])
    for r in got:
        own = flat[r["first_token"] : r["first_token"] + r["n_tokens"]].tolist()
        want[r["doc_id"]].remove(own)
        assert r["first_slot"] == reader.order.slot([r["first_token"] // 64])[0]
    assert not any(want.values())
    assert (reader.read(100, 77) == whole[100:177]).all()  # from any slot
    assert sum(r["sequences"] for r in index.collect()) == manifest["n_sequences"]


def test_empty_table_writes_no_shard(spark, tmp_path):
    place, index, manifest = tb.materialise_tokens(_docs(spark, []), f"file://{tmp_path}/none")
    assert place.count() == 0 and index.count() == 0 and manifest["n_sequences"] == 0


def test_clashing_columns_are_ignored(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b", 5, b"x")], "doc_id long, text string, part int, tokens binary")
    assert tb.materialise_tokens(df, f"file://{tmp_path}/c")[0].count() == 1


def test_tokens_are_moved_in_steps_of_bounded_memory(tmp_path, monkeypatch):
    """A full flush and a shard made of it take a few times the tokens' bytes, not the 64-bit indices of all of them; every token arrives."""
    rng = np.random.default_rng(1)
    n = np.append(rng.integers(1, 400, 35_000), 50_000)  # 14 MB: one flush
    first = np.cumsum(n) - n
    texts = [rng.integers(0, 50_000, k).astype(np.uint16) for k in n]
    n_sequences = -(-int(n.sum()) // 1024)
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), pa.array(first), pa.array([t.tobytes() for t in texts], pa.binary())], names=["part", "before", "tokens"])
    order, offsets = tb.Feistel(n_sequences), type("Offsets", (), {"value": {0: 0}})
    monkeypatch.setattr(tb.TaskContext, "get", lambda: type("Task", (), {"taskAttemptId": lambda self: 1})())

    def peak(work):
        tracemalloc.start()
        out = work()
        most = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        return out, most

    pieces, most = peak(lambda: list(tb._pieces(offsets, order, 1024, 16_384, np.uint16)([batch])))
    assert most < 90
    rows = pa.table({"payload": pa.array([p for piece in pieces for p in piece.column(1).to_pylist()], pa.binary())})
    shard, most = peak(lambda: tb._shard(f"file://{tmp_path}", n_sequences, 1024, 16_384, 50_000, np.uint16)((pa.scalar(0),), rows))
    assert most < 90
    assert shard.column("tokens").to_pylist() == [int(n.sum())]
    body = np.fromfile(f"{tmp_path}/shard-000000.bin", np.uint16).reshape(-1, 1024)
    assert (body[order.slot(np.arange(n_sequences))].reshape(-1)[: n.sum()] == np.concatenate(texts)).all()
