"""Token-ID output in training order, as fixed-stride binary shards.

Texts are tokenised with a public byte-level BPE and joined end to end, an end mark after each, and
cut into sequences of LENGTH tokens. A keyed Feistel network over the next even power of two,
walked until it lands inside the range, permutes the sequence numbers: each sequence has a global
slot that can be computed forth and back without a table. Shard k holds slots k*PER_SHARD and up,
each at a fixed stride, so a reader reads on from any slot with one seek.

Tokens are written once to the shared folder, with their place inside the writing task; task
totals (one number a task) give every text its global offset. The pieces of a task that go to one
shard travel as one compressed row, and a shard, of bounded size, is put together in one task
and moved into place whole, so a task that runs again only writes the same bytes again.

Texts are joined in the order of the tasks that read them, so the order follows the layout of the input (its
files and how they are split), not the documents alone: the same files read alike give the same shards, a
repartitioned copy gives others with the same tokens. The layout of a run is part of its output: the
manifest has each task's first token, and the folder `tokens` has each text's task and place in it.

Defined results: a null or empty text is an end mark alone; rows that repeat are written as often
as they occur; the last sequence is filled up with end marks; an empty table writes no shard; only
doc_id and text are read.
"""

from __future__ import annotations

import base64
import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.session import shared_dir

from .common import mix64, raw, slices, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LENGTH, PER_SHARD = 1024, 16_384
KEY = 0x5EEDC0DE
ROUNDS = 4
FLUSH = 16 << 20
STEP = 1 << 17  # tokens copied at a time: index arrays take eight bytes a token, four times the tokens themselves
PACKED = 6  # compression level of tokens at rest and on the way


def load_ranks(path: str = TOKENIZER) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoding(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("weft", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Feistel:
    """Keyed permutation of 0..n-1."""

    def __init__(self, n: int, key: int = KEY) -> None:
        self.n, self.half = n, max(1, (max(1, n - 1).bit_length() + 1) // 2)
        self.keys = [np.uint64(int.from_bytes(zlib.crc32(f"{key}:{r}".encode()).to_bytes(4, "big") * 2, "big")) for r in range(ROUNDS)]

    def _round(self, x: np.ndarray, keys, back: bool) -> np.ndarray:
        half, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> half, x & mask
        for k in keys:
            if back:
                left, right = right ^ (mix64(left ^ k) & mask), left
            else:
                left, right = right, left ^ (mix64(right ^ k) & mask)
        return (left << half) | right

    def _walk(self, x, keys, back) -> np.ndarray:
        x = np.asarray(x, np.int64).astype(np.uint64)
        out = self._round(x, keys, back)
        while True:
            over = out >= np.uint64(self.n)
            if not over.any():
                return out.astype(np.int64)
            out[over] = self._round(out[over], keys, back)

    def slot(self, sequence) -> np.ndarray:
        return self._walk(sequence, self.keys, False)

    def sequence(self, slot) -> np.ndarray:
        return self._walk(slot, self.keys[::-1], True)


def _tokenise(ranks):
    def rows(batches):
        coder, end = encoding(ranks.value), len(ranks.value)
        part, before = TaskContext.get().partitionId(), 0
        kind, empty = np.uint16 if end < 1 << 16 else np.uint32, np.zeros(0, np.uint32)
        for batch in batches:
            for own in slices(batch, max_bytes=1 << 20):
                tokens = [np.append(coder.encode_to_numpy(t, disallowed_special=()) if t else empty, end).astype(kind) for t in own.column(1).to_pylist()]
                n = np.array([len(t) for t in tokens], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(before + np.cumsum(n) - n), pa.array(n),
                     pa.array([zlib.crc32(t.tobytes()) for t in tokens], pa.int64()), pa.array([t.tobytes() for t in tokens], pa.binary())],
                    names=["doc_id", "part", "before", "n_tokens", "token_crc", "tokens"])
                before += int(n.sum())

    return rows


def _steps(start: np.ndarray, sizes: np.ndarray):
    """Index arrays over the runs of tokens at `start`, in order, each with where its part begins and ends in all runs end to end: about STEP tokens at a time."""
    ends = np.cumsum(sizes)
    lo, done = 0, 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, done + STEP, "right")))
        upto = int(ends[hi - 1])
        first = start[lo:hi] - (ends[lo:hi] - sizes[lo:hi] - done)
        yield np.repeat(first, sizes[lo:hi]) + np.arange(upto - done), done, upto
        lo, done = hi, upto


def _pieces(offsets, order, length, per_shard, kind):
    """Pieces of the texts by shard: place of each token run in its shard, and the runs, compressed."""

    def payload(place, start, sizes, tokens):
        total = 8 + place.nbytes + sizes.nbytes + int(sizes.sum()) * tokens.itemsize
        into = zstandard.ZstdCompressor(level=PACKED).compressobj(size=total)
        out = [into.compress(x.tobytes()) for x in (np.array([len(place)], np.int64), place, sizes)]
        out += [into.compress(tokens[at].tobytes()) for at, _, _ in _steps(start, sizes)]
        return b"".join([*out, into.flush()])

    def pack(held):
        shard, place, sizes = (np.concatenate([h[k] for h in held]) for k in range(3))
        tokens = np.concatenate([h[3] for h in held])
        held.clear()
        by = np.argsort(shard, kind="stable")
        start = (np.cumsum(sizes) - sizes)[by]
        shard, place, sizes = shard[by], place[by], sizes[by]
        ids, cut = np.unique(shard, return_index=True)
        rows = [payload(place[u:v], start[u:v], sizes[u:v], tokens) for u, v in zip(cut, [*cut[1:], len(shard)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(rows, pa.binary())], names=["shard", "payload"])

    def rows(batches):
        known = offsets.value
        starts = np.zeros(max(known, default=0) + 1, np.int64)
        starts[list(known)] = list(known.values())
        held, bytes_held = [], 0
        for whole in batches:
            for batch in slices(whole, "tokens", FLUSH):
                data, ptr = raw(batch.column(2))
                tokens, ptr = data.view(kind), ptr // np.dtype(kind).itemsize
                n = np.diff(ptr)
                at = starts[batch.column(0).to_numpy()] + batch.column(1).to_numpy()
                first = at // length
                many = (at + n - 1) // length - first + 1
                text = np.repeat(np.arange(len(n)), many)
                sequence = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
                lo, hi = np.maximum(at[text], sequence * length), np.minimum(at[text] + n[text], (sequence + 1) * length)
                slot = order.slot(sequence)
                held.append((slot // per_shard, slot % per_shard * length + lo - sequence * length, hi - lo, tokens))  # runs lie end to end
                bytes_held += tokens.nbytes
                if bytes_held >= FLUSH:
                    yield pack(held)
                    held, bytes_held = [], 0
        if held:
            yield pack(held)

    return rows


def _shard(out, n_sequences, length, per_shard, end, kind):
    def write(keys, rows):
        shard = keys[0].as_py()
        count = min(per_shard, n_sequences - shard * per_shard)
        body = np.full(count * length, end, kind)
        filled = 0
        for payload in rows.column("payload"):
            flat = zstandard.decompress(payload.as_buffer())
            n = int(np.frombuffer(flat, np.int64, 1)[0])
            place, sizes = np.frombuffer(flat, np.int64, n, 8), np.frombuffer(flat, np.int64, n, 8 + 8 * n)
            run = np.frombuffer(flat, kind, offset=8 + 16 * n)
            for at, lo, hi in _steps(place, sizes):
                body[at] = run[lo:hi]
            filled += int(sizes.sum())
        store, path = pafs.FileSystem.from_uri(out)
        name = f"{path}/shard-{shard:06d}.bin"
        draft = f"{name}.{TaskContext.get().taskAttemptId()}"
        with store.open_output_stream(draft) as f:
            f.write(pa.py_buffer(body))
        store.move(draft, name)
        return pa.table({"shard": [shard], "sequences": [count], "tokens": [filled], "crc": [zlib.crc32(body)]})

    return write


def materialise_tokens(docs: DataFrame, out: str | None = None, tokenizer: str = TOKENIZER, length: int = LENGTH,
                       per_shard: int = PER_SHARD, key: int = KEY) -> tuple[DataFrame, DataFrame, dict]:
    """Write the shards and their manifest under `out` (by default a new folder in the shared one).

    Returns one row a document (doc_id, n_tokens, first_token, n_sequences, first_slot, token_crc), one
    row a shard, and the manifest.
    """
    from uuid import uuid4

    spark = docs.sparkSession
    out = out or f"{shared_dir(spark)}/weft-tokens-{uuid4().hex}"
    ranks = load_ranks(tokenizer)
    end, kind = len(ranks), np.uint16 if len(ranks) < 1 << 16 else np.uint32
    schema = "doc_id long, part int, before long, n_tokens long, token_crc long, tokens binary"
    path = f"{out}/tokens"
    docs.select("doc_id", "text").mapInArrow(_tokenise(spark.sparkContext.broadcast(ranks)), schema).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", PACKED).parquet(path)
    tokens = spark.read.schema(schema).parquet(path)
    totals = sorted((r["part"], r["n"]) for r in tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # one row a task
    starts, total = {}, 0
    for part, n in totals:
        starts[part] = total
        total += n
    n_sequences = -(-total // length)
    manifest = {"length": length, "per_shard": per_shard, "n_sequences": n_sequences, "n_tokens": total, "end": end,
                "dtype": np.dtype(kind).name, "key": key, "shards": -(-n_sequences // per_shard), "task_starts": sorted(starts.items())}
    store, base = pafs.FileSystem.from_uri(out)
    store.create_dir(f"{base}/shards")
    order = Feistel(max(1, n_sequences), key)
    offsets = spark.sparkContext.broadcast(starts)
    shards = tokens.select("part", "before", "tokens").mapInArrow(_pieces(offsets, order, length, per_shard, kind), "shard long, payload binary") \
        .groupBy("shard").applyInArrow(_shard(f"{out}/shards", n_sequences, length, per_shard, end, kind), "shard long, sequences long, tokens long, crc long")
    shards.write.parquet(f"{out}/index")
    with store.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    manifest["path"] = out

    def place(batches):
        for batch in batches:
            first = np.array([offsets.value[p] for p in batch.column(1).to_pylist()], np.int64) + batch.column(2).to_numpy()
            n = batch.column(3).to_numpy()
            sequence = first // length
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), pa.array(first), pa.array((first + n - 1) // length - sequence + 1), pa.array(order.slot(sequence)), batch.column(4)],
                names=["doc_id", "n_tokens", "first_token", "n_sequences", "first_slot", "token_crc"])

    rows = tokens.select("doc_id", "part", "before", "n_tokens", "token_crc").mapInArrow(
        place, "doc_id long, n_tokens long, first_token long, n_sequences long, first_slot long, token_crc long")
    return rows, spark.read.parquet(f"{out}/index"), manifest


class Reader:
    """Sequential, resumable reads of the shards: iterate from any slot."""

    def __init__(self, path: str) -> None:
        self.store, self.base = pafs.FileSystem.from_uri(path)
        with self.store.open_input_stream(f"{self.base}/manifest.json") as f:
            self.manifest = json.loads(f.read())
        self.order = Feistel(max(1, self.manifest["n_sequences"]), self.manifest["key"])

    def read(self, slot: int, count: int = 1) -> np.ndarray:
        m, rows = self.manifest, []
        kind = np.dtype(m["dtype"])
        while count and slot < m["n_sequences"]:
            shard, at = divmod(slot, m["per_shard"])
            n = min(count, m["per_shard"] - at, m["n_sequences"] - slot)
            with self.store.open_input_file(f"{self.base}/shards/shard-{shard:06d}.bin") as f:
                stride = m["length"] * kind.itemsize
                rows.append(np.frombuffer(f.read_at(n * stride, at * stride), kind).reshape(n, m["length"]))
            slot, count = slot + n, count - n
        return np.concatenate(rows) if rows else np.zeros((0, m["length"]), kind)


def op5(spark, sf_dir) -> DataFrame:
    return materialise_tokens(table(spark, sf_dir, "documents", "doc_id", "text"))[0]
