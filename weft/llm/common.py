"""What the corpus operators share: table access, row identity and vectorised word hashing."""

from __future__ import annotations

import atexit
import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WS = "[\\x20\\x09-\\x0D]"  # the six ASCII white-space bytes that part words
WORD = "[^\\x20\\x09-\\x0D]+"

NONSPACE = np.ones(256, dtype=bool)
NONSPACE[[9, 10, 11, 12, 13, 32]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_pow = np.ones(1, dtype=np.uint64)
_inv = np.ones(1, dtype=np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def row_key() -> Column:
    """64-bit identity of a document row. Rows that agree in doc_id and text share it, and so share their result."""
    return F.xxhash64(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")))


def crc_mod(modulus: int) -> Column:
    """crc32 of doc_id written as text, modulo; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (uint64 in, uint64 out)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about max_bytes of text (one row at least): arrays made of a part stay small."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // max_bytes
    cuts = np.flatnonzero(np.diff(part)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(lo, hi - lo)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, nulls as empty; offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of each text's first word (one entry more than texts)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = NONSPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of byte spans of data."""
    global _pow, _inv
    n = len(data)
    if len(_pow) <= n:
        size = max(n + 1, 1 << 16)
        steps = np.full(size, _BASE, np.uint64)
        steps[0] = 1
        _pow = np.cumprod(steps, dtype=np.uint64)
        steps[1:] = _INVERSE
        _inv = np.cumprod(steps, dtype=np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _pow[:n], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * _inv[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hashed_words(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and where each text's words begin."""
    data, offsets = raw(column)
    if lower:
        data = LOWER[data]
    starts, ends, ptr = word_bounds(data, offsets)
    return span_hashes(data, starts, ends), ptr


def shingles(words: np.ndarray, ptr: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every n-word window inside each text; a text of 1 to n-1 words has one window, all its words."""
    counts = np.diff(ptr)
    windows = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out_ptr = np.concatenate(([0], np.cumsum(windows)))
    doc = np.repeat(np.arange(len(counts)), windows)
    at = np.arange(out_ptr[-1]) - out_ptr[doc] + ptr[doc]
    padded = np.concatenate((words, np.zeros(n, np.uint64)))
    end = ptr[doc + 1]
    h = np.zeros(len(at), np.uint64)
    for j in range(n):
        h = mix64(h * np.uint64(3) + np.where(at + j < end, padded[at + j], np.uint64(j + 1)))
    return h, out_ptr


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def save(df: DataFrame, name: str, *by: str, row_group: int | None = None) -> DataFrame:
    """Write a table to the shared folder, parted by columns if any, and read it back: cuts lineage, survives lost executors, keeps columns apart.

    The table goes when `drop` is called on it, or else when the driver's process ends.
    """
    from uuid import uuid4

    from weft.session import shared_dir

    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weft-{name}-{uuid4().hex}"
    writer = df.write.partitionBy(*by) if by else df.write
    (writer.option("parquet.block.size", row_group) if row_group else writer).parquet(path)
    if not _saved:
        atexit.register(_clear)
    _saved[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


_saved: dict[str, SparkSession] = {}


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sparkContext().hadoopConfiguration()).delete(where, True)


def drop(*tables: DataFrame) -> None:
    """Delete saved tables that no later table is made of any more."""
    for table_ in tables:
        path = getattr(table_, "_weft_path", None)
        if path in _saved:
            _remove(_saved.pop(path), path)


def _clear() -> None:
    for path, spark in _saved.items():
        with contextlib.suppress(Exception):  # the JVM may be gone already
            _remove(spark, path)


HOT_ROWS, HOT_KEYS = 2_000, 1_024


def hot_rows(right: DataFrame, key: str, n: str = "n") -> DataFrame:
    """The keys that the most rows have, HOT_KEYS at most, each with more than HOT_ROWS: small enough to broadcast."""
    return save(right.where(F.col(n) > HOT_ROWS).orderBy(F.desc(n), key).limit(HOT_KEYS).select(key), "hot")


def join_hot(left: DataFrame, right: DataFrame, key: str, n: str = "n", hot: DataFrame | None = None) -> DataFrame:
    """Inner join on a key that is unique in `right`, a saved table whose column n says how many rows of `left` have it.

    Rows with one of the commonest keys stay where they are and meet a broadcast of those keys' rows; the others
    are shuffled, and no key among them has more than one in HOT_KEYS of all rows, or HOT_ROWS.
    """
    hot = hot_rows(right, key, n) if hot is None else hot
    if hot.isEmpty():
        return left.join(right, key)
    few = F.broadcast(hot)
    rest = left.join(few, key, "left_anti").join(right.join(few, key, "left_anti"), key)
    return left.join(F.broadcast(right.join(few, key)), key).unionByName(rest)
