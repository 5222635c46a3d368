"""Line dedup: winnowing over line hashes, extension of matches, and deletion of later repeated runs.

Lines without a word are skipped over. Windows are the shortest runs of consecutive lines with at
least MIN_WORDS words that start, or end, at a line. Of every window the line with the smallest
hash (the last of equals) is selected: two copies of a window select the same line, so every
repeated run of MIN_WORDS words or more holds a selected line at the same place in both copies. Only the
selected lines, the fingerprints, are shuffled, and neighbouring windows mostly share theirs. Positions
with equal fingerprints are joined by counting them; a fingerprint at one position ends there. At
the others the match is extended both ways, line by line, to the windows that chose the fingerprint: a
128-bit digest of their lines' 128-bit hashes is held against the earliest place that has it, so no
pairs of places are listed, however common a line is. Windows that overlap join up to the whole
repeated stretch: the window that starts with it reaches inwards from its first line, the one that ends
with it from its last. So exactly the lines of runs, of any length from MIN_WORDS words on, whose content
occurs earlier by (doc_id, text, line) are deleted.

Defined results: a null or empty text has no lines to delete; a null doc_id comes last in order,
texts of one doc_id by their MD5; rows that agree in doc_id and text count as one document and get
the same result; a run that overlaps its own repetition loses the lines of the later one; only
doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, join_hot, mix64, raw, save, slices, table, word_bounds

MIN_WORDS = 30
_NL = 10
_ENTRY = np.dtype([("lo", "<i8"), ("hi", "<i8"), ("digest", "S16")])


def windows(data: np.ndarray, words: int = MIN_WORDS):
    """Windows of one text: (first line, last line, selected line, its hash, digests of two uint64), lines counted from 0."""
    ends = np.append(np.flatnonzero(data == _NL), len(data))
    at, to, _ = word_bounds(data, np.array([0, len(data)]))
    line = np.searchsorted(ends, at, side="right")
    lines, first, count = np.unique(line, return_index=True, return_counts=True)
    if not len(lines):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64), np.zeros((0, 2), np.uint64)
    view = memoryview(data)
    hashes = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(at[first].tolist(), to[first + count - 1].tolist(), strict=True)]),
                           np.uint64).reshape(-1, 2)  # of each line from its first word to its last
    upto = np.cumsum(count)
    last = np.searchsorted(upto, upto - count + words)
    start = np.searchsorted(upto - count, upto - words, side="right") - 1  # of the window that ends at the line
    own, end = np.flatnonzero(last < len(lines)), np.flatnonzero(start >= 0)
    pairs = np.unique(np.concatenate((own * len(lines) + last[own], start[end] * len(lines) + end)))
    own, last = np.divmod(pairs, len(lines))
    digest, pick, place = np.zeros((len(own), 2), np.uint64), np.full(len(own), np.iinfo(np.uint64).max), own.copy()
    step = 0
    while True:  # as often as the longest window has lines, at most MIN_WORDS times
        live = own + step <= last
        if not live.any():
            break
        h = hashes[np.minimum(own + step, len(lines) - 1)]
        digest = np.where(live[:, None], mix64(digest * np.uint64(3) + h), digest)
        better = live & (h[:, 0] <= pick)
        pick, place = np.where(better, h[:, 0], pick), np.where(better, own + step, place)
        step += 1
    return lines[own], lines[last], lines[place], pick, digest


def _fingerprints(batches):
    """One row a selected line: doc_id, text digest, fingerprint, and the windows that chose it."""
    for batch in batches:
        for part in slices(batch):
            data, ptr = raw(part.column(1))
            rows, prints, packed = [], [], []
            for k, (a, b) in enumerate(zip(ptr[:-1], ptr[1:], strict=True)):
                lo, hi, place, pick, digest = windows(data[a:b])
                if not len(lo):
                    continue
                order = np.argsort(place, kind="stable")
                entries = np.empty(len(lo), _ENTRY)
                entries["lo"], entries["hi"], entries["digest"] = lo[order], hi[order], np.ascontiguousarray(digest[order]).view("S16")[:, 0]
                cut = np.flatnonzero(np.diff(place[order], prepend=-1))
                body, size = entries.tobytes(), _ENTRY.itemsize
                rows += [k] * len(cut)
                prints.append(pick[order][cut])
                packed += [body[u * size : v * size] for u, v in zip(cut, [*cut[1:], len(lo)], strict=True)]
            at = pa.array(rows, pa.int64())
            found = np.concatenate(prints) if prints else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(at), part.column(2).take(at), pa.array(found.view(np.int64)), pa.array(packed, pa.binary())],
                names=["doc_id", "md5", "fingerprint", "windows"])


def _extended(batches):
    """One row a window of a shared fingerprint: doc_id, md5, lo, hi, digest."""
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            part = batch.slice(at, 8192)
            packed = part.column(2).to_pylist()
            rows = pa.array(np.repeat(np.arange(part.num_rows), [len(p) // _ENTRY.itemsize for p in packed]))
            entries = np.frombuffer(b"".join(packed), _ENTRY)
            digests = pa.Array.from_buffers(pa.binary(16), len(entries), [None, pa.py_buffer(np.ascontiguousarray(entries["digest"]))])
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(rows), part.column(1).take(rows), pa.array(entries["lo"]), pa.array(entries["hi"]), digests.cast(pa.binary())],
                names=["doc_id", "md5", "lo", "hi", "digest"])


def _text_key() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def repeats(docs: DataFrame) -> DataFrame:
    """Later runs, one row a document that has some: _weft_id, _weft_md5, ranges as an array of (lo, hi)."""
    keyed = docs.select("doc_id", "text", _text_key().alias("md5"))
    found = save(keyed.mapInArrow(_fingerprints, "doc_id long, md5 binary, fingerprint long, windows binary"), "fingerprints")
    shared = save(found.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    matched = join_hot(found, shared, "fingerprint").select("doc_id", "md5", "windows")
    places = save(matched.mapInArrow(_extended, "doc_id long, md5 binary, lo long, hi long, digest binary"), "places")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "md5", "lo")
    drop(found, shared)
    first = save(places.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "first")
    later = join_hot(places, first, "digest").where(place != F.col("first"))
    return later.groupBy(F.col("doc_id").alias("_weft_id"), F.col("md5").alias("_weft_md5")).agg(
        F.collect_set(F.struct("lo", "hi")).alias("ranges"))  # at most two a line of the text


def _cut(batches):
    for batch in batches:
        for part in slices(batch):
            texts, ranges, out = part.column(1).to_pylist(), part.column(2).to_pylist(), []
            for text, own in zip(texts, ranges, strict=True):
                if text is None or not own:
                    out.append((text, 0, 0))
                    continue
                lines = text.split("\n")
                drop = np.zeros(len(lines) + 1, np.int64)
                for r in own:
                    drop[r["lo"]] += 1
                    drop[r["hi"] + 1] -= 1
                gone = np.cumsum(drop)[:-1] > 0
                full = [g and bool(line.encode().split()) for g, line in zip(gone, lines, strict=True)]
                out.append(("\n".join(line for g, line in zip(full, lines, strict=True) if not g), sum(full),
                            sum(len(line.encode().split()) for g, line in zip(full, lines, strict=True) if g)))
            text, n, words = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.string()), pa.array(n, pa.int64()), pa.array(words, pa.int64())],
                                             names=["doc_id", "text", "n_removed", "words_removed"])


def line_dedup(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, text without the later runs, lines and words removed."""
    docs = docs.select("doc_id", "text")
    found = repeats(docs)
    same = F.col("doc_id").eqNullSafe(F.col("_weft_id")) & (F.col("_weft_key") == F.col("_weft_md5"))
    marked = docs.withColumn("_weft_key", _text_key()).join(found, same, "left")
    return marked.select("doc_id", "text", "ranges").mapInArrow(_cut, "doc_id long, text string, n_removed long, words_removed long")


def op2(spark, sf_dir) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "n_removed", "words_removed", F.length("text").cast("long").alias("chars_left"), F.sha2("text", 256).alias("text_sha256"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, text, md5(coalesce(text, '')) AS h, count(*) AS copies FROM documents GROUP BY doc_id, text),
l AS (SELECT rn, doc_id, h, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
w AS (SELECT rn, doc_id, h, i, trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x,
        len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS n FROM l WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
c AS (SELECT *, row_number() OVER o AS k, sum(n) OVER o AS upto FROM w WINDOW o AS (PARTITION BY rn ORDER BY i)),
e AS (SELECT a.rn, a.k AS k0, min(b.k) AS k1 FROM c a JOIN c b ON a.rn = b.rn AND b.k >= a.k AND b.upto >= a.upto - a.n + {MIN_WORDS} GROUP BY a.rn, a.k
      UNION SELECT b.rn, max(a.k), b.k FROM c a JOIN c b ON a.rn = b.rn AND b.k >= a.k AND b.upto >= a.upto - a.n + {MIN_WORDS} GROUP BY b.rn, b.k),
r AS (SELECT b.rn, b.doc_id, b.h, min(b.i) AS lo, max(b.i) AS hi, string_agg(b.x, chr(10) ORDER BY b.k) AS run
      FROM e JOIN c b ON b.rn = e.rn AND b.k BETWEEN e.k0 AND e.k1 GROUP BY b.rn, b.doc_id, b.h, e.k0, e.k1),
p AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id NULLS LAST, h, lo) AS nth FROM r),
g AS (SELECT DISTINCT c.rn, c.i FROM p JOIN c ON c.rn = p.rn AND c.i BETWEEN p.lo AND p.hi WHERE nth > 1),
k AS (SELECT l.rn, string_agg(l.x, chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS t, count(g.i) AS n_removed,
        coalesce(sum(len(regexp_extract_all(l.x, '[^\\x20\\x09-\\x0D]+'))) FILTER (g.i IS NOT NULL), 0) AS words_removed
      FROM l LEFT JOIN g USING (rn, i) GROUP BY l.rn)
SELECT d.doc_id, coalesce(n_removed, 0) AS n_removed, CAST(coalesce(words_removed, 0) AS BIGINT) AS words_removed,
  CASE WHEN d.text IS NOT NULL THEN length(coalesce(t, '')) END AS chars_left,
  CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(t, '')) END AS text_sha256
FROM (SELECT *, unnest(range(copies)) AS copy FROM d) d LEFT JOIN k USING (rn)
"""
