"""MinHash near-duplicates: BagMinHash signatures of 5-word shingle multisets, banded, then verified.

Exact copies fall together by the MD5 of their text, so each different text is signed, banded and
compared once. A text's shingles with their counts form a weighted set. For each shingle, Poisson
processes over dyadic weight intervals [0,1), [1,2), [2,4), ... give points in time, thinned where
the weight ends inside an interval; a point falls on one of 240 registers, which keeps its earliest
time. Two texts agree in a register with probability equal to their weighted Jaccard similarity.

40 bands of 6 registers miss a pair of similarity 0.8 once in 200,000. Inside a bucket:
1. every text is compared with at most STARS of the smallest members of its buckets (a star, no
   pairs of all), links are verified on the texts, and components are joined up;
2. a bucket that then still holds several components has its members compared across
   components in pairs of blocks of 512 members: first 240-byte sketches, then, for what may
   reach 0.8, the shingles themselves, which travel with the members. Each pair of blocks hands on
   only the links that join something up. So no bucket is capped and none is ever expanded into
   rows of pairs.
Verified means: sum of minima over sum of maxima of the shingle counts is at least 0.8.

Defined results: a text of one to four words is one shingle; a null text or one without words is
a duplicate of nothing and a class of its own; a class is named by its smallest doc_id (null if
none has one); rows that repeat are members of the same class; of rows equal in doc_id and text the one kept is
chosen by a digest of all its columns; only doc_id and text are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, drop, hashed_words, join_hot, mix64, save, shingles, slices, table
from .graph import components

BANDS, ROWS = 40, 6
M = BANDS * ROWS
SIMILAR = 0.8
SKETCH_SIMILAR = 0.68  # 4.6 standard deviations under 0.8 with M registers
STARS = 4
BLOCK = 512
BROADCAST_ROWS = 200_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def weighted(grams: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) of every different shingle of every text."""
    doc = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    at = np.flatnonzero(new)
    return doc[at], grams[at], np.diff(np.append(at, len(doc)))


def signatures(doc: np.ndarray, gram: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """n x M earliest times, as float64; rows of texts without shingles stay infinite."""
    times = np.full(n * M, np.inf)
    total = np.bincount(doc, weight, minlength=n)
    parts, level = [], 0
    while True:  # dyadic weight intervals
        low, rate = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
        has = weight > low
        if not has.any():
            break
        parts.append((doc[has], mix64(gram[has] + np.uint64(level * int(_STEP) & 0xFFFFFFFFFFFFFFFF)), np.full(has.sum(), float(rate)),
                      np.minimum(1.0, (weight[has] - low) / rate)))
        level += 1
    item_doc, seed, rate, share = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4
    horizon = M * (math.log(M) + 3) / np.maximum(total, 1)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        mine = np.isin(item_doc, todo)
        _points(times, item_doc[mine], seed[mine], rate[mine], share[mine], horizon)
        left = np.isinf(times.reshape(n, M)[todo]).any(axis=1)
        todo = todo[left]
        horizon[todo] *= 2
        times.reshape(n, M)[todo] = np.inf
    return times.reshape(n, M)


def _points(times, doc, seed, rate, share, horizon) -> None:
    """Enter every point up to its text's horizon."""
    now, first = np.zeros(len(doc)), 0
    while len(doc):
        k = int(min(256, max(1, 60_000 // len(doc))))
        steps = np.arange(first + 1, first + k + 1, dtype=np.uint64) * _STEP
        bits = mix64(seed[:, None] + steps)
        gaps = -np.log1p(-(bits >> np.uint64(11)).astype(np.float64) * 2.0**-53) / rate[:, None]
        at = now[:, None] + np.cumsum(gaps, axis=1)
        inside = at <= horizon[doc][:, None]
        spot = mix64(bits ^ np.uint64(0xA5A5A5A5DEADBEEF))
        inside_now = inside & ((spot & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 < share[:, None])
        register = ((spot >> np.uint64(32)) * np.uint64(M)) >> np.uint64(32)
        row, col = np.nonzero(inside_now)
        np.minimum.at(times, doc[row] * M + register[row, col].astype(np.int64), at[row, col])
        alive = inside[:, -1]
        doc, seed, rate, share, now = doc[alive], seed[alive], rate[alive], share[alive], at[alive, -1]
        first += k


def _sign(batches):
    for batch in batches:
        for part in slices(batch, max_bytes=1 << 20):
            words, ptr = hashed_words(part.column(1))
            grams, gptr = shingles(words, ptr)
            times = signatures(*weighted(grams, gptr), part.num_rows)
            bits = mix64(times.view(np.uint64))
            key = np.zeros((part.num_rows, BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for j in range(ROWS):
                key = mix64(key * np.uint64(5) + bits.reshape(-1, BANDS, ROWS)[:, :, j])
            full = np.diff(gptr) > 0
            bands = pa.array([row.tobytes() if ok else None for row, ok in zip(key, full, strict=True)], pa.binary())
            sketch = pa.array([row.tobytes() if ok else None for row, ok in zip((bits & np.uint64(255)).astype(np.uint8), full, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), bands, sketch], names=["doc_id", "node", "bands", "sketch"])


def _spread(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            keys = np.frombuffer(b"".join(part.column(1).to_pylist()), np.int64)
            rows = np.repeat(np.arange(part.num_rows), BANDS)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(keys)], names=["node", "key"])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two shingle lists."""
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    common = int(np.minimum(nx[i], ny[j]).sum())
    return common / max(1, len(a) + len(b) - common)


def _verify(batches):
    last = None
    for batch in batches:
        for part in slices(batch, "text_a"):
            wa, pa_ = hashed_words(part.column(2))
            ga, qa = shingles(wa, pa_)
            keep = []
            for k in range(part.num_rows):
                node = part.column(1)[k].as_py()
                if last is None or last[0] != node:
                    last = (node, shingles(*hashed_words(part.column(3).slice(k, 1)))[0])
                keep.append(similarity(ga[qa[k] : qa[k + 1]], last[1]) >= SIMILAR)
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Text of each node, from one of its documents. nodes: node, doc_id."""
    source = docs.select(F.col("doc_id").alias("_d"), F.col("text").alias("_t"), F.unhex(F.md5(F.col("text"))).alias("_n"))
    few = nodes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    side = F.broadcast(nodes) if few else nodes
    hit = source.join(side, (F.col("_n") == F.col("node")) & F.col("_d").eqNullSafe(F.col("doc_id")))
    return save(hit.select("node", F.col("_t").alias("text")).dropDuplicates(["node"]), "texts")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose texts are similar enough."""
    pairs = save(pairs, "pairs")
    used = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    few = save(nodes.join(used, "node", "left_semi").select("node", "doc_id"), "nodes")
    texts = _texts(docs, few)
    rows = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    rows = rows.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    links = save(rows.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a binary, b binary"), "links")
    drop(pairs, few, texts)
    return links


def _grams(batches):
    for batch in batches:
        for part in slices(batch):
            words, ptr = hashed_words(part.column(1))
            grams, cut = shingles(words, ptr)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([grams[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["node", "grams"])


def _across(keys, part):
    """Verified links between the components of one pair of blocks, as few as join up what they join.

    Looked at are pairs of different components whose sketches may reach the threshold and whose first common band
    is this bucket's, the most alike first; a pair that earlier links have joined already is not verified again.
    """
    key, i, j = (k.as_py() for k in keys)
    node, comp, chunk = part.column("node").to_pylist(), part.column("comp").to_pylist(), np.array(part.column("chunk"))
    sketch = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint8).reshape(-1, M)
    bands = np.frombuffer(b"".join(part.column("bands").to_pylist()), np.int64).reshape(-1, BANDS)
    own = (bands == key).argmax(axis=1)
    label = np.unique(np.array(comp, dtype=object), return_inverse=True)[1]
    left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
    found = []
    for x in left:
        other = right[right > x] if i == j else right
        other = other[label[other] != label[x]]
        like = (sketch[other] == sketch[x]).mean(axis=1)
        other, like = other[like >= SKETCH_SIMILAR], like[like >= SKETCH_SIMILAR]
        first = (bands[other] == bands[x]).argmax(axis=1) == own[x] if len(other) else np.zeros(0, bool)
        found.append(np.stack((np.full(first.sum(), x), other[first], -like[first])))
    pairs = np.concatenate(found, axis=1) if found else np.zeros((3, 0))
    root, grams = np.arange(len(label)), part.column("grams")
    held: dict[int, np.ndarray] = {}

    def top(k):
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    def shingles_of(k):
        if k not in held:
            held[k] = np.frombuffer(grams[k].as_buffer(), np.uint64)
        return held[k]

    a, b = [], []
    for x, y in pairs[:2, np.argsort(pairs[2], kind="stable")].T.astype(np.int64):
        p, q = top(label[x]), top(label[y])
        if p != q and similarity(shingles_of(x), shingles_of(y)) >= SIMILAR:
            root[p] = q
            lo, hi = sorted((node[x], node[y]))
            a.append(hi)
            b.append(lo)
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _mixed_blocks(labelled: DataFrame) -> DataFrame:
    """key, i, j, node, comp, chunk: the members of buckets that hold several components, dealt to pairs of blocks.

    A bucket's largest component is not held against itself: its blocks meet only those of the other members.
    """
    by_comp = labelled.groupBy("key", "comp").agg(F.count("*").alias("n"))
    mixed = by_comp.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n")).where("n > n_main")
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    rows = labelled.join(mixed.select("key", "main", blocks(F.col("n") - F.col("n_main")).alias("rest"), blocks(F.col("n_main")).alias("core")), "key")
    spread, inner = F.xxhash64("node"), F.col("comp") == F.col("main")
    rows = rows.withColumn("chunk", F.when(inner, F.col("rest") + F.pmod(spread, F.col("core"))).otherwise(F.pmod(spread, F.col("rest"))).cast("int"))
    partners = F.sequence(F.lit(0), F.when(inner, F.col("rest") - 1).otherwise(F.col("rest") + F.col("core") - 1))
    rows = rows.select("key", "node", "comp", "chunk", F.explode(partners).alias("o"))
    return rows.select("key", F.least("chunk", "o").alias("i"), F.greatest("chunk", "o").alias("j"), "node", "comp", "chunk")


def classes(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, class_id, class_size, representative, and its text's `node` (null without words)."""
    docs = docs.select("doc_id", "text")
    signed_rows = save(docs.select("doc_id", "text", F.unhex(F.md5(F.col("text"))).alias("node")).mapInArrow(
        _sign, "doc_id long, node binary, bands binary, sketch binary"), "signatures")
    real = signed_rows.where(F.col("bands").isNotNull())
    nodes = save(real.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"),
                                          F.min("bands").alias("bands"), F.min("sketch").alias("sketch")), "texts")
    rows = nodes.select("node", "bands").mapInArrow(_spread, "node binary, key long")
    shared = save(rows.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1"), "shared")
    members = save(join_hot(rows, shared, "key").select("key", "node", "first"), "buckets")
    drop(shared)
    centres = F.slice(F.array_sort(F.collect_set("first")), 1, STARS)  # of at most BANDS; the smallest are shared most
    stars = members.where("node != first").groupBy(F.col("node").alias("a")).agg(centres.alias("bs")).select("a", F.explode("bs").alias("b"))
    links = _verified(stars, docs, nodes)
    joined = components(links)

    labelled = save(members.join(joined, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp")), "labelled")
    blocks = save(_mixed_blocks(labelled), "blocks")
    used = nodes.join(blocks.select("node").distinct(), "node", "left_semi")
    few = save(used.select("node", "doc_id"), "nodes")
    texts = _texts(docs, few)
    grams = texts.mapInArrow(_grams, "node binary, grams binary")
    known = save(used.select("node", "bands", "sketch").join(grams, "node"), "grams")
    more = save(blocks.join(known, "node").groupBy("key", "i", "j").applyInArrow(_across, "a binary, b binary"), "links")
    drop(members, labelled, blocks, few, texts, known)

    joined = components(links.union(more), joined)
    drop(links, more)
    labels = nodes.join(joined, "node", "left").select("node", "doc_id", "rows", F.coalesce("comp", "node").alias("comp"))
    named = save(labels.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.sum("rows").alias("class_size"), F.count("*").alias("n"),
                                            F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("_best")), "named")
    by_node = save(join_hot(labels, named, "comp").select(
        "node", "rows", "class_id", "class_size", (F.col("_best.node") == F.col("node")).alias("best"), F.col("doc_id").alias("_first")), "classes")
    out = join_hot(real.select("doc_id", "node"), by_node, "node", "rows").select(
        "doc_id", "class_id", "class_size", (F.col("best") & F.col("doc_id").eqNullSafe(F.col("_first"))).alias("representative"), "node")
    alone = signed_rows.where(F.col("bands").isNull()).select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("representative"), F.lit(None).cast("binary").alias("node"))
    return out.unionByName(alone)


def near_duplicates(docs: DataFrame) -> DataFrame:
    return classes(docs).drop("node")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each class, columns as given; documents without words all stay."""
    names = docs.columns
    found = classes(docs)
    keep = save(found.where("representative and node is not null").groupBy("node", "doc_id").agg(F.count("*").alias("n")), "kept")
    marked = docs.withColumn("_weft_node", F.unhex(F.md5(F.col("text"))))
    few = keep.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    side = keep.select(F.col("node").alias("_weft_n"), F.col("doc_id").alias("_weft_d"), F.col("n").alias("_weft_rows"))
    hit = marked.join(F.broadcast(side) if few else side,
                      (F.col("_weft_node") == F.col("_weft_n")) & F.col("doc_id").eqNullSafe(F.col("_weft_d")))
    own = [F.col(f"`{c}`") for c in names]
    once = hit.where("_weft_rows = 1").select(*own)
    whole = F.struct(*own)
    again = hit.where("_weft_rows > 1").groupBy("_weft_node").agg(F.min_by(whole, F.sha2(F.to_json(whole), 256)).alias("_weft_row"))
    again = again.select(*[F.col("_weft_row").getField(c).alias(c) for c in names])
    empty = docs.where(F.col("text").isNull() | ~F.col("text").rlike(WORD)).select(*own)
    return once.unionByName(again).unionByName(empty)


def op7(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
