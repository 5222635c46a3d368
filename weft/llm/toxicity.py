"""Toxicity: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Examples are a bounded sample of labelled rows: of each label the EXAMPLES rows with the smallest
hash of doc_id, among those outside the held-out third, with texts of at most EXAMPLE_BYTES. Terms are
all words of the examples and their stems; none is selected away. Document frequencies are counted
over all documents. Examples and queries are TF-IDF vectors of length one.

Each whole text is a query. The part of its cosines that comes from the commonest terms (at most
DENSE) is one matrix product a batch; the other terms have posting lists. Examples lie in blocks of
BLOCK, like ones together: a block's best part and the block maxima of the query's other terms bound its
cosines, and the lists are read in those blocks whose bound reaches the K-th best part, so the K
nearest are exact. They vote
with the cosine in which every term is weighted by how much it tells about the label in the sample
(1 + root of its likelihood ratio): words that go with neither label do not drown those that do. The vote
is calibrated by isotonic regression on leave-one-out votes, weighted back to the labels' shares among
all labelled rows. The three examples with the largest share in the vote are the evidence.

Defined results: null or empty texts, and texts without any term of an example, get the share of toxic
rows among such examples, or among all labelled rows where no example is like that; without labels
every score is 0; contradicting labels of a doc_id count as toxic; labels with a null doc_id or value
are ignored; of documents that share a doc_id the first text by order is the example; ties go by the
order of the examples; rows that repeat are scored alike; only doc_id, text and toxic are read.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, mix64, raw, slices, span_hashes, table, word_bounds

EXAMPLES = 1500  # of each label
EXAMPLE_BYTES = 1 << 16
STEM = 5
K = 100
BLOCK = 32
PIVOTS = 24
DENSE = 2048
REMEMBERED = 50_000  # scores a worker keeps for texts that come again
PRIOR_WEIGHT = 0.05
THRESHOLD = 0.7
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[b for b in range(33, 127) if not chr(b).isalnum()]] = 32


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, without ASCII case and punctuation, and of their stems (first STEM bytes), by text."""
    data, offsets = raw(column)
    data = _FOLD[data]
    starts, ends, ptr = word_bounds(data, offsets)
    long = ends - starts > STEM
    stems = mix64(span_hashes(data, starts[long], starts[long] + STEM))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(ptr))
    both = np.concatenate((doc, doc[long]))
    order = np.argsort(both, kind="stable")
    return np.concatenate((span_hashes(data, starts, ends), stems))[order], np.searchsorted(both[order], np.arange(len(offsets)))


def bags(h: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different terms of each text and their counts, and where each text's begin."""
    doc = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h))), np.searchsorted(doc[at], np.arange(len(ptr)))


def _example_terms(batches):
    for batch in batches:
        for part in slices(batch):
            t, n, ptr = bags(*terms(part.column(2)))
            n = n.astype(np.int32)
            own = list(zip(ptr[:-1], ptr[1:], strict=True))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([t[a:b].tobytes() for a, b in own], pa.binary()),
                 pa.array([n[a:b].tobytes() for a, b in own], pa.binary())], names=["doc_id", "toxic", "terms", "counts"])


def _frequencies(shared):
    """(place in the vocabulary, documents) of one task; place -1 counts the documents themselves."""
    def rows(batches):
        vocabulary, df, n = shared.value, np.zeros(len(shared.value), np.int64), 0
        for batch in batches:
            for part in slices(batch):
                t, _, _ = bags(*terms(part.column(0)))
                n += part.num_rows
                at = np.minimum(np.searchsorted(vocabulary, t), len(vocabulary) - 1)
                df += np.bincount(at[vocabulary[at] == t], minlength=len(df))
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1).astype(np.int32)), pa.array(np.append(df[seen], n))], names=["term", "n"])

    return rows


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: points (x, fitted y) of a rising step function."""
    order = np.argsort(x, kind="stable")
    level: list[list[float]] = []
    for a, b, c in zip(x[order], y[order], w[order], strict=True):
        level.append([b, c, a, a])
        while len(level) > 1 and (level[-2][0] >= level[-1][0] or level[-2][3] == level[-1][2]):
            q, p = level.pop(), level.pop()
            level.append([(p[0] * p[1] + q[0] * q[1]) / (p[1] + q[1]), p[1] + q[1], p[2], q[3]])
    return np.array([v for p in level for v in (p[2], p[3])]), np.array([p[0] for p in level for _ in (0, 1)])


def likelihood_ratio(df: np.ndarray, positive: np.ndarray, n: int, n_positive: int) -> np.ndarray:
    """How much each term tells about the label: the G statistic of the two-by-two table."""
    a, b = positive, df - positive
    c, d = n_positive - a, n - n_positive - b
    g = np.zeros(len(df))
    for cell, row, col in ((a, a + b, a + c), (b, a + b, b + d), (c, c + d, a + c), (d, c + d, b + d)):
        g += 2 * cell * np.log(np.maximum(cell * n, 1e-9) / np.maximum(row * col, 1e-9))
    return np.maximum(g, 0)


class Neighbours:
    """Block-max index of the examples. After `build` it is ready for queries."""

    def __init__(self, examples, share: float) -> None:
        """examples: (doc_id, toxic, terms, counts); share: of toxic rows among all labelled ones."""
        self.examples, self.share, self.known = examples, float(share), {}
        held = [np.frombuffer(e[2], np.uint64) for e in examples]
        self.vocabulary = np.unique(np.concatenate(held)) if held else np.zeros(0, np.uint64)

    def build(self, df: np.ndarray, documents: int) -> Neighbours:
        """df: of each term of the vocabulary, among all documents."""
        size = max(1, len(self.vocabulary))
        self.idf = np.log((1 + documents) / (1 + df)) + 1
        vectors = [self.vector(np.frombuffer(e[2], np.uint64), np.frombuffer(e[3], np.int32)) for e in self.examples]
        order = self._likeness(vectors, size)
        self.examples, vectors = [self.examples[k] for k in order], [vectors[k] for k in order]
        self.ids, self.toxic = [e[0] for e in self.examples], np.array([e[1] for e in self.examples], float)
        n, positive = len(order), self.toxic.sum()
        self.rank = np.argsort(np.argsort(np.array(order))) if n else np.zeros(0, np.int64)
        at = np.concatenate([v[0] for v in vectors]) if n else np.zeros(0, np.int64)
        weight = np.concatenate([v[1] for v in vectors]) if n else np.zeros(0)
        who = np.repeat(np.arange(n), [len(v[0]) for v in vectors]) if n else np.zeros(0, np.int64)
        tells = 1 + np.sqrt(likelihood_ratio(np.bincount(at, minlength=size).astype(float), np.bincount(at, self.toxic[who], minlength=size), n, positive))
        self.tells = tells * tells
        self.length = np.sqrt(np.bincount(who, weight * weight * self.tells[at], minlength=n))
        self.n, self.blocks = n, n // BLOCK + 1
        often = np.bincount(at, minlength=size)
        common = np.argsort(-often, kind="stable")[:DENSE]
        common = np.sort(common[often[common] * 64 >= max(n, 64)])
        self.column = np.full(size, -1)
        self.column[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.blocks * BLOCK), np.float32)
        listed = self.column[at] < 0
        self.dense[self.column[at[~listed]], who[~listed]] = weight[~listed]
        self.dense_tells = self.tells[common].astype(np.float32)
        at, who, weight = at[listed], who[listed], weight[listed]
        by = np.lexsort((who, at))
        at, who, weight = at[by], who[by], weight[by]
        self.who, self.weight = who, weight.astype(np.float32)
        first = np.flatnonzero(np.diff(at * self.blocks + who // BLOCK, prepend=-1))
        self.cell = np.append(first, len(at))  # postings of one term in one block
        self.cell_block = who[first] // BLOCK
        self.cell_max = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0, np.float32)
        self.start = np.searchsorted(at[first], np.arange(size + 1))
        rows = np.where(self.toxic > 0, self.share / max(positive, 1), (1 - self.share) / max(n - positive, 1))
        empty = np.array([not len(v[0]) for v in vectors], bool)
        mass = rows[empty].sum()
        self.floor = float((rows * self.toxic)[empty].sum() / mass) if mass else self.share
        self.curve = None
        votes = []
        for lo in range(0, n, 256):
            parts = self.parts(vectors[lo : lo + 256])
            votes += [self.vote(*v, *p, leave=lo + k)[0] for k, (v, *p) in enumerate(zip(vectors[lo : lo + 256], *parts, strict=True)) if len(v[0])]
        if len(votes):
            self.curve = isotonic(np.array(votes), self.toxic[~empty], rows[~empty])
        self.examples = None
        return self

    def _likeness(self, vectors, size: int) -> list[int]:
        """Examples by the pivot they are most like, so that a block's maxima are low for unlike queries."""
        pivots = np.zeros((min(PIVOTS, len(vectors)), size), np.float32)
        for row, k in zip(pivots, range(0, len(vectors), max(1, len(vectors) // PIVOTS)), strict=False):
            row[vectors[k][0]] = vectors[k][1]
        return sorted(range(len(vectors)), key=lambda k: (int((pivots[:, vectors[k][0]] @ vectors[k][1].astype(np.float32)).argmax()), k))

    def vector(self, t: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the vocabulary and the unit TF-IDF weights of a bag of terms."""
        if not len(t) or not len(self.vocabulary):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.vocabulary, t), len(self.vocabulary) - 1)
        own = self.vocabulary[at] == t
        at, w = at[own], (1 + np.log(count[own])) * self.idf[at[own]]
        return at, w / max(1e-12, float(np.sqrt((w * w).sum())))

    @staticmethod
    def _ranges(lo: np.ndarray, count: np.ndarray) -> np.ndarray:
        """All numbers of the ranges that begin at lo and hold count."""
        upto = np.cumsum(count)
        return np.arange(upto[-1] if len(upto) else 0) + np.repeat(lo - upto + count, count)

    def parts(self, vectors) -> tuple[np.ndarray, np.ndarray]:
        """Parts of the cosines, and of the label-weighted products, with every example that come from the commonest terms, a row a query."""
        q = np.zeros((len(vectors), len(self.dense)), np.float32)
        for row, (at, w) in zip(q, vectors, strict=True):
            place = self.column[at]
            row[place[place >= 0]] = w[place >= 0]
        return q @ self.dense, (q * self.dense_tells) @ self.dense

    def nearest(self, at: np.ndarray, q: np.ndarray, part: np.ndarray, told: np.ndarray, leave: int = -1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The K examples with the largest cosine, exactly, ties by their order; their cosines and label-weighted products."""
        if leave >= 0:
            part[leave] = 0
        listed = self.column[at] < 0
        at = at[listed]
        lo = self.start[at]
        count = self.start[at + 1] - lo
        cells, q = self._ranges(lo, count), np.repeat(q[listed].astype(np.float32), count)
        block = self.cell_block[cells]
        bound = np.bincount(block, q * self.cell_max[cells], minlength=self.blocks) + part.reshape(-1, BLOCK).max(axis=1)
        floor = np.partition(part, -K)[-K] if len(part) > K else 0.0
        inside = (bound >= floor - 1e-5)[block]
        cells, q, tells = cells[inside], q[inside], np.repeat(self.tells[at], count)[inside]
        lo = self.cell[cells]
        count = self.cell[cells + 1] - lo
        posts = self._ranges(lo, count)
        who, gain = self.who[posts], np.repeat(q, count) * self.weight[posts]
        score = part + np.bincount(who, gain, minlength=len(part))
        if leave >= 0:
            score[leave] = 0
        top = np.flatnonzero(score > 0)
        if len(top) > 2 * K:
            top = top[score[top] >= np.partition(score, -K)[-K]]
        top = top[np.lexsort((self.rank[top], -score[top]))][:K]
        return top, score[top], (told + np.bincount(who, gain * np.repeat(tells, count), minlength=len(part)))[top]

    def vote(self, at, q, part, told, leave: int = -1) -> tuple[float, str]:
        top, _, told = self.nearest(at, q, part, told, leave)
        s = told / np.maximum(1e-12, self.length[top] * np.sqrt((q * q * self.tells[at]).sum()))
        best = np.argsort(-s, kind="stable")[:3]
        return (float((s * self.toxic[top]).sum()) + PRIOR_WEIGHT * self.floor) / (float(s.sum()) + PRIOR_WEIGHT), \
            ",".join(f"{self.ids[top[k]]}:{s[k]:.4f}" for k in best)

    def scores(self, t: np.ndarray, count: np.ndarray, ptr: np.ndarray) -> list[tuple[float, str, int]]:
        """Score, evidence and known terms of each text's bag of terms."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        vectors = [self.vector(t[a:b], count[a:b]) for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
        keys = [blake2b(at.tobytes() + q.tobytes(), digest_size=16).digest() if len(at) and self.n else None for at, q in vectors]
        fresh = {k: v for k, v in zip(keys, vectors, strict=True) if k is not None and k not in self.known}
        for lo in range(0, len(fresh), 256):
            some = list(fresh.items())[lo : lo + 256]
            for (key, (at, q)), *part in zip(some, *self.parts([v for _, v in some]), strict=True):
                vote, evidence = self.vote(at, q, *part)
                if self.curve is not None:
                    vote = 0.9 * float(np.interp(vote, *self.curve)) + 0.1 * vote
                self.known[key] = (round(vote, 9), evidence, len(at))
        return [(self.floor, "", 0) if k is None else self.known[k] for k in keys]


def fit(docs: DataFrame, labels: DataFrame) -> Neighbours:
    none = lambda share: Neighbours([], share).build(np.zeros(0), 0)
    known = labels.where("doc_id is not null and toxic is not null").where(crc_mod(3) != 1)
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return none(0.0)
    order = (F.xxhash64("doc_id", F.lit("example")), F.col("doc_id"))
    parts = [known.where(F.col("toxic") == v).orderBy(*order).limit(EXAMPLES) for v in (0, 1)]
    chosen = parts[0].union(parts[1]).select(F.col("doc_id").alias("_weft_id"), F.col("toxic").alias("_weft_toxic"))
    short = docs.where(F.octet_length(F.coalesce("text", F.lit(""))) <= EXAMPLE_BYTES)
    rows = short.join(F.broadcast(chosen), short["doc_id"] == F.col("_weft_id")).groupBy("doc_id", "_weft_toxic").agg(F.min("text").alias("text"))
    got = rows.mapInArrow(_example_terms, "doc_id long, toxic int, terms binary, counts binary").collect()
    model = Neighbours(sorted(((r[0], r[1], bytes(r[2]), bytes(r[3])) for r in got), key=lambda r: r[0]), counts.get(1, 0) / total)
    if not len(model.vocabulary):
        return model.build(np.zeros(0), 0)
    shared = docs.sparkSession.sparkContext.broadcast(model.vocabulary)
    seen = docs.select("text").mapInArrow(_frequencies(shared), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = seen.column("term").to_numpy(), seen.column("n").to_numpy()  # at most one row a term of the sample
    df = np.zeros(len(model.vocabulary))
    df[term[term >= 0]] = n[term >= 0]
    return model.build(df, int(n[term < 0].sum()))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted, n_terms, evidence (doc_id:similarity of the three that count most)."""
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels.select("doc_id", "toxic")))

    def rows(batches):
        model = shared.value
        for batch in batches:
            for part in slices(batch):
                got = model.scores(*bags(*terms(part.column(2))))
                score = np.array([g[0] for g in got])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32)),
                     pa.array([g[2] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.string())],
                    names=["doc_id", "held_out", "score", "predicted", "n_terms", "evidence"])

    return docs.select("doc_id", (crc_mod(3) == 1).alias("held_out"), "text").mapInArrow(
        rows, "doc_id long, held_out boolean, score double, predicted int, n_terms int, evidence string")


def op9(spark, sf_dir) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))
