"""Benchmark decontamination: a BM25 inverted index of test items, queried with every passage.

Items are cut into segments of up to 64 words and indexed with block-max weights. Each document
is read as 128-word passages, 64 apart, so that a copied segment lies whole in one of them. A
batch of passages is searched at once: terms too common to reach the threshold alone open no
block; the others' block maxima bound each block's score, blocks whose bound stays under their
lowest threshold are skipped, and the rest are scored exactly. All segments with at least
SCORE_SHARE of their own score are retrieved, none is cut off by rank. Every retrieved item is
then held against the whole document: 5-word shingles of its question (all but the last quarter
of its words) and of its answer (the last quarter, with four words before it) must both be there
to OVERLAP.

The item table is worked through in blocks of about BLOCK_ITEMS items and BLOCK_CHARS characters
of text. Document frequencies, the number of segments and their mean length are those of the whole
table, so what is retrieved does not depend on the blocks. Several blocks are broadcast one after
the other; each pass writes the leaks it finds to the shared folder and its index is given up before
the next is made, so a large benchmark costs more passes, not memory.

Defined results: null or empty texts are clean; items without words are ignored; an item whose
question has under five words (one of up to five words) leaks where all its words stand together; an
item with a null item_id counts like any other, and all of them as one in n_items, but its id is not
listed; rows of the benchmark that repeat count once; documents that repeat are judged alike and
all returned; only doc_id, text and item_id are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, hashed_words, save, shingles, slices, table

SEGMENT, PASSAGE = 64, 128
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 1 << 26
PER_BLOCK = 8  # segments under one block maximum
K1, B = 1.2, 0.75
SCORE_SHARE = 0.4
OVERLAP = 0.5
FEW_LEAKS = 200_000  # documents whose leaks may be broadcast
_IDS = "array<long>"


def segments(own: np.ndarray) -> list[np.ndarray]:
    """An item's words in pieces of SEGMENT; a short rest stays with the last piece."""
    cuts = range(0, max(1, len(own) - SEGMENT // 2), SEGMENT) if len(own) else ()
    return [own[lo : lo + SEGMENT] if lo + SEGMENT * 3 // 2 < len(own) else own[lo:] for lo in cuts]


class ItemIndex:
    def __init__(self, items: list[tuple[int | None, str]], statistics=None) -> None:
        """statistics: (segments, their mean length, terms, in how many segments each is) of the whole benchmark; by default of these items."""
        words, ptr = hashed_words(pa.array([t or "" for _, t in items], pa.string()), lower=True)
        self.ids, parts, of = [i for i, _ in items], [], []
        self.question, self.answer, self.whole = [], [], []
        for k in range(len(items)):
            own = words[ptr[k] : ptr[k + 1]]
            pieces = segments(own)
            parts += pieces
            of += [k] * len(pieces)
            cut = len(own) - max(1, len(own) // 4)
            self.question.append(np.unique(shingles(own[:cut], np.array([0, max(0, cut)]))[0]))
            tail = own[max(0, cut - 4) :]
            self.answer.append(np.unique(shingles(tail, np.array([0, len(tail)]))[0]))
            self.whole.append((len(own), shingles(own, np.array([0, len(own)]), len(own))[0][0]) if 0 < len(own) and cut < 5 else None)
        self.of = np.array(of, np.int64)
        n = len(parts)
        doc = np.repeat(np.arange(n), [len(s) for s in parts])
        terms = np.concatenate(parts) if n else np.zeros(0, np.uint64)
        self.vocabulary, term = np.unique(terms, return_inverse=True)
        pair, tf = np.unique(term * max(n, 1) + doc, return_counts=True)
        t, d = pair // max(n, 1), pair % max(n, 1)
        length = np.bincount(doc, minlength=n)
        if statistics is None:
            total, mean, df = n, length.mean() if n else 1, np.bincount(t, minlength=len(self.vocabulary))
        else:
            total, mean, known, count = statistics
            df = count[np.searchsorted(known, self.vocabulary)] if n else np.zeros(0)
        idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * length / max(1e-9, mean))
        weight = idf[t] * tf * (K1 + 1) / (tf + norm[d])
        own_score = np.bincount(d, weight, minlength=n)
        self.needs = SCORE_SHARE * own_score
        # the commonest terms, as long as they make up at most half of every threshold, open no block
        rank = np.argsort(idf, kind="stable")
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        order = np.lexsort((place[t], d))
        sums = np.cumsum(weight[order])
        before = np.concatenate(([0.0], sums))[np.searchsorted(d[order], np.arange(n))] if n else np.zeros(0)
        over = sums - before[d[order]] > self.needs[d[order]] / 2
        limit = place[t[order]][over].min() if over.any() else len(rank)
        self.opens = place >= limit
        common = np.bincount(d, np.where(self.opens[t], 0, weight), minlength=n)
        blocks = (n + PER_BLOCK - 1) // PER_BLOCK
        self.block_needs = np.full(blocks, np.inf)
        np.minimum.at(self.block_needs, np.arange(n) // PER_BLOCK, self.needs - common)
        # postings by term, and block maxima of the terms that open blocks
        self.start = np.searchsorted(t, np.arange(len(self.vocabulary) + 1))
        self.doc, self.weight = d, weight
        key, at = np.unique(t * max(blocks, 1) + d // PER_BLOCK, return_inverse=True)
        top = np.zeros(len(key))
        np.maximum.at(top, at, weight)
        self.block_start = np.searchsorted(key // max(blocks, 1), np.arange(len(self.vocabulary) + 1))
        self.block, self.block_max = key % max(blocks, 1), top
        self.n, self.blocks = n, blocks
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[(self.vocabulary & np.uint64((1 << 18) - 1)).astype(np.int64)] = True

    @staticmethod
    def _expand(start, terms):
        """Rows of a term-ordered list for the given terms: index into the list, and index into terms."""
        count = start[terms + 1] - start[terms]
        who = np.repeat(np.arange(len(terms)), count)
        return np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count) + start[terms][who], who

    def search(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, segment) pairs that score at least the segment's threshold, from (passage, term) occurrences."""
        pair = np.unique(passage * len(self.vocabulary) + term)
        passage, term = pair // len(self.vocabulary), pair % len(self.vocabulary)
        rare = self.opens[term]
        at, who = self._expand(self.block_start, term[rare])
        key, inv = np.unique(passage[rare][who] * self.blocks + self.block[at], return_inverse=True)
        bound = np.bincount(inv, self.block_max[at], minlength=len(key))
        live = key[bound >= self.block_needs[key % self.blocks] - 1e-9]
        if not len(live):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        open_passages = np.unique(live // self.blocks)
        keep = np.isin(passage, open_passages)
        passage, term = passage[keep], term[keep]
        at, who = self._expand(self.start, term)
        block = passage[who] * self.blocks + self.doc[at] // PER_BLOCK
        inside = np.isin(block, live)
        key, inv = np.unique((passage[who] * self.n + self.doc[at])[inside], return_inverse=True)
        score = np.bincount(inv, self.weight[at][inside], minlength=len(key))
        hit = key[score >= self.needs[key % self.n] - 1e-9]
        return hit // self.n, hit % self.n

    def leaks(self, words: np.ndarray, ptr: np.ndarray) -> list[list[tuple[int, float]]]:
        """For each text its leaked items and the smaller of question and answer overlap."""
        out: list[list[tuple[int, float]]] = [[] for _ in range(len(ptr) - 1)]
        if not self.n or not len(words):
            return out
        at = np.flatnonzero(self.maybe[(words & np.uint64((1 << 18) - 1)).astype(np.int64)])
        term = np.minimum(np.searchsorted(self.vocabulary, words[at]), len(self.vocabulary) - 1)
        same = self.vocabulary[term] == words[at]
        at, term = at[same], term[same]
        if not len(at):
            return out
        text = np.searchsorted(ptr, at, side="right") - 1
        stride = (at - ptr[text]) // SEGMENT  # a word stands in passage `stride` and in the one before
        most = int(stride.max()) + 2
        passage = np.concatenate((text * most + stride + 1, text * most + stride))
        got, segment = self.search(passage, np.concatenate((term, term)))
        grams, gram_ptr = None, None
        for pair in np.unique(got // most * len(self.ids) + self.of[segment]) if len(got) else ():
            k, item = divmod(int(pair), len(self.ids))
            if grams is None:
                grams, gram_ptr = shingles(words, ptr)
            own = grams[gram_ptr[k] : gram_ptr[k + 1]]
            if self.whole[item]:
                length, print_ = self.whole[item]
                text_words = words[ptr[k] : ptr[k + 1]]
                share = float((shingles(text_words, np.array([0, len(text_words)]), length)[0] == print_).any())
            else:
                share = min([float(np.isin(part, own).mean()) for part in (self.question[item], self.answer[item]) if len(part)])
            if share >= OVERLAP:
                out[k].append((self.ids[item], share))
        return out


def _term_counts(batches):
    """(term, segments that hold it, -) of a task; one row without a term has the segments and their words."""
    held, n, words = [], 0, 0
    for batch in batches:
        for part in slices(batch, "text"):
            h, ptr = hashed_words(part.column(1), lower=True)
            for a, b in zip(ptr[:-1], ptr[1:], strict=True):
                pieces = segments(h[a:b])
                n, words = n + len(pieces), words + int(b - a)
                held += [np.unique(p) for p in pieces]
            if len(held) > 10_000:
                yield _counted(held)
                held = []
    yield _counted(held)
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([n], pa.int64()), pa.array([words], pa.int64())], names=["term", "n", "words"])


def _counted(held):
    u, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(np.zeros(len(u), np.int64))], names=["term", "n", "words"])


def _block_terms(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            u = np.unique(hashed_words(part.column(1), lower=True)[0])
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64))], names=["term"])


def indexes(items: DataFrame):
    """The blocks' indexes, one after the other; yields their number first."""
    items = items.distinct()
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(math.ceil(n / BLOCK_ITEMS), math.ceil(chars / BLOCK_CHARS))
    yield parts
    ordered = lambda rows: sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if parts == 1:
        yield ItemIndex(ordered(items.collect()))
    elif parts:
        items = save(items, "items")
        counts = save(items.mapInArrow(_term_counts, "term long, n long, words long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words")), "terms")
        total = counts.where("term is null").first()
        for k in range(parts):
            own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
            terms = own.mapInArrow(_block_terms, "term long").distinct()
            known = counts.join(terms, "term", "left_semi").select("term", "n").toArrow()
            term, count = known.column("term").to_numpy().view(np.uint64), known.column("n").to_numpy()
            order = np.argsort(term)
            yield ItemIndex(ordered(own.collect()), (total["n"], total["words"] / max(1, total["n"]), term[order], count[order]))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a document: doc_id, contaminated, n_items, items (ids, joined by commas), overlap."""
    return _with_leaks(docs.select("doc_id", "text"), benchmark).select(
        "doc_id", (F.size("_weft_items") > 0).alias("contaminated"), F.size("_weft_items").cast("long").alias("n_items"),
        F.array_join("_weft_items", ",").alias("items"), F.col("_weft_overlap").alias("overlap"))


def _with_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents with _weft_items, an array of ids in order, and _weft_overlap."""
    blocks = indexes(benchmark.select("item_id", "text").where(F.col("text").rlike(WORD)))
    parts = next(blocks)
    none = F.array().cast(_IDS)
    if not parts:
        return docs.withColumns({"_weft_items": none, "_weft_overlap": F.lit(0.0)})
    send = docs.sparkSession.sparkContext.broadcast
    if parts == 1:
        names = docs.columns
        marked = docs.withColumns({"_weft_items": none, "_weft_overlap": F.lit(0.0)})
        return marked.mapInArrow(_mark(send(next(blocks)), names.index("text"), len(names)), marked.schema)
    key = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))
    keyed, hits = docs.select("doc_id", key.alias("md5"), "text"), None
    for index in blocks:
        shared = send(index)
        found = save(keyed.mapInArrow(_hits(shared), "_weft_id long, _weft_md5 binary, item long, share double").distinct(), "leaks")
        shared.destroy()
        hits = found if hits is None else hits.union(found)
    leaks = save(hits.groupBy("_weft_id", "_weft_md5").agg(  # a document holds few items
        F.array_sort(F.collect_set("item")).alias("ids"), F.bool_or(F.col("item").isNull()).alias("unnamed"), F.max("share").alias("_weft_overlap")), "leaks")
    side = F.broadcast(leaks) if leaks.limit(FEW_LEAKS + 1).count() <= FEW_LEAKS else leaks
    out = docs.withColumn("_weft_key", key).join(side, F.col("doc_id").eqNullSafe(F.col("_weft_id")) & (F.col("_weft_key") == F.col("_weft_md5")), "left")
    ids = F.when(F.col("unnamed"), F.concat("ids", F.array(F.lit(None).cast("long")))).otherwise(F.col("ids"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(ids, none).alias("_weft_items"), F.coalesce("_weft_overlap", F.lit(0.0)).alias("_weft_overlap"))


def _mark(shared, text_at: int, at: int):
    """Fill in the last two columns."""
    def rows(batches):
        index = shared.value
        for batch in batches:
            for part in slices(batch):
                found = index.leaks(*hashed_words(part.column(text_at), lower=True))
                if any(found):
                    ids = [sorted({i for i, _ in own}, key=lambda i: (i is None, i or 0)) for own in found]
                    part = part.set_column(at, part.schema.field(at), pa.array(ids, part.schema.field(at).type))
                    part = part.set_column(at + 1, part.schema.field(at + 1), pa.array([max([0.0, *[x for _, x in own]]) for own in found], pa.float64()))
                yield part

    return rows


def _hits(shared):
    """Rows (doc_id, md5, item, share) of one block's leaks."""
    def rows(batches):
        index = shared.value
        for batch in batches:
            for part in slices(batch):
                found = index.leaks(*hashed_words(part.column(2), lower=True))
                at = pa.array(np.repeat(np.arange(part.num_rows), [len(own) for own in found]), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), part.column(1).take(at), pa.array([i for own in found for i, _ in own], pa.int64()),
                     pa.array([x for own in found for _, x in own], pa.float64())], names=["_weft_id", "_weft_md5", "item", "share"])

    return rows


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, columns as given, without those that leak an item."""
    keep = docs.columns
    marked = _with_leaks(docs, benchmark)
    return marked.where(F.size("_weft_items") == 0).select(*[F.col(f"`{c}`") for c in keep])


def op10(spark, sf_dir) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


_SHINGLES = """SELECT k, unnest(CASE WHEN len(ws) >= 5
  THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) ELSE [array_to_string(ws, ' ')] END) AS g"""
SQL = f"""
WITH b AS (SELECT row_number() OVER () AS k, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws
        FROM (SELECT DISTINCT item_id, text FROM benchmark) WHERE regexp_matches(text, '{WORD}')),
c AS (SELECT k, item_id, ws, len(ws) - greatest(1, len(ws) // 4) AS cut FROM b),
q AS (SELECT DISTINCT k, 'q' AS part, g FROM ({_SHINGLES} FROM (SELECT k, ws[1:cut] AS ws FROM c WHERE cut >= 5))),
a AS (SELECT DISTINCT k, 'a' AS part, g FROM ({_SHINGLES} FROM (SELECT k, ws[greatest(1, cut - 3):] AS ws FROM c WHERE cut >= 5))),
i AS (SELECT * FROM q UNION ALL SELECT * FROM a),
n AS (SELECT k, part, count(*) AS n FROM i GROUP BY ALL),
d AS (SELECT row_number() OVER () AS k, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
u AS (SELECT k, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM d WHERE len(ws) > 0),
s AS (SELECT k, CASE WHEN lead(x, 4) OVER o IS NOT NULL
          THEN concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o)
          WHEN p = 1 THEN concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o) END AS g
        FROM u WINDOW o AS (PARTITION BY k ORDER BY p)),
h AS (SELECT s.k AS doc, i.k AS item, i.part, count(DISTINCT s.g) AS hits FROM s JOIN i ON s.g = i.g GROUP BY ALL),
r AS (SELECT doc, item, min(share) AS share FROM (
        SELECT m.doc, n.k AS item, coalesce(h.hits, 0) / n.n AS share
        FROM (SELECT DISTINCT doc, item FROM h) m JOIN n ON n.k = m.item
        LEFT JOIN h ON h.doc = m.doc AND h.item = n.k AND h.part = n.part) GROUP BY doc, item HAVING min(share) >= {OVERLAP}
      UNION ALL SELECT d.k, c.k, 1.0 FROM (SELECT * FROM c WHERE cut < 5) c
        JOIN d ON contains(' ' || array_to_string(d.ws, ' ') || ' ', ' ' || array_to_string(c.ws, ' ') || ' ')),
f AS (SELECT r.doc, c.item_id, max(share) AS share FROM r JOIN c ON c.k = r.item GROUP BY ALL)
SELECT d.doc_id, count(f.share) > 0 AS contaminated, count(f.share) AS n_items,
  coalesce(string_agg(CAST(f.item_id AS VARCHAR), ',' ORDER BY f.item_id), '') AS items, coalesce(max(f.share), 0.0) AS overlap
FROM d LEFT JOIN f ON f.doc = d.k GROUP BY d.k, d.doc_id
"""
