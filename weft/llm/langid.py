"""Language ID: a byte convolutional network in numpy.

Byte embeddings, filters of several widths, ReLU and max pooling over a window, then softmax. It
is trained on a bounded sample: at most DOCS_PER_CLASS different documents a language (fewer where
there are more than MAX_TRAIN_DOCS / DOCS_PER_CLASS languages) outside the held-out quarter, those
with the smallest hash of doc_id and text, at most WINDOWS_PER_DOC windows of each. The windows are
cut where the text lies; only they reach the driver. A whole text is cut into windows of WINDOW bytes (the last one moved back to end with the text) and its windows'
probabilities are averaged. At prediction the embedding and the filters are folded into one table
a filter offset, so that a convolution is a sum of table rows.

Defined results: a null text, or one without a letter, is `und` with score 0; without training
rows every text is `und`; rows that agree in doc_id and text count once in training and are
predicted alike, so one doc_id for all rows (or null) leaves the sample as wide as the texts are; the
model's size is 36 numbers a language; only doc_id, text and lang are read, lang for training alone.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, raw, slices, table

WINDOW = 128
WIDTHS, FILTERS, EMBED = (2, 3, 4), 12, 8
DOCS_PER_CLASS, MAX_TRAIN_DOCS, WINDOWS_PER_DOC = 300, 3000, 4
EPOCHS, BATCH, RATE = 8, 128, 0.01
LETTER = re.compile(r"[^\W\d_]")


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts as rows of bytes, zero beyond a short text, and the text of each row."""
    size = np.diff(offsets)
    n = np.maximum(1, -(-size // WINDOW))
    doc = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    start = np.minimum(k * WINDOW, np.maximum(0, size[doc] - WINDOW))
    at = offsets[doc][:, None] + start[:, None] + np.arange(WINDOW)
    inside = start[:, None] + np.arange(WINDOW) < size[doc][:, None]
    padded = np.append(data, np.uint8(0))
    return np.where(inside, padded[np.minimum(at, len(data))], 0).astype(np.uint8), doc


class ByteCnn:
    def __init__(self, labels: list[str], seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        f = np.float32
        self.labels = labels
        self.p = {"e": rng.normal(0, 0.5, (256, EMBED)).astype(f), "c": np.zeros(len(labels), f),
                  "v": rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(labels))).astype(f)}
        for w in WIDTHS:
            self.p[f"k{w}"] = rng.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS)).astype(f)
            self.p[f"b{w}"] = np.zeros(FILTERS, f)
        self.tables = None

    def _conv(self, x: np.ndarray, w: int) -> np.ndarray:
        tables = self.tables[w] if self.tables else [self.p["e"] @ self.p[f"k{w}"][j] for j in range(w)]
        length = x.shape[1] - w + 1
        out = tables[0][x[:, :length]]
        for j in range(1, w):
            out += tables[j][x[:, j : j + length]]
        return out

    def freeze(self) -> ByteCnn:
        self.tables = {w: [self.p["e"] @ self.p[f"k{w}"][j] for j in range(w)] for w in WIDTHS}
        return self

    def _hidden(self, x):
        hidden, where = [], []
        for w in WIDTHS:
            out = self._conv(x, w)
            if self.tables is None:
                at = out.argmax(axis=1)
                where.append(at)
                top = np.take_along_axis(out, at[:, None, :], 1)[:, 0, :]
            else:
                top = out.max(axis=1)
            hidden.append(np.maximum(top + self.p[f"b{w}"], 0))
        return np.concatenate(hidden, axis=1), where

    def predict(self, x: np.ndarray) -> np.ndarray:
        parts = []
        for lo in range(0, len(x), 512):
            z = self._hidden(x[lo : lo + 512])[0] @ self.p["v"] + self.p["c"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            parts.append(z / z.sum(axis=1, keepdims=True))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.labels)), np.float32)

    def _gradients(self, x, y):
        n = len(x)
        hidden, where = self._hidden(x)
        z = hidden @ self.p["v"] + self.p["c"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        dz = z / z.sum(axis=1, keepdims=True)
        dz[np.arange(n), y] -= 1
        dz /= n
        g = {"v": hidden.T @ dz, "c": dz.sum(axis=0), "e": np.zeros_like(self.p["e"])}
        dh = (dz @ self.p["v"].T) * (hidden > 0)
        for i, w in enumerate(WIDTHS):
            d, at = dh[:, i * FILTERS : (i + 1) * FILTERS], where[i]
            g[f"b{w}"] = d.sum(axis=0)
            k = self.p[f"k{w}"]
            gk = np.zeros_like(k)
            for j in range(w):  # only the pooled place of each filter has a gradient
                byte = np.take_along_axis(x, at + j, 1)
                gk[j] = np.einsum("nfe,nf->ef", self.p["e"][byte], d)
                np.add.at(g["e"], byte.ravel(), (d[:, :, None] * k[j].T[None]).reshape(-1, EMBED))
            g[f"k{w}"] = gk
        return g

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 5) -> ByteCnn:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), BATCH):
                own = order[lo : lo + BATCH]
                t += 1
                rate = RATE * (1 - epoch / EPOCHS)
                for k, g in self._gradients(x[own].astype(np.int64), y[own]).items():
                    m[k] += 0.1 * (g - m[k])
                    s[k] += 0.001 * (g * g - s[k])
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self.freeze()


def drawn(text: bytes, seed: int) -> np.ndarray:
    """Up to WINDOWS_PER_DOC windows of one text, at places drawn by the seed; one of several is cut short, for short texts."""
    rng = np.random.default_rng(seed)
    size = len(text)
    n = max(1, -(-size // WINDOW))
    first = min(size, WINDOW)
    chosen = rng.permutation(n)[:WINDOWS_PER_DOC] if n <= 1 << 16 else rng.choice(n, WINDOWS_PER_DOC, replace=False)
    out = np.zeros((len(chosen), WINDOW), np.uint8)
    for row, k in zip(out, chosen, strict=True):
        at = min(int(k) * WINDOW, max(0, size - WINDOW))
        row[:first] = np.frombuffer(text, np.uint8, first, at)
    if len(out) > 1:
        out[0, rng.integers(12, WINDOW) :] = 0
    return out


def _sample(quota: int):
    """Of each language in a task, the windows of the `quota` different documents with the smallest draw."""
    def rows(batches):
        held: dict[str, dict[int, bytes]] = {}
        for batch in batches:
            langs, draws, texts = (batch.column(k) for k in range(3))
            for k in range(batch.num_rows):
                own, draw = held.setdefault(langs[k].as_py(), {}), draws[k].as_py()
                if draw in own or len(own) >= 2 * quota and draw > max(own):
                    continue
                own[draw] = drawn(texts[k].as_buffer().to_pybytes() if texts[k].is_valid else b"", draw & 0xFFFFFFFF).tobytes()
                if len(own) > 4 * quota:
                    for d in sorted(own)[quota:]:
                        del own[d]
        found = [(lang, d, own[d]) for lang, own in held.items() for d in sorted(own)[:quota]]
        lang, draw, x = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(draw, pa.int64()), pa.array(x, pa.binary())], names=["lang", "draw", "windows"])

    return rows


def training_sample(docs: DataFrame) -> DataFrame:
    """lang, draw, windows: of each language the different documents with the smallest draws, at most the quota."""
    draw = F.xxhash64("doc_id", "text", F.lit("train"))
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).where(crc_mod(4) != 2).select("lang", draw.alias("draw"), "text")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("draw", 0.03).alias("n")).collect()}  # one row a language
    quota = max(1, min(DOCS_PER_CLASS, MAX_TRAIN_DOCS // max(1, len(sizes))))
    few = {lang: min(1.0, (2 * quota + 40) / max(1, n)) for lang, n in sizes.items()}  # share of the draws that is sure to hold the quota
    if sizes:
        top = F.element_at(F.create_map(*[F.lit(x) for lang, share in few.items() for x in (lang, share)]), F.col("lang"))
        known = known.where(F.shiftrightunsigned("draw", 11) < top * float(1 << 53))
    found = known.withColumn("draw", F.shiftrightunsigned("draw", 1)).mapInArrow(_sample(quota), "lang string, draw long, windows binary")
    found = found.groupBy("lang", "draw").agg(F.min("windows").alias("windows"))
    for part in ([F.pmod("draw", F.lit(64))], []):  # two steps, so that no task ranks a language alone
        found = found.withColumn("_at", F.row_number().over(Window.partitionBy("lang", *part).orderBy("draw"))).where(F.col("_at") <= quota).drop("_at")
    return found


def fit(docs: DataFrame) -> ByteCnn | None:
    rows = sorted((r["lang"], r["draw"], bytes(r["windows"])) for r in training_sample(docs).collect())  # MAX_TRAIN_DOCS, or one a language
    if not rows:
        return None
    labels = sorted({lang for lang, _, _ in rows})
    place = {lang: k for k, lang in enumerate(labels)}
    xs = [np.frombuffer(x, np.uint8).reshape(-1, WINDOW) for _, _, x in rows]
    ys = [np.full(len(x), place[lang]) for (lang, _, _), x in zip(rows, xs, strict=True)]
    return ByteCnn(labels).train(np.concatenate(xs), np.concatenate(ys))


def language_id(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score, n_windows."""
    docs = docs.select("doc_id", "text", "lang")
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def rows(batches):
        model = shared.value
        for batch in batches:
            for part in slices(batch, max_bytes=1 << 20):
                x, doc = windows(*raw(part.column(2)))
                n = np.bincount(doc, minlength=part.num_rows)
                if model is None:
                    mean = np.zeros((part.num_rows, 1))
                else:
                    mean = np.add.reduceat(model.predict(x).astype(np.float64), np.cumsum(n) - n, axis=0) / n[:, None]
                best = mean.argmax(axis=1)
                some = [model is not None and t is not None and LETTER.search(t) is not None for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([model.labels[b] if ok else "und" for b, ok in zip(best, some, strict=True)], pa.string()),
                     pa.array([round(float(mean[k, b]), 6) if ok else 0.0 for k, (b, ok) in enumerate(zip(best, some, strict=True))], pa.float64()),
                     pa.array(n, pa.int64())], names=["doc_id", "held_out", "lang_pred", "score", "n_windows"])

    return docs.select("doc_id", (crc_mod(4) == 2).alias("held_out"), "text").mapInArrow(
        rows, "doc_id long, held_out boolean, lang_pred string, score double, n_windows long")


def op8(spark, sf_dir) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
