"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(group | class, history) * P(word | class, group). Classes: one for
the end of a text, one for each of the SINGLES commonest words, the rest by the bytes that words
end in. The words of such a class are dealt to GROUPS groups by their hash. P(class | history) is a
softmax over hashed features of the history: the word before, the one before that (a skip), the pair of
both, and the word three back (a skip). P(group | class, history) is a softmax too, over its own features:
the word before and the one before that, each together with the class. P(word | class, group) is the
word's share of the group's add-0.1 counts, with one unseen word in each group, so the model sums to one.

What is gathered grows with the corpus: the table of word counts has a row for every different word,
and a feature is hashed into a number of rows that follows the training tokens without an upper bound, one for
TOKENS_PER_ROW and LEAST_BUCKETS at least. One worker holds up to SHARD_ROWS rows a feature (50 MB of weights).
Where more are wanted the word before deals the tokens to shards, each with SHARD_ROWS rows of its own, so that
a history only shares rows with histories of its shard. Then texts are read once, what the features need of each
token is saved by shard, and shards are fitted and scored one after the other, each by all executors: neither
the driver nor a worker ever holds more than one shard's rows. A text's score is the sum over the shards.

Training covers every training document: word counts by one aggregation; observed class and group counts
of every feature, for the first weights; then gradient updates, one for each of BATCHES parts of the training
documents, which together are all of them. In an update every task sums observed and expected counts
of its features under the model so far, and tables are added up in a tree of at most FAN rows a group.
Steps are those of iterative scaling: log(observed / expected), shrunk for rare features.

Scoring works on numpy batches. The 2^19 commonest words travel as a sorted array (a fixed size
bound); the other words of a text are looked up by a join, counted once a text.

Defined results: a null or empty text is one end token; without training documents counts are 0
and every word is unseen; rows that repeat are scored alike and all returned; a null doc_id counts
as the empty text in the split; only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, crc_mod, drop, mix64, raw, row_key, save, slices, span_hashes, table, word_bounds

ADD = 0.1
COMMON = 1 << 19
SINGLES, ENDINGS = 24, 39
CLASSES = 1 + SINGLES + ENDINGS
GROUPS = 16
FEATURES, GROUP_FEATURES = 4, 2
LEAST_BUCKETS, SHARD_ROWS, TOKENS_PER_ROW = 1 << 12, 1 << 15, 1 << 14
WIDER = 4  # rows of a group feature for one of a class feature
BATCHES = 2
STEP_SIZE, GROUP_STEP_SIZE = 2.0, 1.5
SHRINK, GROUP_SHRINK = 40.0, 20.0  # of the first weights
UPDATE_SHRINK, GROUP_UPDATE_SHRINK = 1000.0, 400.0  # of an update: a part of the corpus says little about rare features
FAN = 64
SLICE = 2 << 20  # bytes of text worked on at a time: each part costs a pass over the table of features
CHUNK = 256  # feature rows in one row of a partial table
MERGE = 4  # partitions of saved tokens read by one task: each task makes tables of its own
SLICE_TOKENS = 200_000  # saved tokens worked on at a time
ROW_GROUP = 16 << 20  # bytes of saved tokens that a reader or writer holds
STEP = 4096  # tokens worked on at a time: their probabilities stay in the cache
END = np.uint64(0x0E4D0E4D0E4D0E4D)
LOW = np.uint64(0xFFFFFFFF)  # the bits of a word's hash that features see
PACKED = 3 * 4 + 2  # bytes of a saved token before compression: three words before it, class and group
_SALT = [np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF) for k in range(FEATURES + GROUP_FEATURES + 1)]


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and leaf (ending * GROUPS + group, -1 for an end) of every token, ends included, and where each text's begin."""
    data, offsets = raw(column)
    data = LOWER[data]
    starts, ends, ptr = word_bounds(data, offsets)
    n = len(offsets) - 1
    out_ptr = ptr + np.arange(n + 1)
    total = int(out_ptr[-1])
    h, leaf = np.full(total, END), np.full(total, -1, np.int64)
    doc = np.repeat(np.arange(n), np.diff(ptr))
    at = np.arange(len(starts)) + doc
    h[at] = span_hashes(data, starts, ends)
    tail = data[ends - 1].astype(np.int64) * 256 + np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0) if len(starts) else np.zeros(0, np.int64)
    ending = mix64(tail.astype(np.uint64)) % np.uint64(ENDINGS)
    leaf[at] = (ending * np.uint64(GROUPS) + mix64(h[at] ^ _SALT[-1]) % np.uint64(GROUPS)).astype(np.int64)
    return h, leaf, out_ptr


class Classes:
    def __init__(self, singles: list[int]) -> None:
        self.hashes = np.sort(np.array(singles, np.int64).view(np.uint64))

    def of(self, h: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        out = np.where(leaf < 0, 0, 1 + SINGLES + leaf // GROUPS)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            out = np.where((self.hashes[at] == h) & (leaf >= 0), 1 + at, out)
        return out


def history(h: np.ndarray, ptr: np.ndarray, end=END) -> list[np.ndarray]:
    """The tokens one, two and three back inside the text; ends before its start."""
    n = len(h)
    place = np.arange(n) - np.repeat(ptr[:-1], np.diff(ptr))
    return [np.where(place >= k, h[np.maximum(np.arange(n) - k, 0)], end) for k in (1, 2, 3)]


def features(back: list[np.ndarray], buckets: int) -> np.ndarray:
    """FEATURES x tokens: row of each class feature that the history switches on."""
    back = [x & LOW for x in back]
    seen = (back[0], back[1], mix64(back[0] * np.uint64(3) + back[1]), back[2])
    return np.stack([(mix64(x ^ s) % np.uint64(buckets)).astype(np.int64) for x, s in zip(seen, _SALT, strict=False)])


def group_features(back: list[np.ndarray], cls: np.ndarray, buckets: int) -> np.ndarray:
    """GROUP_FEATURES x tokens: row of each group feature that history and class switch on."""
    own = cls.astype(np.uint64)
    return np.stack([(mix64(mix64((x & LOW) ^ s) + own) % np.uint64(WIDER * buckets)).astype(np.int64)
                     for x, s in zip(back[:GROUP_FEATURES], _SALT[FEATURES:], strict=False)])


def buckets_for(total: int) -> int:
    """Rows of one class feature in all shards: a power of two that follows the number of training tokens."""
    wanted = max(1, total // TOKENS_PER_ROW)
    return max(LEAST_BUCKETS, 1 << (wanted - 1).bit_length())


def shards_for(total: int) -> int:
    """Shards of SHARD_ROWS rows that hold them; one where a worker can hold them all."""
    return max(1, buckets_for(total) // SHARD_ROWS)


def shard_of(before: np.ndarray, shards: int) -> np.ndarray:
    """The shard of tokens with these words before them."""
    return (mix64((before & LOW) ^ _SALT[-1]) % np.uint64(shards)).astype(np.int64)


def blank(buckets: int, kind=np.float32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A table for all features: whole, as class rows (FEATURES x buckets x CLASSES) and as group rows (GROUP_FEATURES x ... x GROUPS)."""
    first = FEATURES * buckets * CLASSES
    whole = np.zeros(first + GROUP_FEATURES * WIDER * buckets * GROUPS, kind)
    return whole, whole[:first].reshape(FEATURES, buckets, CLASSES), whole[first:].reshape(GROUP_FEATURES, WIDER * buckets, GROUPS)


class Model:
    def __init__(self, classes: Classes, total: int, words: np.ndarray, kinds: np.ndarray, buckets: int = LEAST_BUCKETS) -> None:
        """total: training tokens; words, kinds: training tokens and different tokens of each class and group."""
        self.classes, self.total, self.kinds, self.buckets = classes, total, int(kinds.sum()), buckets
        self.mass = words + ADD * (kinds + 1)  # each group also holds an unseen word
        self.mass[: 1 + SINGLES, 1:] = 0  # classes of one word have one group
        own = self.mass.sum(axis=1)
        self.bias = np.log(own / own.sum()).astype(np.float32)
        self.group_bias = np.log(self.mass[1 + SINGLES :] / own[1 + SINGLES :, None]).astype(np.float32)
        self.clear()

    def clear(self) -> None:
        """Weights as before the training."""
        self.whole, self.weights, self.group_weights = blank(self.buckets)
        self.history: list[float] = []  # log10 a token of each batch, before its update

    def __setstate__(self, state) -> None:
        self.__dict__.update(state)
        first = FEATURES * self.buckets * CLASSES
        self.weights, self.group_weights = self.whole[:first].reshape(FEATURES, self.buckets, CLASSES), self.whole[first:].reshape(GROUP_FEATURES, -1, GROUPS)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("weights", "group_weights")}

    def spread(self, f: np.ndarray, out: np.ndarray, spare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unscaled class probabilities of tokens with features f, and their sums; in `out`, overwriting `spare`."""
        z, more = out[: f.shape[1]], spare[: f.shape[1]]
        np.take(self.weights[0], f[0], axis=0, out=z, mode="clip")
        for own, row in zip(self.weights[1:], f[1:], strict=True):
            np.take(own, row, axis=0, out=more, mode="clip")
            z += more
        z += self.bias
        np.clip(z, -80, 80, out=z)
        np.exp(z, out=z)
        return z, z.sum(axis=1)

    def group_spread(self, f: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Group probabilities of tokens of classes with several words."""
        z = self.group_bias[cls - 1 - SINGLES]
        for own, row in zip(self.group_weights, f, strict=True):
            z += np.take(own, row, axis=0, mode="clip")
        np.clip(z, -80, 80, out=z)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z

    def log10(self, back, cls, group) -> np.ndarray:
        """Of every token: log10 of P(class | history) * P(group | class, history) / mass of the group."""
        out = np.zeros(len(cls))
        f = features(back, self.buckets)
        a, b = buffers()
        for lo in range(0, len(cls), STEP):
            own = slice(lo, lo + STEP)
            p, total = self.spread(f[:, own], a, b)
            out[own] = np.log(p[np.arange(len(p)), cls[own]] / total)
        many = np.flatnonzero(cls > SINGLES)
        cls_many, group = cls[many], group[many]
        f = group_features([x[many] for x in back], cls_many, self.buckets)
        for lo in range(0, len(many), STEP):
            own = slice(lo, lo + STEP)
            p = self.group_spread(f[:, own], cls_many[own])
            out[many[own]] += np.log(p[np.arange(len(p)), group[own]])
        mass = self.mass[cls, 0]
        mass[many] = self.mass[cls_many, group]
        return (out - np.log(mass)) / np.log(10)


def buffers() -> tuple[np.ndarray, np.ndarray]:
    return np.empty((STEP, CLASSES), np.float32), np.empty((STEP, CLASSES), np.float32)


def add_rows(table: np.ndarray, ids: np.ndarray, rows: np.ndarray, spare: np.ndarray) -> None:
    """table[ids] += rows, for ids that repeat: sorted, then the first, second, ... row of every id, long runs at once."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    rows = np.take(rows, order, axis=0, out=spare[: len(ids)], mode="clip")
    start = np.flatnonzero(np.concatenate((np.ones(1, bool), ids[1:] != ids[:-1])))
    run = np.diff(np.append(start, len(ids)))
    sums = rows[start]
    for r in range(1, 6):
        more = np.flatnonzero(run > r)
        sums[more] += rows[start[more] + r]
    for k in np.flatnonzero(run > 6):
        sums[k] += rows[start[k] + 6 : start[k] + run[k]].sum(axis=0)
    table[ids[start]] += sums


def _counts(batches):
    held, size = [], 0

    def flush():
        h, e, n = (np.concatenate([x[k] for x in held]) for k in range(3))
        u, first, inv = np.unique(h, return_index=True, return_inverse=True)
        return u, e[first], np.bincount(inv, n).astype(np.int64)

    def batch_of(u, e, n):
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(e.astype(np.int32)), pa.array(n)], names=["h", "leaf", "n"])

    for batch in batches:
        for part in slices(batch, max_bytes=SLICE):
            h, e, _ = tokens(part.column(0))
            u, first, n = np.unique(h, return_index=True, return_counts=True)
            held.append((u, e[first], n))
            size += len(u)
            if size > 1_000_000:
                held = [flush()]
                size = len(held[0][0])
                if size > 700_000:
                    yield batch_of(*held[0])
                    held, size = [], 0
    if held:
        yield batch_of(*flush())


def _packed(*tables: np.ndarray):
    """Rows of CHUNK x CLASSES numbers, of one table after the other, with 12 bits of mantissa."""
    part, width = TaskContext.get().partitionId(), CHUNK * CLASSES
    for k, whole in enumerate(tables):
        bits = np.ascontiguousarray(whole, np.float32).view(np.uint32)
        for start in range(0, len(bits), 64 * width):
            rows, at = [], []
            for lo in range(start, min(len(bits), start + 64 * width), width):
                short = (bits[lo : lo + width] + np.uint32(0x400)) & np.uint32(0xFFFFF800)
                if short.any():
                    rows.append(zstandard.compress(short.tobytes(), 1))
                    at.append(k * len(bits) + lo)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part, np.int64)), pa.array(at, pa.int64()), pa.array(rows, pa.binary())], names=["part", "chunk", "table"])


def _of_texts(classes: Classes, batches):
    """Of the tokens of a slice of texts: the three words before each, class and group."""
    for batch in batches:
        for part in slices(batch, max_bytes=SLICE):
            h, leaf, ptr = tokens(part.column(0))
            yield history(h, ptr), classes.of(h, leaf), leaf % GROUPS


def _pack(words, back, cls, group) -> bytes:
    """Tokens by their words' numbers in `words`: the bytes of the same weight together, class, group, and the words that occur."""
    used = np.zeros(len(words), bool)
    for x in back:
        used[x] = True
    number = (np.cumsum(used) - 1).astype(np.uint32)
    ids = np.stack([number[x] for x in back]).view(np.uint8).reshape(3, -1, 4).transpose(0, 2, 1)
    return zstandard.compress(b"".join([ids.tobytes(), cls.astype(np.uint8).tobytes(), group.astype(np.uint8).tobytes(), words[used].tobytes()]), 1)


def _unpack(sizes: list[int], rows: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    back, cls, group = [], [], []
    for n, row in zip(sizes, rows, strict=True):
        data = zstandard.decompress(row)
        x = np.frombuffer(data, np.uint8)
        ids = np.ascontiguousarray(x[: 12 * n].reshape(3, 4, n).transpose(0, 2, 1)).view(np.uint32)[:, :, 0]
        back.append(np.frombuffer(data, np.uint32, offset=PACKED * n)[ids])
        cls.append(x[12 * n : 13 * n])
        group.append(x[13 * n : 14 * n])
    return list(np.concatenate(back, axis=1).astype(np.uint64)), np.concatenate(cls).astype(np.int64), np.concatenate(group).astype(np.int64)


def _gathered(batches):
    """The saved rows of about SLICE_TOKENS tokens at a time, as lists by column."""
    held, size = [], 0
    for batch in batches:
        for k in range(batch.num_rows):
            row = [c[k].as_py() for c in batch.columns]
            held.append(row)
            size += row[0]
            if size >= SLICE_TOKENS:
                yield [list(c) for c in zip(*held, strict=True)]
                held, size = [], 0
    if held:
        yield [list(c) for c in zip(*held, strict=True)]


def _of_saved(classes: Classes, batches):
    """As _of_texts, of saved tokens: their number, and them."""
    for sizes, data in _gathered(batches):
        yield _unpack(sizes, data)


def _add_observed(class_rows, group_rows, f, cls, g, many, group) -> None:
    for own, row in zip(class_rows, f, strict=True):
        own += np.bincount(row * CLASSES + cls, minlength=own.size).reshape(own.shape)
    for own, row in zip(group_rows, g, strict=True):
        own += np.bincount(row * GROUPS + group[many], minlength=own.size).reshape(own.shape)


def _observed(shared, read):
    """Class and group counts of every feature."""
    def rows(batches):
        model = shared.value
        seen, class_rows, group_rows = blank(model.buckets)
        for back, cls, group in read(model.classes, batches):
            many = np.flatnonzero(cls > SINGLES)
            _add_observed(class_rows, group_rows, features(back, model.buckets), cls, group_features([x[many] for x in back], cls[many], model.buckets), many, group)
        yield from _packed(seen)

    return rows


def _compared(shared, read):
    """Observed counts of every feature, those that the model expects, and the model's log10 with the number of tokens."""
    def rows(batches):
        model = shared.value
        seen, seen_rows, seen_groups = blank(model.buckets)
        want, want_rows, want_groups = blank(model.buckets)
        a, b = buffers()
        told = np.zeros(2)
        for back, cls, group in read(model.classes, batches):
            many = np.flatnonzero(cls > SINGLES)
            f, g = features(back, model.buckets), group_features([x[many] for x in back], cls[many], model.buckets)
            _add_observed(seen_rows, seen_groups, f, cls, g, many, group)
            near, short = np.zeros(want_rows.shape, np.float32), f.astype(np.uint16)  # short ids sort faster
            for lo in range(0, len(cls), STEP):
                own = slice(lo, lo + STEP)
                p, total = model.spread(f[:, own], a, b)
                p /= total[:, None]
                told[0] += np.log10(np.maximum(p[np.arange(len(p)), cls[own]], 1e-30)).sum()
                for table_rows, row in zip(near, short[:, own], strict=True):
                    add_rows(table_rows, row, p, b)
            want_rows += near
            p = model.group_spread(g, cls[many])
            told += [np.log10(np.maximum(p[np.arange(len(p)), group[many]], 1e-30)).sum(), len(cls)]
            for own, row in zip(want_groups, g, strict=True):
                for k in range(GROUPS):
                    own[:, k] += np.bincount(row, p[:, k], minlength=len(own))
        extra = np.zeros(CHUNK * CLASSES, np.float32)
        extra[:2] = told
        yield from _packed(seen, want)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([2 * len(seen)], pa.int64()),
                                          pa.array([zstandard.compress(extra.tobytes(), 1)], pa.binary())], names=["part", "chunk", "table"])

    return rows


def _added(rows):
    """Sum of at most FAN partial tables."""
    parts = [np.frombuffer(zstandard.decompress(t), np.float32).astype(np.float64) for t in rows.column("table").to_pylist()]
    return pa.table({"part": pa.array([rows.column("part")[0].as_py() // FAN], pa.int64()), "chunk": rows.column("chunk").slice(0, 1),
                     "table": pa.array([zstandard.compress(sum(parts).astype(np.float32).tobytes(), 1)], pa.binary())})


def _totals(training: DataFrame, rows, size: int) -> np.ndarray:
    """Sum of the tables that `rows` makes of each partition, in a tree; the result has the size of one task's tables."""
    schema = "part long, chunk long, table binary"
    parts = training.rdd.getNumPartitions()
    found = training.mapInArrow(rows, schema)
    while True:
        found = found.withColumn("group", F.col("part").cast("long") - F.col("part") % FAN).groupBy("chunk", "group").applyInArrow(_added, schema)
        parts = -(-parts // FAN)
        if parts <= 1:
            break
    out = np.zeros(size + CHUNK * CLASSES, np.float32)
    for r in found.collect():  # one row a chunk
        own = np.frombuffer(zstandard.decompress(r["table"]), np.float32)
        out[r["chunk"] : r["chunk"] + len(own)] += own
    return out


def _fit(model: Model, training: DataFrame, read=_of_texts) -> None:
    """training: batch, and the columns of which `read` makes tokens."""
    send = training.sparkSession.sparkContext.broadcast
    size, first = len(model.whole), model.weights.size
    shape, group_shape = model.weights.shape, model.group_weights.shape
    prior = (SHRINK * np.exp(model.bias)).astype(np.float32)
    even = (model.mass[1 + SINGLES :].sum(axis=0) / model.mass[1 + SINGLES :].sum()).astype(np.float32)  # groups over all classes
    group_prior = GROUP_SHRINK * even

    def split(flat):
        return flat[:first].reshape(shape), flat[first:size].reshape(group_shape)

    shared = send(model)
    seen, groups = split(_totals(training.drop("batch"), _observed(shared, read), size))
    shared.destroy()
    want = seen.sum(axis=-1, keepdims=True) * np.exp(model.bias)
    model.weights += np.log((seen + prior) / (want + prior)) * np.float32(2.0 / FEATURES)
    want = groups.sum(axis=-1, keepdims=True) * even
    model.group_weights += np.log((groups + group_prior) / (want + group_prior)) * np.float32(1.5 / GROUP_FEATURES)
    for k in range(BATCHES):
        shared = send(model)
        found = _totals(training.where(F.col("batch") == k).drop("batch"), _compared(shared, read), 2 * size)
        shared.destroy()
        told, n = found[2 * size : 2 * size + 2]
        if not n:
            continue
        model.history.append(float(told / n))
        (seen, groups), (want, want_groups) = split(found[:size]), split(found[size : 2 * size])
        some, group_some = (UPDATE_SHRINK / BATCHES * np.exp(model.bias)).astype(np.float32), GROUP_UPDATE_SHRINK / BATCHES * even
        model.weights += np.log((seen + some) / (want + some)) * np.float32(STEP_SIZE / FEATURES)
        model.group_weights += np.log((groups + group_some) / (want_groups + group_some)) * np.float32(GROUP_STEP_SIZE / GROUP_FEATURES)


def _batch():
    return F.pmod(F.xxhash64("doc_id", "text", F.lit("batch")), F.lit(BATCHES))


def untrained(docs: DataFrame) -> tuple[Model, DataFrame]:
    """A model that knows the counts alone, with the rows of one shard, and the table of training counts (h, leaf, n)."""
    training = docs.where(crc_mod(10) != 0)
    counts = save(training.select("text").mapInArrow(_counts, "h long, leaf int, n long").groupBy("h").agg(F.min("leaf").alias("leaf"), F.sum("n").alias("n")), "counts")
    top = counts.where("leaf >= 0").orderBy(F.desc("n"), "h").limit(SINGLES).collect()
    classes = Classes([r["h"] for r in top])
    words, kinds = np.zeros((CLASSES, GROUPS)), np.zeros((CLASSES, GROUPS))
    single = F.col("h").isin([r["h"] for r in top]) if top else F.lit(False)
    for r in counts.where(~single).groupBy("leaf").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        at = (0, 0) if r["leaf"] < 0 else (1 + SINGLES + r["leaf"] // GROUPS, r["leaf"] % GROUPS)
        words[at], kinds[at] = r["n"], r["v"]
    order = {int(h): k for k, h in enumerate(classes.hashes.view(np.int64))}
    for r in top:
        words[1 + order[r["h"]], 0], kinds[1 + order[r["h"]], 0] = r["n"], 1
    total = int(words.sum())
    return Model(classes, total, words, kinds, buckets_for(total) // shards_for(total)), counts


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of a corpus with one shard, and the table of training counts."""
    model, counts = untrained(docs)
    _fit_texts(model, docs)
    return model, counts


def _fit_texts(model: Model, docs: DataFrame) -> None:
    if model.total:
        _fit(model, docs.where(crc_mod(10) != 0).select("text", _batch().alias("batch")))


def _dealt(classes: Classes, shards: int):
    """Rows of tokens of a slice that share shard and batch: their texts' keys, tokens of each, and the tokens."""
    def rows(batches):
        boxes = np.arange(shards * (BATCHES + 1) + 1)
        for batch in batches:
            for part in slices(batch, max_bytes=SLICE):
                h, leaf, ptr = tokens(part.column(2))
                keys, own_batch = part.column(0).to_numpy(), part.column(1).to_numpy()
                cls, group = classes.of(h, leaf), leaf % GROUPS
                words, number, n = np.unique(h & LOW, return_inverse=True, return_counts=True)
                common = np.argsort(-n, kind="stable")  # small numbers for common words: they compress better
                words, rank = words[common], np.empty(len(words), np.int64)
                rank[common] = np.arange(len(words))
                number = rank[number]
                back = history(number, ptr, number[ptr[1] - 1])
                doc = np.repeat(np.arange(part.num_rows), np.diff(ptr))
                box = shard_of(words, shards)[back[0]] * (BATCHES + 1) + own_batch[doc]
                words = words.astype(np.uint32)
                order = np.argsort(box, kind="stable")  # texts stay in order inside a box
                cut = np.searchsorted(box[order], boxes)
                out = []
                for k in np.flatnonzero(np.diff(cut)):
                    own = order[cut[k] : cut[k + 1]]
                    docs, n = np.unique(doc[own], return_counts=True)
                    out.append((k // (BATCHES + 1), k % (BATCHES + 1), len(own), _pack(words, [x[own] for x in back], cls[own], group[own]), keys[docs].tobytes(), n.astype(np.int32).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)],
                                                 names=["shard", "batch", "n", "data", "keys", "times"])

    return rows


def _fits(shared):
    """Of every text of saved tokens: their number and the log10 that the model gives them."""
    def rows(batches):
        model = shared.value
        for sizes, data, keys, times in _gathered(batches):
            fit = model.log10(*_unpack(sizes, data))
            key, n = np.frombuffer(b"".join(keys), np.int64), np.frombuffer(b"".join(times), np.int32).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(np.add.reduceat(fit, np.cumsum(n) - n))], names=["key", "places", "fit"])

    return rows


def shard_models(docs: DataFrame, model: Model, shards: int):
    """For each shard in turn: its saved tokens (n, data, keys, times), and the model as trained on those of its training documents."""
    batch = F.when(crc_mod(10) != 0, _batch()).otherwise(F.lit(BATCHES)).cast("long")
    dealt = save(docs.select(row_key().alias("key"), batch.alias("batch"), "text").mapInArrow(
        _dealt(model.classes, shards), "shard int, batch long, n long, data binary, keys binary, times binary"), "dealt", "shard", row_group=ROW_GROUP)
    for k in range(shards):
        own = dealt.where(F.col("shard") == k).drop("shard")
        own = own.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, own.rdd.getNumPartitions() // MERGE))
        model.clear()
        _fit(model, own.where(F.col("batch") < BATCHES).select("batch", "n", "data"), _of_saved)
        yield own.select("n", "data", "keys", "times"), model
    drop(dealt)


def _sharded_fits(docs: DataFrame, model: Model, shards: int) -> DataFrame:
    """key, places, fit: of every text, its tokens and their log10 summed over the shards, once for each row of that key."""
    saved = []
    for own, trained in shard_models(docs, model, shards):
        shared = docs.sparkSession.sparkContext.broadcast(trained)
        saved.append(save(own.mapInArrow(_fits(shared), "key long, places long, fit double"), "fits"))
        shared.destroy()
    whole = docs.sparkSession.read.schema(saved[0].schema).parquet(*(x._weft_path for x in saved))
    return whole.groupBy("key").agg(F.sum("places").alias("places"), F.sum("fit").alias("fit_all"))


def _score(shared, common):
    """shared: the model, or None where its part is summed over shards."""
    def rows(batches):
        model, (known, count) = shared and shared.value, common.value
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for own in slices(batch, max_bytes=SLICE):
                h, e, ptr = tokens(own.column(3))
                fit = model.log10(history(h, ptr), model.classes.of(h, e), e % GROUPS) if model else np.zeros(len(h))
                doc = np.repeat(np.arange(own.num_rows), np.diff(ptr))
                at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                hit = known[at] == h if len(known) else np.zeros(len(h), bool)
                weight = np.where(hit, np.log10((count[at] if len(known) else 0) + ADD), 0)
                n = own.num_rows
                sums = [np.bincount(doc, x, minlength=n) for x in (fit, weight, hit)]
                rare = np.flatnonzero(~hit)
                order = np.lexsort((h[rare], doc[rare]))
                rd, rh = doc[rare][order], h[rare][order]
                new = np.ones(len(rd), bool)
                new[1:] = (rd[1:] != rd[:-1]) | (rh[1:] != rh[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(rd)))
                cut = np.searchsorted(rd[first], np.arange(n + 1)).astype(np.int32)
                struct = pa.StructArray.from_arrays([pa.array(rh[first].view(np.int64)), pa.array(times.astype(np.int32))], names=["h", "n"])
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), own.column(2), pa.array((np.int64(part) << 33) + row + np.arange(n)), pa.array(np.diff(ptr)), pa.array(sums[0]),
                     pa.array(sums[1]), pa.array(sums[2].astype(np.int64)), pa.ListArray.from_arrays(pa.array(cut), struct)],
                    names=["doc_id", "held_out", "key", "uid", "n_tokens", "fit", "weight", "hits", "rare"])
                row += n

    return rows


def score(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    model, counts = untrained(docs)
    shards = shards_for(model.total)
    if shards > 1:
        fits = _sharded_fits(docs, model, shards)
    else:
        _fit_texts(model, docs)
    top = counts.orderBy(F.desc("n"), "h").limit(COMMON).select("h", "n").toArrow()
    known, count = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(known)
    common = spark.sparkContext.broadcast((known[order], count[order]))
    rows = save(docs.select("doc_id", (crc_mod(10) == 0).alias("held_out"), row_key().alias("key"), "text").mapInArrow(
        _score(spark.sparkContext.broadcast(model) if shards == 1 else None, common),
        "doc_id long, held_out boolean, key long, uid long, n_tokens long, fit double, weight double, hits long, rare array<struct<h:long,n:int>>"), "scores")
    rare = rows.select("uid", F.explode("rare").alias("r")).select("uid", "r.h", F.col("r.n").alias("times"))
    left = counts.select("h", "n") if len(known) >= COMMON else counts.select("h", "n").limit(0)
    found = rare.join(left, "h").groupBy("uid").agg(F.sum(F.col("times") * F.log10(F.col("n") + ADD)).alias("more"), F.sum("times").alias("hits_more"),
                                                   F.sum(F.col("times") * F.log10(F.lit(ADD))).alias("instead"))
    out = rows.drop("rare").join(found, "uid", "left")
    if shards > 1:  # rows that agree share a key, and so an equal part of its sum
        out = out.join(fits, "key", "left").withColumn("fit", F.col("fit_all") * F.col("n_tokens") / F.col("places"))
    unseen = F.col("n_tokens") - F.col("hits")
    weight = F.col("weight") + unseen * F.log10(F.lit(ADD)) + F.coalesce(F.col("more") - F.col("instead"), F.lit(0.0))
    space = float(np.log10(model.total + ADD * (model.kinds + 1)))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("hits") + F.coalesce("hits_more", F.lit(0))).alias("n_known"),
                      F.lit(model.total).cast("long").alias("train_tokens"), F.round(weight - F.col("n_tokens") * F.lit(space), 6).alias("base_score"),
                      F.round(weight + F.col("fit"), 6).alias("score"))


def op4(spark, sf_dir) -> DataFrame:
    return score(table(spark, sf_dir, "documents", "doc_id", "text"))
