"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree.

Each source is cut into blocks by a keyed hash of its rows, so block order is a keyed random
permutation of the source. A source's target says how many whole passes over it the mix takes
and which share of one more; the last pass takes whole blocks in permuted order and, of the
block at the edge, the rows up to the hash that comes nearest to the target. All block slots
(source, block, pass) are then dealt to the output shards: from the root down, each node splits
its exact quotas per source between its halves by a multivariate-hypergeometric draw, and each
leaf takes the next blocks of every source's permuted list, so shards are disjoint. Inside a
shard rows are ordered by a keyed hash.

Only per-source totals and per-block sums reach the driver. Blocks hold at least 1/65536 of all
words, so there are at most 65,536 blocks plus one a source, and three slots a block.

Defined results: a null source is a source of its own, last in order; a null or empty text has
size 0, and a source without words has target 0 (its rows come along with full passes of 0
words); rows equal in doc_id and text are drawn alike; an empty table gives an empty mix; other
columns pass through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.session import materialise

from .common import raw, row_key, slices, table, word_bounds

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
MAX_BLOCKS = 65_536
BLOCK_WORDS = 1 << 16
SHARD_WORDS = 1 << 22
SEED = 20_241


def _count(batches):
    for batch in batches:
        for part in slices(batch):
            ptr = word_bounds(*raw(part.column(2)))[2]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(ptr), pa.int64()), part.column(3)],
                                             names=["doc_id", "source", "size", "_weft_key"])


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, words of the text and row key, without the text."""
    return docs.select("doc_id", "source", "text", row_key().alias("_weft_key")).mapInArrow(
        _count, "doc_id long, source string, size long, _weft_key long")


def targets(sizes: list[int], weights: list[int]) -> list[float]:
    """Share all sizes by weight; no target exceeds three times its source's size, the rest is shared again."""
    out, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s], float(sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > MOST_PASSES * sizes[i]]
        if not over:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = float(MOST_PASSES * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in over]
    return out


def split_tree(quotas: np.ndarray, capacity: np.ndarray, seed: int) -> np.ndarray:
    """Deal quotas (by source) to leaves of given capacity (same total): rows are leaves, columns sources."""
    out = np.zeros((len(capacity), len(quotas)), np.int64)
    todo = [(0, len(capacity), np.asarray(quotas, np.int64))]
    while todo:
        lo, hi, own = todo.pop()
        if hi - lo == 1:
            out[lo] = own
            continue
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(own, int(capacity[lo:mid].sum()), method="marginals")
        todo += [(lo, mid, left), (mid, hi, own - left)]
    return out


def _place(bits: Column, n: Column) -> Column:
    """Uniform number below n from a 64-bit hash."""
    return F.shiftright(F.shiftrightunsigned(bits, 33) * n, 31)


class Mix:
    """The plan of a mix over a table of sizes; `place` puts it on any frame with the rows' source and key."""

    def __init__(self, rows: DataFrame, seed: int = SEED) -> None:
        self.spark, self.seed = rows.sparkSession, seed
        totals = rows.groupBy("source").agg(F.sum("size").alias("n")).collect()  # one row a source
        totals.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
        self.names = [r["source"] for r in totals]
        self.sizes = [int(r["n"]) for r in totals]
        self.targets = targets(self.sizes, [WEIGHTS[i % 3] for i in range(len(totals))])
        per_block = max(BLOCK_WORDS, math.ceil(sum(self.sizes) / MAX_BLOCKS))
        self.blocks = [max(1, s // per_block) for s in self.sizes]
        self._sources = self.spark.createDataFrame(
            [(n, i, b, s, t) for i, (n, b, s, t) in enumerate(zip(self.names, self.blocks, self.sizes, self.targets, strict=True))],
            "_weft_source string, _weft_s int, _weft_blocks long, _weft_source_size long, _weft_target double")
        keyed = self._blocked(rows)
        sums = keyed.groupBy("_weft_s", "_weft_block").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()
        self._plan(keyed, sums)

    def _blocked(self, rows: DataFrame) -> DataFrame:
        out = rows.join(F.broadcast(self._sources), F.col("source").eqNullSafe(F.col("_weft_source")), "left").drop("_weft_source")
        place = F.xxhash64("_weft_key", F.lit(self.seed))
        return out.withColumn("_weft_block", _place(place, F.col("_weft_blocks")))

    def _plan(self, keyed: DataFrame, sums) -> None:
        words = [dict() for _ in self.names]
        for r in sums:
            words[r["_weft_s"]][r["_weft_block"]] = int(r["n"])
        slots, edges = [], {}
        for s, own in enumerate(words):
            size, target = self.sizes[s], self.targets[s]
            full = min(MOST_PASSES, int(target // size)) if size else 0
            rest = target - full * size
            lists = [(b, e, False) for e in range(full) for b in self._shuffled(own, s, e)]
            for b in self._shuffled(own, s, full) if full < MOST_PASSES and rest > 0 else ():
                if own[b] <= rest:
                    lists.append((b, full, False))
                    rest -= own[b]
                else:
                    lists.append((b, full, True))
                    edges[s] = (b, rest)
                    break
            slots.append(lists)
        cut = self._edge(keyed, edges)
        quotas = np.array([len(x) for x in slots], np.int64)
        total = int(quotas.sum())
        shards = max(1, min(total, round(sum(self.targets) / SHARD_WORDS)))
        self.shards = shards
        capacity = np.full(shards, total // shards) + (np.arange(shards) < total % shards)
        dealt = split_tree(quotas, capacity, self.seed) if total else np.zeros((1, len(quotas)), np.int64)
        rows = []
        for s, own in enumerate(slots):
            order = np.random.default_rng([self.seed, s, 7]).permutation(len(own))
            leaf = np.repeat(np.arange(shards), dealt[:, s])
            rows += [(s, own[k][0], own[k][1], int(shard), cut.get(s, -(1 << 63)) if own[k][2] else None) for k, shard in zip(order, leaf, strict=True)]
        slot_rows = self.spark.createDataFrame(rows, "_weft_s int, _weft_block long, epoch int, shard int, cut long")
        self._slots = slot_rows.groupBy("_weft_s", "_weft_block").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard", "cut"))).alias("_weft_dealt"))

    def _shuffled(self, own: dict, s: int, epoch: int) -> list[int]:
        blocks = sorted(own)
        return [blocks[k] for k in np.random.default_rng([self.seed, s, epoch, 1]).permutation(len(blocks))]

    def _edge(self, keyed: DataFrame, edges) -> dict[int, int]:
        """For the block at a source's edge, the hash up to which its rows are taken (one block a source)."""
        if not edges:
            return {}
        want = self.spark.createDataFrame([(s, b, float(r)) for s, (b, r) in edges.items()], "_weft_s int, _weft_block long, _weft_rest double")
        rows = keyed.join(F.broadcast(want), ["_weft_s", "_weft_block"]).select("_weft_s", "_weft_rest", self._inner().alias("h"), "size")
        by_hash = rows.groupBy("_weft_s", "_weft_rest", "h").agg(F.sum("size").alias("size"))  # repeated rows share a hash
        from pyspark.sql import Window

        upto = Window.partitionBy("_weft_s").orderBy("h")
        taken = by_hash.withColumn("sum", F.sum("size").over(upto)).where(F.col("sum") - F.col("size") / 2 <= F.col("_weft_rest"))
        return {r["_weft_s"]: r["h"] for r in taken.groupBy("_weft_s").agg(F.max("h").alias("h")).collect()}

    def _inner(self) -> Column:
        return F.xxhash64("_weft_key", F.lit(self.seed), F.lit("edge"))

    def place(self, rows: DataFrame) -> DataFrame:
        """Adds _weft_source_size, _weft_target and _weft_slots, an array of (epoch, shard): one entry for each time the mix takes the row."""
        out = self._blocked(rows).join(F.broadcast(self._slots), ["_weft_s", "_weft_block"], "left")
        h = self._inner()
        kept = F.filter("_weft_dealt", lambda d: d["cut"].isNull() | (h <= d["cut"]))
        slots = F.transform(kept, lambda d: F.struct(d["epoch"].alias("epoch"), d["shard"].alias("shard")))
        empty = F.array().cast("array<struct<epoch:int,shard:int>>")
        return out.withColumn("_weft_slots", F.coalesce(slots, empty)).drop("_weft_s", "_weft_block", "_weft_blocks", "_weft_dealt")


def mix_rows(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken, copies, shards."""
    rows = materialise(sized(docs))
    return Mix(rows).place(rows).select(
        "doc_id", "source", "size", F.col("_weft_source_size").alias("source_size"), F.col("_weft_target").alias("target"),
        (F.col("size") * F.size("_weft_slots")).alias("taken"), F.size("_weft_slots").cast("long").alias("copies"),
        F.array_join(F.transform("_weft_slots", lambda s: s["shard"]), ",").alias("shards"))


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: the documents, columns as given, each as often as it is taken, dealt to shards and shuffled inside them."""
    names = docs.columns
    plan = Mix(materialise(sized(docs)))
    rows = plan.place(docs.select(*[F.col(f"`{c}`") for c in names], row_key().alias("_weft_key")))
    rows = rows.select(*[F.col(f"`{c}`") for c in names], "_weft_key", F.explode("_weft_slots").alias("_weft_slot"))
    spread = F.xxhash64("_weft_slot", "_weft_key", F.lit(plan.seed))
    return (rows.withColumn("_weft_order", spread).repartition(F.col("_weft_slot.shard"))
            .sortWithinPartitions("_weft_slot.shard", "_weft_order").select(*[F.col(f"`{c}`") for c in names]))


def op3(spark, sf_dir) -> DataFrame:
    return mix_rows(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
