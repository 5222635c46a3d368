"""Vectors held as arrays, and exact nearest neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product; 0 for vectors of different length, empty or null ones."""
    zero = F.lit(0.0)
    own = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), zero, lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), own).otherwise(zero)


def normalise(a: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(a, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def nearest(vectors: DataFrame, query, k: int, id_col: str = "node_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows with the largest dot product with the unit query: id_col, score; ties by id. Exact.

    Each Arrow batch is one matrix product and hands on at most k rows, so the final sort sees k rows a batch.
    """
    q = np.asarray(query, np.float64)
    norm = float(np.sqrt((q * q).sum()))
    q = q / norm if norm else q
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"))

    def best(batches):
        for batch in batches:
            v = batch.column(1)
            n = np.array([0 if x is None else x for x in pa.compute.list_value_length(v).to_pylist()], np.int64)
            score = np.zeros(batch.num_rows)
            fit = np.flatnonzero(n == len(q)) if len(q) else np.zeros(0, np.int64)
            if len(fit):
                flat = v.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False)
                score[fit] = np.nan_to_num(flat).reshape(len(fit), len(q)) @ q
            if batch.num_rows > k:
                edge = np.partition(score, -k)[-k]
                keep = np.flatnonzero(score >= edge)  # ties at the edge all go on
            else:
                keep = np.arange(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(score[keep])], names=["_id", "score"])

    kind = dict(vectors.dtypes)[id_col]
    found = rows.mapInArrow(best, f"_id {kind}, score double")
    return found.orderBy(F.desc("score"), "_id").limit(k).select(F.col("_id").alias(id_col), "score")


def within(found: DataFrame, distance: float) -> DataFrame:
    """Of the k nearest those with cosine distance under the bound: the bound comes after the k, as in an index query."""
    return found.withColumn("distance", 1 - F.col("score")).where(F.col("distance") < distance)
