"""A full-text index kept up to date from a stream of changed files.

Each micro-batch replaces the postings of the files it holds, as one versioned table change: the index is
partitioned by a hash of the path, only partitions with changed files are written again, and a batch that runs a
second time after a failure leaves the same state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.text import words

BUCKETS = 64
SCHEMA = "path string, term string, tf long, length int, bucket int"


def postings_of(files: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """files: path, content; the last row of a path in `ord` counts. path, term, tf, length, bucket; a deleted file (null content) gives nothing."""
    rows = files
    if "ord" in files.columns:
        rows = files.groupBy("path").agg(F.max_by("content", "ord").alias("content"))
    own = rows.where("content is not null").select("path", words(F.col("content")).alias("w"))
    out = own.select("path", F.size("w").alias("length"), F.explode("w").alias("term")).groupBy("path", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    return out.withColumn("bucket", F.pmod(F.hash("path"), F.lit(buckets)).cast("int")).select("path", "term", "tf", "length", "bucket")


def apply_batch(spark: SparkSession, folder: str, files: DataFrame, batch: int, buckets: int = BUCKETS) -> None:
    """Replace the postings of the batch's files. Buckets are written to a folder of this batch and listed by one small table."""
    from weft.session import materialise

    files = materialise(files)
    touched = [r["b"] for r in files.select(F.pmod(F.hash("path"), F.lit(buckets)).cast("int").alias("b")).distinct().collect()]  # at most `buckets`
    if not touched:
        return
    old = read_index(spark, folder, batch)
    kept = old.where(F.col("bucket").isin(touched)).join(files.select("path").distinct(), "path", "left_anti")
    new = kept.unionByName(postings_of(files, buckets))
    new.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/batch={batch}")
    listed = spark.createDataFrame([(int(b), int(batch)) for b in touched], "bucket int, batch long")
    listed.coalesce(1).write.mode("overwrite").parquet(f"{folder}/log/batch={batch}")


def read_index(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The index as the last finished batch (before the given one) left it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/log")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], SCHEMA)
    log = spark.read.option("basePath", f"{folder}/log").schema("bucket int, batch long").parquet(f"{folder}/log")
    if before is not None:
        log = log.where(F.col("batch") < before)
    last = {r["bucket"]: r["b"] for r in log.groupBy("bucket").agg(F.max("batch").alias("b")).collect()}  # at most one row a bucket
    out = spark.createDataFrame([], SCHEMA)
    by_batch: dict[int, list[int]] = {}
    for bucket, batch in last.items():
        by_batch.setdefault(batch, []).append(bucket)
    for batch, own in sorted(by_batch.items()):
        part = spark.read.schema(SCHEMA).parquet(f"{folder}/batch={batch}").where(F.col("bucket").isin(own))
        out = out.unionByName(part)
    return out


def index_stream(changes: DataFrame, folder: str, checkpoint: str, once: bool = True):
    """Start the index over a stream of path, content (and ord)."""
    writer = changes.writeStream.foreachBatch(lambda frame, batch: apply_batch(frame.sparkSession, folder, frame, batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
