"""Analogue code graph over the driver's star schema, in Spark and as DuckDB common table expressions.

Parts play symbols (brand = file's folder and community, type = file), consecutive lines of an order
are calls, regions/nations/customers are the folder tree, and a user's events are process traces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def confidence(line):
    return F.when(line == 1, 0.95).when(line == 2, 0.9).when(line == 3, 0.5).otherwise(0.3)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, confidence: a part calls the part on the next line of an order."""
    a = t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("src"))
    b = t(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("line"), F.col("l_partkey").alias("dst"))
    return a.join(b, ["l_orderkey", "line"]).where("src != dst").groupBy("src", "dst").agg(F.max(confidence(F.col("line"))).alias("confidence"))


CALLS = """ce AS (SELECT a.l_partkey AS src, b.l_partkey AS dst,
  max(CASE a.l_linenumber WHEN 1 THEN 0.95::DOUBLE WHEN 2 THEN 0.9::DOUBLE WHEN 3 THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END) AS confidence
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  WHERE a.l_partkey <> b.l_partkey GROUP BY 1, 2)"""


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, file_path, community, label, is_exported, ord."""
    return t(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws("/", "p_brand", "p_type").alias("file_path"),
        F.col("p_brand").alias("community"), F.when(F.col("p_size") % 3 == 0, "Class").when(F.col("p_size") % 3 == 1, "Function").otherwise("Method").alias("label"),
        (F.col("p_retailprice") >= 950).alias("is_exported"), F.col("p_partkey").alias("ord"))


SYMBOLS = """sy AS (SELECT p_partkey AS id, p_name AS name, p_brand || '/' || p_type AS file_path, p_brand AS community,
  CASE p_size % 3 WHEN 0 THEN 'Class' WHEN 1 THEN 'Function' ELSE 'Method' END AS label, p_retailprice >= 950 AS is_exported, p_partkey AS ord FROM part)"""


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path of every customer below its nation and region."""
    c, n, r = t(spark, sf_dir, "customer"), t(spark, sf_dir, "nation"), t(spark, sf_dir, "region")
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.concat_ws("/", "r_name", "n_name", "c_name").alias("path"))


FOLDERS = "fo AS (SELECT r_name || '/' || n_name || '/' || c_name AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """process (user), node (event type and hour), step from 1, in order of time."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t(spark, sf_dir, "events").select(
        F.col("user_id").alias("process"), F.col("event_type").alias("node"), F.row_number().over(w).cast("long").alias("step"), "event_id")


STEPS = "st AS (SELECT user_id AS process, event_type AS node, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, event_id FROM events)"
