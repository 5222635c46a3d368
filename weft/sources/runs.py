"""Evaluation runs on disk: predictions, summaries and trajectories of a folder of runs, as one table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TRAJ = ("instance_id string, info struct<model_stats:struct<instance_cost:double,api_calls:bigint>,"
         "metrics:struct<total_tool_calls:bigint,augmentation_hits:bigint,augmentation_calls:bigint>>")
_PREDS = "map<string,struct<model_patch:string>>"


def load(spark: SparkSession, folder: str) -> DataFrame:
    """run_id, instance_id, patch, cost, api_calls, tool_calls, augment_hits, augment_calls.

    A run is a folder with preds.json (instance -> model_patch) and <instance>/<name>.traj.json files; an instance without
    a trajectory has nulls, one without a prediction no patch.
    """
    name = F.regexp_extract(F.input_file_name(), r"/([^/]+)/preds\.json$", 1)
    preds = spark.read.text(f"{folder}/*/preds.json", wholetext=True).select(name.alias("run_id"), F.from_json("value", _PREDS).alias("p"))
    preds = preds.select("run_id", F.explode("p").alias("instance_id", "v")).select("run_id", "instance_id", F.col("v.model_patch").alias("patch"))
    where = F.regexp_extract(F.input_file_name(), r"/([^/]+)/([^/]+)/[^/]+\.traj\.json$", 1)
    own = F.regexp_extract(F.input_file_name(), r"/([^/]+)/[^/]+\.traj\.json$", 1)
    traj = spark.read.schema(_TRAJ).option("multiLine", "true").option("mode", "PERMISSIVE").json(f"{folder}/*/*/*.traj.json").select(
        where.alias("run_id"), F.coalesce("instance_id", own).alias("instance_id"), F.col("info.model_stats.instance_cost").alias("cost"),
        F.col("info.model_stats.api_calls").alias("api_calls"), F.col("info.metrics.total_tool_calls").alias("tool_calls"),
        F.col("info.metrics.augmentation_hits").alias("augment_hits"), F.col("info.metrics.augmentation_calls").alias("augment_calls"))
    return preds.join(traj, ["run_id", "instance_id"], "left")
