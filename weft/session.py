"""Session helpers: nothing here overrides what a cluster has already configured."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "weft") -> SparkSession:
    """A local session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir as the cluster set it,
    or a temporary one where it is unset and driver and executors are one process."""
    have = spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        jsc_dir = spark.sparkContext.getCheckpointDir()
        have = jsc_dir.rsplit("/", 1)[0] if jsc_dir else None
    if not have:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        have = "file://" + tempfile.mkdtemp(prefix="weft-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(have)
    return have.rstrip("/")


def materialise(df):
    """checkpoint() into the shared folder: cuts lineage and survives a lost executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
