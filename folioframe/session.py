"""Session settings shared by the entry point, the tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, app: str = "folioframe") -> SparkSession:
    """A local session; on a cluster the submitter's session is used instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cores))
        # Small test inputs still use every core; folds cost more time per byte than plain operators.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a private one only where a local session names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None and spark.sparkContext.master.startswith("local"):
        shared = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", shared)
    if shared is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return shared


# Fixed value: rows up to which Spark may choose to broadcast a staged table.
BROADCAST_ROWS = 50_000


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table once to the shared folder and go on from it, so that lost executors cost no recomputation.

    Spark rates a staged table by its compressed files, which may be a small part of what the rows take in the
    driver. So tables of many rows are joined by sorting, however small their files are.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    return staged.hint("merge") if seen.get.get("n", BROADCAST_ROWS + 1) > BROADCAST_ROWS else staged
