"""Session setup, size estimates and shared scratch folders."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SPLIT_BYTES = 128 * 1024 * 1024


def build_session(app: str = "codegauge", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are tuned for.

    Shuffle partition counts are left to adaptive execution: it starts from
    `spark.sql.shuffle.partitions` and merges small partitions / splits skewed ones.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    defaults.update(conf)
    for key, value in defaults.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def estimated_bytes(df: DataFrame) -> int | None:
    """The optimizer's size estimate, or None where the client cannot see it."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:
        return None


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a *small* input over all cores before expensive row-wise work.

    A file below one split is read by a single task. Where the whole input is
    smaller than one split per core the rows are hashed over the cores; larger
    inputs already have enough splits and pass through without a shuffle.
    """
    spark = df.sparkSession
    size = estimated_bytes(df)
    cores = spark.sparkContext.defaultParallelism
    if size is None or size >= cores * SPLIT_BYTES:
        return df
    return df.repartition(cores, key)


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as the session names it.

    Only a local master may fall back to a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not _is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return os.path.join(tempfile.gettempdir(), "codegauge")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; never reused, so reruns cannot clash."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
