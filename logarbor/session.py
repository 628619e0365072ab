"""Session helpers: a configured SparkSession and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


JIT_OPTION = "-XX:-DontCompileHugeMethods"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "logarbor", driver_memory: str | None = None) -> SparkSession:
    """Session for local runs and tests. On a cluster use the cluster's own session."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # small shuffles feed CPU-heavy parsing/window work: keep ~1 MB partitions apart locally
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # the fused parse stage generates methods above HotSpot's 8000-byte JIT limit;
        # let the JIT compile them (2-3x faster parsing). Set the same on cluster executors.
        .config("spark.driver.extraJavaOptions", JIT_OPTION)
        .config("spark.executor.extraJavaOptions", JIT_OPTION)
        # plans name whole paths: the default cuts them at 100 characters
        .config("spark.sql.maxMetadataStringLength", "1000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is only read here. Where it is
    unset, a local session gets a fresh scratch folder; elsewhere that folder would not be
    seen by the executors, so it is an error.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="logarbor-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current
