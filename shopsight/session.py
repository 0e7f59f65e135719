"""Session defaults and the shared scratch folder.

Everything that has to survive executor loss (lineage cuts, staged tables,
stream checkpoints) goes below ``spark.checkpoint.dir``.  On a cluster that
setting must name a shared folder, and a session without it is refused; only a
local master gets a temporary folder of its own (tests, laptops).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HotSpot does not JIT-compile methods over 8000 bytes of bytecode; a fused stage
    # that large would run interpreted, so let Spark fall back to per-operator code.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "shopsight", master: str | None = None,
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor
        builder = builder.config("spark.driver.memory", "8g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session (a local one only on a local master)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    sc.setCheckpointDir(checkpoint_root(sc.master, sc.getConf().get("spark.checkpoint.dir", None)))
    return sc.getCheckpointDir()


def checkpoint_root(master: str, configured: str | None) -> str:
    """The configured folder; without one a temporary folder, but only where driver and
    executors are one process."""
    if configured:
        return configured
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
    return tempfile.mkdtemp(prefix="shopsight-ckpt-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint dir for one staged table or stream."""
    return os.path.join(checkpoint_dir(spark), "shopsight", f"{name}-{uuid.uuid4().hex}")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write once below the shared checkpoint folder and read back: cuts the lineage, is
    computed once however many branches read it, and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
