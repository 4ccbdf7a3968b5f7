"""Session helpers: sane local defaults, and the shared folder for durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and local benchmarks. On a cluster, pass in the cluster's own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("probatum")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )


_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; in local mode a fresh temporary one where none is configured."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _OWN_DIR.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-"))


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/probatum/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a frame once and read it back, so a lost executor never replays what lies before it.

    The table goes to the shared folder rather than to executor-local blocks, so it outlives
    the executor that wrote it.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
