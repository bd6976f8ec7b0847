"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_STAGED: list[str] = []


def local_session(app: str = "loreloom", cores: int | str = 8, **conf: str) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can read: the cluster's own, or a fresh one in local mode."""
    configured = spark.conf.get(CHECKPOINT_DIR, None)
    if configured:
        return configured
    if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is None:
        raise RuntimeError(f"{CHECKPOINT_DIR} must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set(CHECKPOINT_DIR, folder)
    return folder


def stage(df: DataFrame, label: str) -> DataFrame:
    """Materialise ``df`` as a table in the shared folder and read it back.

    The result has no lineage to recompute when an executor is lost, and it has
    file statistics, so the join strategy after it is chosen from real sizes.
    """
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), "loreloom", f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for costly per-row work when the input has fewer splits than cores.

    A cluster-sized scan already has many splits and passes through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def python_groups(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitioning for a grouped Python step.

    A fixed partition count is not merged at run time, so small but costly groups
    stay spread over the cores; the grouping after it needs no further shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def drop_stages(spark: SparkSession) -> int:
    """Delete the tables staged so far; call it once the results are written."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    dropped = 0
    while _STAGED:
        target = hadoop.Path(_STAGED.pop())
        dropped += bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True))
    return dropped
