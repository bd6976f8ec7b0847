"""Written intermediate tables in the folder all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loreloom.session import shared_folder

#: Spark's switch that removes a query's shuffle files at its end, instead of when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a table and read it back: lineage ends here, and ids in it are fixed. The shuffle files of the write go with it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/loreloom-llm/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for path in paths:
        target = hadoop.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
