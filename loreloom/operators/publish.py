"""Versioned, all-or-nothing publication of result tables."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT"


def table_checksum(rows: DataFrame, checksum: Column | str) -> str:
    """Checksum of a set of row checksums, the same for any partitioning.

    Checksums are hashed in sorted order within groups that share eight hex
    digits, the group hashes within groups of four, and those once more. A group
    has about rows / 2^32 members at the first level and at most 65,536 later.
    """
    level = rows.select(F.regexp_replace(checksum, "^sha256:", "").alias("c")).select(
        F.substring("c", 1, 8).alias("g"), F.col("c").alias("h")
    )
    for width in (8, 4, 0):
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("g", "h"))), lambda s: s["h"])
        level = level.groupBy(F.substring("g", 1, width).alias("k")).agg(
            F.sha2(F.array_join(ordered, ""), 256).alias("h")
        ).select(F.col("k").alias("g"), "h")
    return "sha256:" + level.first()["h"]


def _file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _write_small(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file next to its place, then move it there in one step."""
    jvm, target, fs = _file_system(spark, path)
    temporary = jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    stream = fs.create(temporary, True)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    option = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    option[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(temporary, target, option)


def _read_small(spark: SparkSession, path: str) -> str | None:
    _, target, fs = _file_system(spark, path)
    if not fs.exists(target):
        return None
    return "\n".join(r[0] for r in spark.read.text(path).collect())


def publish_corpus(
    tables: Mapping[str, DataFrame], out: str, totals: Mapping[str, object],
    order: Mapping[str, list[str]] | None = None, checksum_of: str = "chunks",
    check: Callable[[str], None] | None = None,
) -> dict:
    """Write all tables into a new folder, then switch the pointer to it.

    ``totals`` goes into the manifest. ``order`` names the sort columns of a
    table. A folder is never written twice: readers that opened the old version
    keep it, and an interrupted run leaves the pointer alone. ``check`` sees the
    finished folder before the switch and may raise. ``content_checksum`` covers
    all tables, ``corpus_checksum`` the one named by ``checksum_of``.
    """
    main = tables[checksum_of]
    spark = main.sparkSession
    version = f"v={uuid.uuid4().hex[:16]}"
    folder = os.path.join(out, version)
    for name, df in tables.items():
        columns = (order or {}).get(name)
        ordered = df.orderBy(*columns) if columns else df
        ordered.write.parquet(os.path.join(folder, name))
    stored = {name: spark.read.schema(df.schema).parquet(os.path.join(folder, name)) for name, df in tables.items()}
    checksum = table_checksum(stored[checksum_of], "checksum")
    parts = sorted(f"{name}:{content_state(df)}" for name, df in stored.items())
    content = "sha256:" + hashlib.sha256("\n".join([checksum, *parts]).encode()).hexdigest()
    manifest = {
        **totals, "corpus_checksum": checksum, "content_checksum": content, "version": version, "tables": sorted(tables),
    }
    _write_small(spark, os.path.join(folder, "manifest.json"), json.dumps(manifest, ensure_ascii=False, sort_keys=True))
    if check is not None:
        check(folder)
    _write_small(spark, os.path.join(out, POINTER), version)
    return manifest


def content_state(df: DataFrame) -> str:
    """Row count and an order-free 64-bit hash of all columns."""
    row = F.xxhash64(F.to_json(F.struct(*df.columns))) if df.columns else F.lit(0)
    found = df.agg(F.count(F.lit(1)), F.bit_xor(row), F.bit_xor(F.xxhash64(row))).first()
    return ":".join(str(v) for v in found)


def exists(spark: SparkSession, path: str) -> bool:
    _, target, fs = _file_system(spark, path)
    return fs.exists(target)


write_pointer, read_pointer = _write_small, _read_small


def current_version(spark: SparkSession, out: str) -> str | None:
    return _read_small(spark, os.path.join(out, POINTER))


def current_folder(spark: SparkSession, out: str) -> str:
    version = current_version(spark, out)
    if version is None:
        raise FileNotFoundError(f"nothing is published in {out}")
    return os.path.join(out, version)


def read_published(spark: SparkSession, out: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(current_folder(spark, out), name))


def source_checksum(spark: SparkSession, paths: list[str]) -> str:
    """Checksum of the lines of source files, whatever their order or split into files."""
    return "lines:" + content_state(spark.read.text(paths))


def read_manifest(spark: SparkSession, out: str) -> dict | None:
    version = current_version(spark, out)
    if version is None:
        return None
    return json.loads(_read_small(spark, os.path.join(out, version, "manifest.json")))


def needs_build(spark: SparkSession, out: str, source_checksum: str) -> bool:
    """Rebuild only when the published manifest was built from another source."""
    manifest = read_manifest(spark, out)
    return manifest is None or manifest.get("source_checksum") != source_checksum


def unseen_revisions(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New rows whose (page_id, revision_id) is not stored yet, once each: of several the one with the smallest row hash."""
    keys = ["page_id", "revision_id"]
    fresh = new.join(existing.select(*keys), keys, "left_anti")
    row = F.struct(*[F.col(f"`{c}`") for c in new.columns])
    one = fresh.groupBy(*keys).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row"))
    return one.select("row.*").select(*new.columns)


def append_revisions(path: str, existing: DataFrame, new: DataFrame) -> None:
    unseen_revisions(existing, new).write.mode("append").json(path)
