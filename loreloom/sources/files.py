"""Readers with fixed schemas. Bad records surface as rows, not as lost lines."""

from __future__ import annotations

import json
from collections.abc import Sequence

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreloom.functions import text as tx
from loreloom.operators.validate import checksum_of

RAW_PAGE = (
    "schema_version bigint, document_id string, namespace bigint, page_id bigint, revision_id bigint, "
    "parent_revision_id bigint, revision_sha1 string, revision_timestamp string, retrieved_at string, title string, "
    "redirect boolean, stale boolean, content_model string, wikitext string, content_checksum string, "
    "source_url string, revision_url string, source_title string, source_type string, license_note string, "
    "authorization_ref string, _corrupt_record string"
)
CHUNK = (
    "schema_version int, chunk_id string, document_id string, entity_type string, entity_id string, name_zh string, "
    "name_en string, aliases array<string>, title string, section_path array<string>, text string, "
    "source struct<id:string,title:string,url:string,canonical_url:string,type:string>, source_material_type string, "
    "page_id bigint, revision_id bigint, revision_timestamp string, acquired_on string, retrieved_at string, "
    "game_version string, license_note string, authorization_ref string, content_version string, stale boolean, "
    "raw_document_id string, redirect_sources array<struct<title:string,page_id:bigint,revision_id:bigint,document_id:string>>, "
    "normalization string, checksum string, data_row int, data_page_key string, source_conflict boolean, "
    "conflict_key string, room_file string, room_type string, room_variant string, room_subtype string, room_shape string"
)
CURATED = (
    "document_id string, entity_type string, entity_id string, name_zh string, name_en string, aliases array<string>, "
    "title string, text string, source struct<id:string,title:string,url:string,type:string>, acquired_on string, "
    "game_version string, license_note string, content_version string, stale boolean"
)
ITEM = (
    "collectible_id bigint, name_zh string, name_en string, facts array<string>, advice_hint string, "
    "sources array<struct<id:string,title:string,url:string>>"
)
CASE = (
    "id string, query string, filters struct<entity_types:array<string>,game_version:string,source_types:array<string>>, "
    "expected_entities array<string>, expected_sources array<string>, expect_no_answer boolean"
)
OVERRIDE = (
    "page_title string, match_aliases array<string>, entity_type string, entity_id string, name_zh string, "
    "name_en string, aliases array<string>"
)
FILLED = ("acquired_on", "game_version", "license_note", "content_version")


def read_pages(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Raw page records of one or more snapshots. Blank lines are skipped; a line
    that does not fit the schema keeps its text in ``_corrupt_record``."""
    return spark.read.schema(RAW_PAGE).option("mode", "PERMISSIVE").json(paths if isinstance(paths, str) else list(paths))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK).json(path)


def _exploded(spark: SparkSession, path: str, name: str, element: str, extra: str = "") -> DataFrame:
    fields = element.replace(", ", ",")
    inner = ",".join(p.replace(" ", ":", 1) for p in _split_fields(fields))
    schema = f"schema_version int, {name} array<struct<{inner}>>" + (f", {extra}" if extra else "")
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def _split_fields(schema: str) -> list[str]:
    """Split a schema string at its top-level commas."""
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(schema):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(schema[start:i])
            start = i + 1
    return [*parts, schema[start:]]


def read_curated(spark: SparkSession, path: str) -> DataFrame:
    """Curated documents with the file's defaults filled in."""
    defaults = "defaults struct<acquired_on:string,game_version:string,license_note:string,content_version:string,stale:boolean>"
    raw = _exploded(spark, path, "documents", CURATED, defaults)
    docs = raw.where("schema_version = 1").select("defaults", F.explode("documents").alias("d"))
    names = [p.split(" ")[0] for p in _split_fields(CURATED.replace(", ", ","))]
    filled = {n: F.coalesce(F.col(f"d.{n}"), F.col(f"defaults.{n}")) for n in FILLED}
    filled["stale"] = F.coalesce("d.stale", "defaults.stale", F.lit(False))
    return docs.select(*[filled.get(n, F.col(f"d.{n}")).alias(n) for n in names])


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return _exploded(spark, path, "items", ITEM).where("schema_version = 1").select(F.inline("items"))


def read_eval(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Evaluation cases in the shape of search queries, and the suite header."""
    extra = "eval_id string, top_k int, thresholds map<string,double>"
    raw = _exploded(spark, path, "cases", CASE, extra)
    header = raw.select("eval_id", "top_k", "thresholds").first().asDict()
    c = raw.select(F.explode("cases").alias("c"))
    cases = c.select(
        F.col("c.id").alias("query_id"), "c.query", "c.filters.entity_types", "c.filters.game_version",
        "c.filters.source_types", "c.expected_entities", "c.expected_sources",
        F.coalesce("c.expect_no_answer", F.lit(False)).alias("expect_no_answer"),
    )
    return cases, header


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Override entries; their order in the file is their priority."""
    raw = _exploded(spark, path, "entities", OVERRIDE).where("schema_version = 1")
    rows = raw.select(F.posexplode("entities").alias("position", "e")).select("position", "e.*")
    required = [F.col(c).isNull() for c in ("entity_type", "entity_id", "name_zh", "name_en", "aliases")]
    bad = required[0]
    for c in required[1:]:
        bad = bad | c
    if not rows.where(bad).isEmpty():
        raise ValueError(f"override entry without its entity fields in {path}")
    return rows


def read_requirements(spark: SparkSession, path: str) -> dict:
    """Audit requirements: one small JSON object."""
    value = json.loads(spark.read.option("wholetext", "true").text(path).first()[0])
    titles = [*value["required_exact_titles"], *value["expected_dependency_titles"], *value["required_tabular_tables"]]
    if value.get("schema_version") != 1 or not all(t.startswith("Data:") for t in titles):
        raise ValueError(f"invalid audit requirements in {path}")
    if not value["room_title_prefix"].startswith("Data:Rooms/"):
        raise ValueError("room_title_prefix must start with Data:Rooms/")
    return value


RESPONSE = (
    "query struct<pages:array<struct<pageid:bigint,ns:bigint,title:string,canonicalurl:string,redirect:string,"
    "revisions:array<struct<revid:bigint,parentid:bigint,timestamp:string,sha1:string,"
    "slots:struct<main:struct<content:string,contentmodel:string>>>>>>>"
)


def flatten_responses(
    responses: DataFrame, retrieved_at: str, source: dict[str, str], id_prefix: str = "wiki", column: str = "value"
) -> DataFrame:
    """Page-revision records out of API response bodies; incomplete pages are skipped.

    ``source`` gives title_prefix, source_type, license_note and authorization_ref.
    """
    keys = F.from_json(column, "query struct<pages:array<string>>")["query"]["pages"]
    pages = responses.select(F.from_json(column, RESPONSE).alias("r"), keys.alias("k")).select(
        F.explode(F.arrays_zip(F.col("r.query.pages").alias("p"), F.col("k").alias("raw"))).alias("z")
    ).select(F.col("z.p").alias("p"), F.col("z.raw").alias("raw"))
    rev = F.get("p.revisions", F.lit(0))
    rows = pages.withColumn("rev", rev).where("rev.slots.main IS NOT NULL AND p.pageid IS NOT NULL AND rev.revid IS NOT NULL")
    content = F.coalesce("rev.slots.main.content", F.lit(""))
    title = tx.strip(F.coalesce("p.title", F.lit("")))
    url = F.coalesce("p.canonicalurl", F.concat(F.lit("https://"), F.replace(title, F.lit(" "), F.lit("_"))))
    page, number = F.col("p.pageid").cast("string"), F.col("rev.revid").cast("string")
    return rows.select(
        F.lit(1).cast("bigint").alias("schema_version"),
        F.concat(F.lit(f"{id_prefix}:page:"), page, F.lit(":rev:"), number).alias("document_id"),
        F.col("p.pageid").alias("page_id"), F.col("p.ns").alias("namespace"), title.alias("title"),
        F.array_contains(F.json_object_keys("raw"), F.lit("redirect")).alias("redirect"),
        F.col("rev.revid").alias("revision_id"), F.col("rev.parentid").alias("parent_revision_id"),
        F.coalesce("rev.timestamp", F.lit("")).alias("revision_timestamp"),
        F.coalesce("rev.sha1", F.lit("")).alias("revision_sha1"),
        F.coalesce("rev.slots.main.contentmodel", F.lit("wikitext")).alias("content_model"),
        content.alias("wikitext"), checksum_of(content).alias("content_checksum"),
        url.alias("source_url"), F.concat(url, F.lit("?oldid="), number).alias("revision_url"),
        F.concat(F.lit(source["title_prefix"]), title).alias("source_title"),
        F.lit(source["source_type"]).alias("source_type"), F.lit(retrieved_at).alias("retrieved_at"),
        F.lit(source["license_note"]).alias("license_note"),
        F.lit(source["authorization_ref"]).alias("authorization_ref"), F.lit(False).alias("stale"),
    ).orderBy("namespace", "page_id")


def read_vectors(spark: SparkSession, path: str, dimension: int) -> tuple[DataFrame, DataFrame]:
    """Vector rows of the right dimension, and the others."""
    rows = spark.read.parquet(path)
    fits = F.coalesce(F.size("embedding") == dimension, F.lit(False))
    return rows.where(fits), rows.where(~fits)


def read_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder with relative paths and content, for the manifest audit."""
    base = folder.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    at = F.instr("path", base)
    return files.select(
        F.substring(F.col("path"), at + len(base), F.length("path")).alias("path"), "length", "content"
    ).where("path <> 'manifest.json'")


def read_pack_manifest(spark: SparkSession, path: str) -> DataFrame:
    schema = "files array<struct<path:string,size:bigint,sha256:string,required:boolean,role:string>>"
    return spark.read.schema(schema).option("multiLine", "true").json(path).select(F.inline("files"))


def replay_lines(spark: SparkSession, path: str) -> DataFrame:
    """Recorded event lines; the same parser serves the live stream."""
    return spark.read.text(path)


def stream_lines(spark: SparkSession, folder: str, since: datetime | None = None) -> DataFrame:
    """Live log lines from a folder of rotated files; the checkpoint keeps the position.

    ``since`` leaves out the lines of files last written before that time, whatever order files land
    in; pass the time the job first started, so that a restart keeps the same files.
    """
    lines = spark.readStream.format("text").option("latestFirst", "false").load(folder)
    if since is None:
        return lines
    return lines.where(F.col("_metadata.file_modification_time") >= F.lit(since)).select("value")


def pcm_chunks(files: DataFrame, sample_rate: int, channels: int = 1, width: int = 2, chunk_ms: int = 20) -> DataFrame:
    """Fixed-duration pieces of 16-bit PCM files: (path, sequence, duration_ms, rms)."""
    import numpy as np
    import pandas as pd

    size = sample_rate * channels * width * chunk_ms // 1000
    per_second = sample_rate * channels * width

    def run(frames):
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                if len(content) % (channels * width):
                    raise ValueError(f"{path} is not aligned to samples")
                for number, start in enumerate(range(0, len(content), size)):
                    piece = np.frombuffer(content[start : start + size], dtype="<i2").astype(np.int64)
                    level = int(np.sqrt((piece * piece).sum() // len(piece)))
                    rows.append((path, number, len(piece) * width * 1000.0 / per_second, level))
            yield pd.DataFrame(rows, columns=["path", "sequence", "duration_ms", "rms"])

    return files.select("path", "content").mapInPandas(run, "path string, sequence int, duration_ms double, rms int")


def recording_gate(
    chunks: DataFrame, min_ms: float, max_seconds: float, silence_rms: int, noise_rms: int
) -> DataFrame:
    """Verdict per recording: ok, or why it is rejected."""
    totals = chunks.groupBy("path").agg(
        F.sum("duration_ms").alias("duration_ms"), F.max("rms").alias("peak_rms"),
        F.count_if(F.col("rms") >= noise_rms).alias("active_chunks"),
    )
    verdict = (
        F.when(F.col("duration_ms") <= 0, "no audio")
        .when(F.col("duration_ms") < min_ms, "too short")
        .when(F.col("duration_ms") > max_seconds * 1000, "too long")
        .when(F.col("peak_rms") < silence_rms, "silence")
        .when(F.col("active_chunks") == 0, "no clear speech")
        .otherwise("ok")
    )
    return totals.withColumn("verdict", verdict)
