"""The corpus pipeline: toxic documents go, then copies, near copies and benchmark leaks; the rest is packed.

Each stage is a function of (spark, docs, sf_dir). Its result is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``documents``, in their order, and any further columns that ``docs`` has.

Nulls and odd rows: a null or empty text is clean, equal to other empty texts for exact dedup, linked with nothing for near dedup, and
packs as its end token alone. Rows with a null id are judged by their text in every stage: never training rows, copies of rows with
ids first, never near copies, contaminated like others, packed with a null id. Repeated rows are exact copies, of which one stays. Texts
are read whole. An empty table, or no labels or items, gives an empty or an unchanged table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loreloom.catalog import table
from loreloom.llm import bloom_dedup, hyperminhash, packing, segments, spaced_seeds
from loreloom.llm.tables import stage


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go."""
    model = segments.fit(docs, table(spark, sf_dir, "labels"))
    return segments.drop_toxic(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the one with the smallest id."""
    return bloom_dedup.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by similar five-word shingles stays, the one with the smallest id."""
    found = hyperminhash.near_duplicates(docs, words=5, percent=80)
    gone, _ = stage(found.where("not kept").select("doc_id").distinct(), "near-copies")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return spaced_seeds.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of each document that is left, with its place in the sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
    ("decontamination", decontamination), ("packing", packed),
]

#: Scores, similarity components and token ids are beyond SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs, _ = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
