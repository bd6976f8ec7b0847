"""Keyword and vector index tables built from chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreloom.functions import text as tx
from loreloom.session import stage

FILTER_COLUMNS = ("entity_type", "entity_id", "game_version", "source_type", "stale")
LISTED_BYTES = 4 << 20  # texts whose tokens a task holds at a time
FIELD_MARK = "|"  # never part of a token, so a phrase cannot span two fields


@dataclass(frozen=True)
class KeywordIndex:
    """Tables of a published keyword index.

    ``chunks`` payload columns plus the filter columns; ``aliases`` one row per
    (normalized, chunk_id); ``fields`` the searchable text and its length;
    ``postings`` (term, chunk_id, dl, tf, positions) and ``term_stats`` (term, df).
    """

    chunks: DataFrame
    aliases: DataFrame
    fields: DataFrame
    postings: DataFrame | None = None
    term_stats: DataFrame | None = None


def index_aliases() -> Column:
    """Names, id and aliases; the bare number of an id only for items."""
    suffix = F.element_at(F.split("entity_id", ":"), -1)
    bare = F.when(
        suffix.rlike("^[0-9]+$") & (F.col("entity_type") == "item"), F.array(suffix)
    ).otherwise(F.array().cast("array<string>"))
    names = F.array("name_zh", "name_en", "entity_id")
    return F.array_distinct(F.concat(names, F.col("aliases"), bare))


def flat_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with the source type lifted to a top-level filter column."""
    if "source_type" in chunks.columns:
        return chunks
    return chunks.withColumn("source_type", F.col("source.type"))


def alias_rows(chunks: DataFrame) -> DataFrame:
    """One row per (normalized, chunk); the first alias wins. Needs no shuffle."""
    named = F.transform(
        index_aliases(), lambda a: F.struct(tx.alias_key(a).alias("normalized"), a.alias("alias"))
    )
    filled = F.filter(named, lambda s: s["normalized"] != "")
    first = tx.first_per_key(filled, "struct<normalized:string,alias:string>", "normalized")
    return flat_chunks(chunks).select("chunk_id", *FILTER_COLUMNS, F.inline(first))


def search_fields(chunks: DataFrame) -> DataFrame:
    """Normalised text of the five searchable fields and its token count."""
    parts = [
        F.col("name_zh"), F.col("name_en"), F.array_join(index_aliases(), " "),
        F.col("title"), F.col("text"),
    ]
    body = F.concat_ws(FIELD_MARK, *[tx.search_text(p) for p in parts])
    return with_length(flat_chunks(chunks).select("chunk_id", *FILTER_COLUMNS, body.alias("body")))


def with_length(fields: DataFrame) -> DataFrame:
    return fields.withColumn("dl", F.size(body_tokens(F.col("body"))))


def body_tokens(body: Column) -> Column:
    return F.filter(F.split(body, r"[ |]+"), lambda t: t != "")


def postings(fields: DataFrame) -> DataFrame:
    """(term, chunk_id, dl, tf, positions). A chunk's lists are made where its text is, so no token is shuffled.

    The length travels with the posting, so scoring does not join the texts. A field mark takes a
    position of its own, so a phrase cannot run from one field into the next. Rows that repeat a chunk's
    id are put together by term; only their tokens are dealt.
    """
    repeated = fields.groupBy(F.col("chunk_id").alias("again")).agg(F.count("*").alias("n")).where("n > 1").select("again")
    repeated = stage(repeated, "repeated-chunks")
    same = F.col("chunk_id").eqNullSafe(F.col("again"))
    alone = _listed(fields.join(repeated, same, "left_anti"))
    together = tokens(fields.join(repeated, same, "left_semi")).groupBy("term", "chunk_id", "dl").agg(
        F.count("*").alias("tf"), F.sort_array(F.collect_list("position")).alias("positions")
    )
    return alone.unionByName(together)


def _listed(fields: DataFrame) -> DataFrame:
    """Postings of rows that are a chunk each. About ``LISTED_BYTES`` of text, or one longer text, are taken apart at a time."""
    schema = T.StructType([
        T.StructField("term", T.StringType()), fields.schema["chunk_id"], fields.schema["dl"],
        T.StructField("tf", T.LongType()), T.StructField("positions", T.ArrayType(T.IntegerType())),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(size, dtype=np.int64)
            start = 0
            while start < batch.num_rows:
                base = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, base + LISTED_BYTES, side="right")))
                yield batch.slice(start, stop - start)
                start = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches):
            words = pc.split_pattern(pc.replace_substring(batch.column(2), FIELD_MARK, f" {FIELD_MARK} "), " ")
            row, term = pc.list_parent_indices(words), pc.list_flatten(words)
            filled = pc.not_equal(term, "")
            row, term = row.filter(filled).to_numpy().astype(np.int64), term.filter(filled)
            first = np.searchsorted(row, np.arange(batch.num_rows))
            place = (np.arange(len(row)) - first[row]).astype(np.int32)
            real = pc.not_equal(term, FIELD_MARK)
            kept = real.to_numpy(zero_copy_only=False)
            row, place, coded = row[kept], place[kept], term.filter(real).dictionary_encode()
            code = coded.indices.to_numpy()
            key = row * max(len(coded.dictionary), 1) + code
            by = np.argsort(key, kind="stable")  # places of one term stay in order
            key = key[by]
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
            edges, head = np.append(starts, len(key)), by[starts]
            yield pa.RecordBatch.from_arrays(
                [
                    coded.dictionary.take(pa.array(code[head])), batch.column(0).take(pa.array(row[head])),
                    batch.column(1).take(pa.array(row[head])), pa.array(np.diff(edges).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(place[by])),
                ],
                names=["term", "chunk_id", "dl", "tf", "positions"],
            )

    return fields.select("chunk_id", "dl", "body").mapInArrow(run, schema)


def tokens(fields: DataFrame) -> DataFrame:
    """One row per token. The outer form keeps Spark from splitting the text a second
    time for a filter it would otherwise infer."""
    spaced = F.replace("body", F.lit(FIELD_MARK), F.lit(f" {FIELD_MARK} "))
    marked = F.filter(F.split(spaced, " +"), lambda t: t != "")
    rows = fields.select("chunk_id", "dl", F.posexplode_outer(marked).alias("position", "term"))
    return rows.where(F.col("term") != FIELD_MARK)


def term_stats(post: DataFrame) -> DataFrame:
    """(term, df): a posting is one chunk of one term, so rows are counted and nothing is made distinct."""
    return post.groupBy("term").agg(F.count("*").alias("df"))


def field_term_stats(fields: DataFrame) -> DataFrame:
    """(term, df) straight from the texts: distinct tokens per row, one count by term."""
    terms = F.array_distinct(body_tokens(F.col("body")))
    return fields.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def build_keyword_index(chunks: DataFrame) -> KeywordIndex:
    fields = search_fields(chunks)
    post = postings(fields)
    return KeywordIndex(flat_chunks(chunks), alias_rows(chunks), fields, post, term_stats(post))


def embedding_text() -> Column:
    return F.concat_ws(
        " ", "name_zh", "name_en", F.array_join("aliases", " "), "title", "text"
    )


Encoder = Callable[[list[str]], np.ndarray]


def embed(df: DataFrame, encoder: Encoder, id_column: str, text: Column, batch: int = 256) -> DataFrame:
    """Unit vectors for a text column through a user-supplied batch encoder."""
    id_type = df.schema[id_column].dataType
    schema = T.StructType(
        [T.StructField(id_column, id_type), T.StructField("embedding", T.ArrayType(T.FloatType()))]
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                vectors = np.asarray(encoder(part["_text"].tolist()), dtype=np.float32)
                norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                vectors = vectors / np.where(norms == 0, 1, norms)
                yield pd.DataFrame({id_column: part[id_column], "embedding": list(vectors)})

    return df.select(id_column, text.alias("_text")).mapInPandas(run, schema)


def build_vectors(chunks: DataFrame, encoder: Encoder) -> DataFrame:
    return embed(chunks, encoder, "chunk_id", embedding_text())


def unit(c: Column) -> Column:
    """L2-normalised copy of a vector column; a zero vector stays zero."""
    norm = F.sqrt(
        F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )
    return F.transform(c, lambda x: F.when(norm > 0, x / norm).otherwise(x.cast("double")).cast("float"))


def check_vectors(vectors: DataFrame, dimension: int, expected: int | None = None) -> DataFrame:
    """Violations of a vector table: wrong dimension per row, wrong row count once."""
    wrong = vectors.where(F.size("embedding") != dimension).select(
        F.col("chunk_id").cast("string").alias("chunk_id"),
        F.concat(F.lit("dimension "), F.size("embedding").cast("string")).alias("violation"),
    )
    if expected is None:
        return wrong
    count = vectors.agg(F.count("*").alias("n")).where(F.col("n") != expected).select(
        F.lit(None).cast("string").alias("chunk_id"),
        F.concat(F.lit("count "), F.col("n").cast("string")).alias("violation"),
    )
    return wrong.unionByName(count)


def convert_vectors(vectors: DataFrame, dimension: int, expected: int | None = None) -> DataFrame:
    """Checked, normalised copy of a vector table without encoding again."""
    if not check_vectors(vectors, dimension, expected).isEmpty():
        raise ValueError("vector table has rows of another dimension or a wrong row count")
    return vectors.select("chunk_id", unit(F.col("embedding")).alias("embedding"))


def id_mismatch(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Ids on only one side; must be empty before vectors may be used."""
    a = chunks.select(key, F.lit(True).alias("in_chunks"))
    b = vectors.select(key, F.lit(True).alias("in_vectors"))
    return a.join(b, key, "full_outer").where("in_chunks IS NULL OR in_vectors IS NULL").select(
        key, F.when(F.col("in_chunks").isNull(), "vectors").otherwise("chunks").alias("only_in")
    )
