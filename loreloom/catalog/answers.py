"""Evidence and guards over ``documents``."""

from pyspark.sql import functions as F

from loreloom.catalog import registry, table
from loreloom.operators import answers as an, retrieve as rt
from loreloom.operators.scan import top_per

HITS_SQL = """
hits AS (SELECT source, doc_id, lang, text, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank
         FROM documents QUALIFY rank <= 5)
"""


def _hits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return top_per(docs, ["source"], [F.col("n_chars").desc(), F.col("doc_id")], 5).select(
        F.col("source").alias("query_id"), "rank", F.col("doc_id").cast("string").alias("chunk_id"),
        F.col("lang").alias("entity_type"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("entity_id"),
        "text", F.col("doc_id").cast("string").alias("source_id"), F.col("source").alias("source_title"),
    )


@registry.add(
    f"""
    WITH {HITS_SQL},
    packed AS (
      SELECT source, '{{"ok":true,"data":' || to_json(list(struct_pack(entity_type := lang, entity_id := 'doc:' || doc_id, text := left(text, 500),
             source_id := doc_id::VARCHAR, source_title := source) ORDER BY rank))::VARCHAR || '}}' AS j
      FROM hits WHERE rank <= 3 GROUP BY source)
    SELECT source, CASE WHEN length(j) <= 1800 THEN j ELSE '{{"ok":false,"code":"result_too_large"}}' END AS evidence FROM packed
    """
)
def evidence_json(spark, sf_dir):
    rows = an.evidence_json(_hits(spark, sf_dir), max_chars=1800)
    return rows.select(F.col("query_id").alias("source"), "evidence")


@registry.add(
    rf"""
    WITH {HITS_SQL},
    best AS (SELECT source, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM hits WHERE rank = 1),
    asked AS (SELECT DISTINCT source AS q FROM documents UNION ALL SELECT DISTINCT 'lang ' || lang FROM documents)
    SELECT q AS query_id, CASE WHEN t IS NULL THEN '{an.NO_ANSWER}'
           WHEN length(t) > 120 THEN rtrim(left(t, 119)) || '…' ELSE t END AS answer
    FROM asked LEFT JOIN best ON q = source
    """
)
def fallback_answer(spark, sf_dir):
    """Shortened best evidence per source; languages were asked too and have no hits."""
    docs = table(spark, sf_dir, "documents")
    asked = docs.select(F.col("source").alias("query_id")).distinct().unionByName(
        docs.select(F.concat(F.lit("lang "), "lang").alias("query_id")).distinct()
    )
    return an.fallback_answer(asked, _hits(spark, sf_dir))


@registry.add(
    r"""
    WITH d AS (
      SELECT doc_id, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t, doc_id % 7 AS m FROM documents)
    SELECT doc_id, concat_ws(',',
      CASE WHEN m = 0 THEN 'keys' END,
      CASE WHEN NOT length(t) BETWEEN 1 AND 240 THEN 'advice' END,
      CASE WHEN m = 1 THEN 'confidence' END,
      CASE WHEN m = 2 THEN 'state_seq' END,
      CASE WHEN m = 3 THEN 'source_allowed' END) AS broken,
      CASE WHEN m = 4 THEN 2 ELSE 1 END AS sources
    FROM d
    """
)
def answer_guard(spark, sf_dir):
    """Drafts written from documents: long texts, wrong keys, confidence, sequence and sources."""
    m = F.col("doc_id") % 7
    own = F.concat(F.lit("s"), F.col("doc_id").cast("string"))
    sources = F.when(m == 3, F.array(own, F.lit("forged"))).when(m == 4, F.array(own, F.lit("also"), own)).otherwise(F.array(own, own))
    draft = F.struct(
        F.col("text").alias("advice"), F.lit("because").alias("reason"), F.when(m == 1, 1.5).otherwise(0.5).alias("confidence"),
        sources.alias("sources"), (F.col("doc_id") + (m == 2).cast("int")).alias("state_seq"),
        F.when(m == 0, "x").alias("extra"),
    )
    drafts = table(spark, sf_dir, "documents").select(
        "doc_id", F.to_json(draft).alias("content"), F.array(own, F.lit("also")).alias("allowed_sources"),
        F.col("doc_id").alias("expected_seq"),
    )
    checked = an.guard_answers(drafts)
    kept = F.size(F.array_intersect("sources", "allowed_sources"))
    return checked.select(
        "doc_id", F.array_join("broken_rules", ",").alias("broken"), kept.alias("sources")
    )


@registry.add(
    """
    SELECT DISTINCT p_brand AS entity_id, 'P' || lpad(min(p_partkey)::VARCHAR, 9, '0') AS chunk_id, arg_min(p_name, p_partkey) AS name_zh
    FROM part WHERE p_size > 3 GROUP BY p_brand
    """
)
def described_entities(spark, sf_dir):
    """First non-stale chunk of every brand."""
    chunks = table(spark, sf_dir, "part").select(
        F.lit("brand").alias("entity_type"), F.col("p_brand").alias("entity_id"),
        F.concat(F.lit("P"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("chunk_id"),
        F.col("p_name").alias("name_zh"), (F.col("p_size") <= 3).alias("stale"),
    )
    wanted = chunks.select("entity_type", "entity_id").distinct()
    return rt.describe_entities(wanted, chunks).select("entity_id", "chunk_id", "name_zh")
