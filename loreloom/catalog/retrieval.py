"""Retrieval operators over ``documents``, ``benchmark``, ``part`` and ``embeddings``."""

from pyspark.sql import functions as F

from loreloom.catalog import registry, table
from loreloom.functions import text as tx
from loreloom.operators import evaluate as ev
from loreloom.operators import retrieve as rt
from loreloom.operators import index as ix
from loreloom.operators.index import with_length
from loreloom.operators.scan import top_per
from loreloom.session import spread, stage

FOLDED = "replace(lower({0}), 'ß', 'ss')"
KEY = "regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^0-9a-z\\x{{3400}}-\\x{{9fff}}]+', '', 'g')"

# Query terms in SQL: the cleaned text, then its runs; distinct by first place; at most eight.
TERMS = r"""
cleaned AS (
  SELECT item_id, regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'),
         '["''():*^]', ' ', 'g'), '^\s+|\s+$', '', 'g') AS q FROM benchmark),
listed AS (
  SELECT item_id, list_concat([q], regexp_extract_all(q, '[0-9a-z]+|[\x{3400}-\x{9fff}]{2,}')) AS ts
  FROM cleaned),
placed AS (SELECT item_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS place FROM listed),
firsts AS (SELECT item_id, term, min(place) AS place FROM placed WHERE term <> '' GROUP BY ALL),
terms AS (
  SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY place) AS term_no FROM firsts
  QUALIFY term_no <= 8)
"""

BM25_SQL = rf"""
WITH {TERMS},
phrases AS (
  SELECT item_id, term_no,
         trim(regexp_replace(strip_accents(term), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS p FROM terms),
bodies AS (
  SELECT doc_id, string_split(trim(regexp_replace(strip_accents(lower(text)), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w
  FROM documents),
docs AS (
  SELECT doc_id, w, len(list_filter(w, lambda x: x <> '')) AS dl, '  ' || array_to_string(w, '  ') || '  ' AS body
  FROM bodies),
tokens AS (SELECT doc_id, unnest(w) AS t FROM docs),
single AS (
  SELECT t AS p, doc_id, count(*) AS tf FROM tokens
  WHERE t IN (SELECT p FROM phrases WHERE p NOT LIKE '% %') GROUP BY ALL),
longer AS (
  SELECT p, doc_id, (length(body) - length(replace(body, m, ''))) // length(m) AS tf
  FROM (SELECT DISTINCT p, ' ' || replace(p, ' ', '  ') || ' ' AS m FROM phrases WHERE p LIKE '% %')
  JOIN docs ON contains(body, m)),
counts AS (SELECT * FROM single UNION ALL SELECT * FROM longer),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM docs),
weights AS (
  SELECT p, CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) > 0
                 THEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) ELSE 1e-6 END AS idf
  FROM (SELECT p, count(*) AS df FROM counts GROUP BY p), stats),
scores AS (
  SELECT item_id, doc_id,
         round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score
  FROM phrases JOIN weights USING (p) JOIN counts USING (p) JOIN docs USING (doc_id), stats
  GROUP BY ALL)
SELECT item_id, doc_id, round(score, 5) AS score,
       row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
FROM scores QUALIFY rank <= 20
"""


def document_fields(spark, sf_dir):
    """The searchable text as a table of its own, as a published index keeps it."""
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"))
    return stage(with_length(docs.select("chunk_id", tx.search_text(F.col("text")).alias("body"))), "fields")


@registry.add(BM25_SQL)
def bm25_topk(spark, sf_dir):
    """Best 20 documents for every benchmark text by BM25 over phrases."""
    asked = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )
    fields = document_fields(spark, sf_dir)
    scores = rt.bm25_scores(asked, fields, stage(ix.postings(fields), "postings"))
    best = top_per(scores, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], rt.candidate_limit(5))
    return best.select(
        F.col("query_id").alias("item_id"),
        F.col("chunk_id").alias("doc_id"),
        F.round("score", 5).alias("score"),
        F.col("rank").cast("long").alias("rank"),
    )


def _no_filters(df):
    return rt.prepare_queries(df)


def _alias_table(df, alias, chunk, entity_type, entity):
    return df.select(
        tx.alias_key(F.col(alias)).alias("normalized"),
        F.col(alias).alias("alias"),
        F.col(chunk).alias("chunk_id"),
        F.lit(entity_type).alias("entity_type"),
        F.col(entity).cast("string").alias("entity_id"),
        F.lit("1").alias("game_version"),
        F.lit("table").alias("source_type"),
        F.lit(False).alias("stale"),
    )


@registry.add(
    f"""
    SELECT q.query, p_partkey AS chunk_id, 1.0 AS value
    FROM (SELECT DISTINCT upper(replace(p_name, ' ', ' - ')) AS query FROM part) q
    JOIN part ON {KEY.format('q.query')} = {KEY.format('p_name')}
    """
)
def alias_exact(spark, sf_dir):
    """Part names written another way find the parts of that name."""
    part = table(spark, sf_dir, "part")
    asked = part.select(F.upper(F.replace("p_name", F.lit(" "), F.lit(" - "))).alias("query")).distinct()
    aliases = _alias_table(part, "p_name", "p_partkey", "part", "p_brand")
    found = rt.exact_candidates(_no_filters(asked.withColumn("query_id", F.col("query"))), aliases)
    return found.select(F.col("query_id").alias("query"), "chunk_id", "value")


@registry.add(
    f"""
    WITH asked AS (
      SELECT o_orderkey AS query_id, 'Order ' || o_orderkey || ' of Customer#' || lpad(o_custkey::VARCHAR, 9, '0')
             || ', ' || o_orderpriority AS query FROM orders),
    words AS (
      SELECT query_id, length({KEY.format('query')}) AS whole,
             regexp_extract_all({FOLDED.format('query')}, '[0-9a-z]+') AS w FROM asked),
    keys AS (
      SELECT DISTINCT query_id, whole, array_to_string(w[s:s + n - 1], '') AS key
      FROM words, (SELECT unnest([1, 2, 3, 4]) AS n), (SELECT unnest(range(1, 40)) AS s)
      WHERE s + n - 1 <= len(w)),
    found AS (
      SELECT query_id, whole, c_custkey AS chunk_id, key FROM keys
      JOIN customer ON key = {KEY.format('c_name')}
      WHERE length(key) >= 2 AND NOT regexp_matches(key, '^[0-9]'))
    SELECT query_id, chunk_id, round(max(least(0.99, 0.80 + 0.19 * length(key) / whole)), 6) AS value
    FROM found GROUP BY ALL
    """
)
def alias_contained(spark, sf_dir):
    """Customer names mentioned inside an order sentence."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")).select(
        F.col("o_orderkey").alias("query_id"),
        F.concat(
            F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" of Customer#"),
            F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit(", "), F.col("o_orderpriority"),
        ).alias("query"),
    )
    aliases = _alias_table(table(spark, sf_dir, "customer"), "c_name", "c_custkey", "customer", "c_nationkey")
    found = rt.contained_candidates(_no_filters(orders), aliases)
    return found.select("query_id", "chunk_id", F.round("value", 6).alias("value"))


CENTROIDS = """
parts AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings),
means AS (SELECT label, d, avg(x) AS x FROM parts GROUP BY ALL),
queries AS (SELECT label AS query_id, list(x ORDER BY d) AS q FROM means GROUP BY label)
"""
KNN = f"""
{CENTROIDS},
sims AS (
  SELECT query_id, vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], q), 9) AS s
  FROM embeddings, queries),
knn AS (
  SELECT query_id, vec_id, label, greatest(0, least(1, s)) AS value,
         row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS r
  FROM sims QUALIFY r <= 20)
"""


def label_centroids(spark, sf_dir):
    """One query per label: the mean vector of the label."""
    parts = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("d", "x"))
    means = parts.groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(F.col("label").alias("query_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("embedding")
    )


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


@registry.add(f"WITH {KNN} SELECT query_id, vec_id, round(value, 6) AS similarity FROM knn")
def vector_knn(spark, sf_dir):
    found = rt.vector_candidates(label_centroids(spark, sf_dir), _vectors(spark, sf_dir), 20)
    return found.select("query_id", F.col("chunk_id").alias("vec_id"), F.round("value", 6).alias("similarity"))


# Three methods per label: nearest vectors, the label's own vectors in id order, and
# the first vector of the next label as an alias match.
FUSED = f"""
{KNN},
lexical AS (
  SELECT label AS query_id, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r
  FROM embeddings QUALIFY r <= 20),
alias AS (SELECT (label + 9) % 10 AS query_id, min(vec_id) AS vec_id, 0.80 + 0.019 * max(label) AS value
          FROM embeddings GROUP BY label),
candidates AS (
  SELECT query_id, vec_id, 'vector' AS m, value FROM knn
  UNION ALL SELECT query_id, vec_id, 'bm25', 1.0 / r FROM lexical
  UNION ALL SELECT query_id, vec_id, 'exact', value FROM alias),
wide AS (
  SELECT query_id, vec_id, max(value) FILTER (m = 'exact') AS e, max(value) FILTER (m = 'bm25') AS b,
         max(value) FILTER (m = 'vector') AS v FROM candidates GROUP BY ALL),
based AS (
  SELECT *, greatest(coalesce(e, 0), 0.65 * coalesce(b, 0), 0.60 * coalesce(v, 0)) AS base,
         (e IS NOT NULL)::INT + (b IS NOT NULL)::INT + (v IS NOT NULL)::INT AS n FROM wide),
fused AS (
  SELECT query_id, vec_id, concat_ws(',', CASE WHEN e IS NOT NULL THEN 'exact' END,
         CASE WHEN b IS NOT NULL THEN 'bm25' END, CASE WHEN v IS NOT NULL THEN 'vector' END) AS methods,
         round(CASE WHEN n > 1 THEN least(1.0, base + 0.05 * (n - 1)) ELSE base END, 6) AS score
  FROM based WHERE NOT (e IS NULL AND b IS NULL AND v < 0.52)
  AND CASE WHEN n > 1 THEN least(1.0, base + 0.05 * (n - 1)) ELSE base END >= 0.12)
"""
DIVERSE = f"""
{FUSED},
spread AS (
  SELECT f.*, e.label::VARCHAR AS entity_id,
         row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, f.vec_id) AS er
  FROM fused f JOIN embeddings e USING (vec_id) QUALIFY er <= 2),
hits AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id, vec_id) AS rank
  FROM spread QUALIFY rank <= 5)
"""


def _fused(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    nearest = rt.vector_candidates(label_centroids(spark, sf_dir), vectors, 20)
    own = top_per(vectors, ["label"], [F.col("chunk_id")], 20).select(
        F.col("label").alias("query_id"), "chunk_id", F.lit("bm25").alias("method"), (1.0 / F.col("rank")).alias("value")
    )
    alias = vectors.groupBy("label").agg(F.min("chunk_id").alias("chunk_id")).select(
        ((F.col("label") + 9) % 10).alias("query_id"), "chunk_id", F.lit("exact").alias("method"),
        (0.80 + 0.019 * F.col("label")).alias("value"),
    )
    return rt.fuse(nearest.unionByName(own).unionByName(alias))


@registry.add(f"WITH {FUSED} SELECT * FROM fused")
def hybrid_fusion(spark, sf_dir):
    return _fused(spark, sf_dir).select(
        "query_id", F.col("chunk_id").alias("vec_id"), F.array_join("methods", ",").alias("methods"), "score"
    )


def _diverse(spark, sf_dir):
    labels = _vectors(spark, sf_dir).select(
        "chunk_id", F.col("label").cast("string").alias("entity_id"), F.lit("vector").alias("entity_type")
    )
    return rt.diversify(_fused(spark, sf_dir).join(labels, "chunk_id"), 5)


@registry.add(f"WITH {DIVERSE} SELECT query_id, vec_id, entity_id, score, rank FROM hits")
def diversified_topk(spark, sf_dir):
    return _diverse(spark, sf_dir).select(
        "query_id", F.col("chunk_id").alias("vec_id"), "entity_id", "score", F.col("rank").cast("long").alias("rank")
    )


@registry.add(
    f"""
    WITH {DIVERSE},
    cases AS (
      SELECT DISTINCT label AS id, label::VARCHAR AS entity, ((label + 1) % 10)::VARCHAR AS other, FALSE AS none FROM embeddings
      UNION ALL SELECT DISTINCT label + 100, 'x', 'x', TRUE FROM embeddings),
    per_case AS (
      SELECT c.id, c.none, count(h.vec_id) AS n,
             (count(DISTINCT h.entity_id) FILTER (h.entity_id IN (c.entity, c.other))) / 2.0 AS recall,
             1.0 / min(h.rank) FILTER (h.entity_id IN (c.entity, c.other)) AS rr
      FROM cases c LEFT JOIN hits h ON h.query_id = c.id GROUP BY ALL),
    final AS (
      SELECT n, none, CASE WHEN none THEN (n = 0)::INT::DOUBLE ELSE recall END AS recall,
             CASE WHEN none THEN (n = 0)::INT::DOUBLE ELSE coalesce(rr, 0) END AS rr FROM per_case)
    SELECT count(*) AS case_count, round(avg(recall), 6) AS recall_at_k, round(avg(rr), 6) AS mrr,
           avg((n = 0)::INT) FILTER (none) AS no_answer_accuracy, round(avg(n), 6) AS mean_latency_ms,
           (list_sort(list(n)))[greatest(1, least(count(*), (count(*) * 0.95)::DOUBLE::DECIMAL(18, 6)::BIGINT))]::DOUBLE AS p95_latency_ms,
           'hybrid' AS mode, avg(recall) >= 0.9 AND avg(rr) >= 0.85 AS passed
    FROM final
    """
)
def retrieval_eval(spark, sf_dir):
    """Two expected labels per query, and queries that must stay without an answer."""
    hits = _diverse(spark, sf_dir).select("query_id", "rank", "entity_id", F.col("entity_id").alias("source_id"))
    labels = table(spark, sf_dir, "embeddings").select("label").distinct()
    both = F.array(F.col("label").cast("string"), ((F.col("label") + 1) % 10).cast("string"))
    cases = labels.select(
        F.col("label").alias("query_id"), both.alias("expected_entities"), both.alias("expected_sources"),
        F.lit(False).alias("expect_no_answer"),
    ).unionByName(
        labels.select(
            (F.col("label") + 100).alias("query_id"), F.array(F.lit("x")).alias("expected_entities"),
            F.array(F.lit("x")).alias("expected_sources"), F.lit(True).alias("expect_no_answer"),
        )
    )
    scored = ev.score_cases(cases, hits).withColumn("work", F.size("entities").cast("double"))
    report = ev.evaluate(scored, {"recall_at_k": 0.9, "mrr": 0.85, "no_answer_accuracy": 1.0}, "hybrid", "work")
    return report.select(
        "case_count", F.round("recall_at_k", 6).alias("recall_at_k"), F.round("mrr", 6).alias("mrr"),
        "no_answer_accuracy", F.round("mean_latency_ms", 6).alias("mean_latency_ms"), "p95_latency_ms", "mode", "passed",
    )


@registry.add(
    """
    WITH r AS (SELECT event_type AS metric, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i,
                      count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT metric, n, min(value) FILTER (i >= ceil(0.5 * n)) AS p50, min(value) FILTER (i >= ceil(0.95 * n)) AS p95,
           max(value) AS max FROM r GROUP BY ALL
    """
)
def percentile_summary(spark, sf_dir):
    """Nearest-rank p50, p95 and maximum of the event value per type."""
    ranks = {"p50": (ev.ceil_rank, 0.5), "p95": (ev.ceil_rank, 0.95), "max": (ev.ceil_rank, 1.0)}
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), "value")
    return ev.order_statistics(rows, ["metric"], "value", ranks)


BUCKETS = 64


def hashed_words(texts):
    """Small deterministic text encoder: signed word hashing into 64 dimensions."""
    import re
    import zlib

    import numpy as np

    out = np.zeros((len(texts), BUCKETS), dtype=np.float32)
    for row, text in enumerate(texts):
        for word in re.findall(r"\w+", text.lower()):
            code = zlib.crc32(word.encode("utf-8"))
            out[row, code % BUCKETS] += 1.0 if code >> 16 & 1 else -1.0
    return out


@registry.add()
def hybrid_search(spark, sf_dir):
    """Alias, BM25 and vector search together: benchmark texts against documents, by every term and alias of a text."""
    docs = spread(table(spark, sf_dir, "documents"))
    name = F.concat(F.lit("doc "), F.col("doc_id").cast("string"))
    chunks = docs.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("lang").alias("entity_type"),
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("entity_id"), name.alias("name_zh"), name.alias("name_en"),
        F.array("source").alias("aliases"), F.col("source").alias("title"), "text", F.lit("1").alias("game_version"),
        F.lit("table").alias("source_type"), F.lit(False).alias("stale"),
    )
    asked = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )
    index = ix.build_keyword_index(chunks)
    fields = stage(index.fields, "fields")
    index = ix.KeywordIndex(
        stage(index.chunks, "chunks"), stage(index.aliases, "aliases"), fields, stage(ix.postings(fields), "postings")
    )
    vectors = ix.build_vectors(index.chunks, hashed_words)
    embedded = ix.embed(asked, hashed_words, "query_id", F.col("query"))
    hits = rt.hybrid_search(asked, index, vectors=vectors, query_vectors=embedded, alias_cap=None, max_terms=None)
    return hits.select(
        F.col("query_id").alias("item_id"), "rank", "chunk_id", F.array_join("methods", ",").alias("methods"), "score"
    )
