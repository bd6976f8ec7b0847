"""Duplicate removal over ``documents``."""

from pyspark.sql import functions as F

from loreloom.catalog import registry, table
from loreloom.functions import text as tx
from loreloom.operators import dedup
from loreloom.session import spread

KEY = r"regexp_replace(replace(lower(text), 'ß', 'ss'), '[^0-9a-z\x{3400}-\x{9fff}]+', '', 'g')"

# Signature of every document: distinct tokens are hashed once, then voted by count.
SIGNATURES = rf"""
words AS (
  SELECT doc_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'),
         '[0-9a-z]+|[\x{{3400}}-\x{{9fff}}]')) AS w FROM documents),
counts AS (SELECT doc_id, w, count(*) AS n FROM words GROUP BY ALL),
hashes AS (
  SELECT w, [('0x' || substr(sha256(w), 1 + 4 * i, 4))::INT FOR i IN [3, 2, 1, 0]] AS h
  FROM (SELECT DISTINCT w FROM counts)),
votes AS (
  SELECT doc_id, b.b AS bit, sum(CASE WHEN (h[1 + b.b // 16] >> (b.b % 16)) & 1 = 1 THEN n ELSE -n END) AS v
  FROM counts JOIN hashes USING (w), (SELECT unnest(range(64)) AS b) b GROUP BY ALL),
banded AS (
  SELECT doc_id, bit // 16 AS band, sum(CASE WHEN v >= 0 THEN 1 << (bit % 16) ELSE 0 END)::INT AS value
  FROM votes GROUP BY ALL),
signed AS (
  SELECT d.doc_id, sha256({KEY}) AS checksum, length(text) AS text_length,
         coalesce(max(value) FILTER (band = 0), 65535) AS b0,
         coalesce(max(value) FILTER (band = 1), 65535) AS b1,
         coalesce(max(value) FILTER (band = 2), 65535) AS b2,
         coalesce(max(value) FILTER (band = 3), 65535) AS b3
  FROM documents d LEFT JOIN banded USING (doc_id) GROUP BY ALL)
"""


@registry.add(
    f"""
    SELECT doc_id, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY checksum)
                        THEN 'kept' ELSE 'exact' END AS status
    FROM (SELECT doc_id, sha256({KEY}) AS checksum FROM documents)
    """
)
def exact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(tx.dedupe_key(F.col("text")), 256).alias("checksum")
    )
    first = dedup.drop_exact(docs, ["doc_id"], "doc_id").select("doc_id", F.lit("kept").alias("status"))
    return docs.join(first, "doc_id", "left").select(
        "doc_id", F.coalesce("status", F.lit("exact")).alias("status")
    )


@registry.add(f"WITH {SIGNATURES} SELECT doc_id, text_length, b0, b1, b2, b3 FROM signed")
def simhash_bands(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id",
        F.length("text").alias("text_length"),
        dedup.simhash64(F.col("text")).alias("s"),
    ).select(
        "doc_id", "text_length", *[dedup.band(F.col("s"), i).alias(f"b{i}") for i in range(4)]
    )


@registry.add(
    f"""
    WITH {SIGNATURES},
    folded AS (
      SELECT b0, b1, b2, b3, text_length, min(doc_id) AS id, count(*) AS copies
      FROM signed GROUP BY ALL),
    bands AS (
      SELECT *, unnest([0, 1, 2, 3]) AS band, unnest([b0, b1, b2, b3]) AS value FROM folded),
    pairs AS (
      SELECT DISTINCT l.id AS left_id, r.id AS right_id, l.copies AS left_copies,
             r.copies AS right_copies,
             bit_count(xor(l.b0, r.b0)) + bit_count(xor(l.b1, r.b1))
             + bit_count(xor(l.b2, r.b2)) + bit_count(xor(l.b3, r.b3)) AS hamming
      FROM bands l JOIN bands r ON l.band = r.band AND l.value = r.value AND l.id < r.id
      WHERE least(l.text_length, r.text_length) / greatest(l.text_length, r.text_length) >= 0.92)
    SELECT * FROM pairs WHERE hamming <= 3
    """
)
def near_pairs(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return dedup.near_pairs(dedup.signatures(docs), "doc_id")


@registry.add(
    f"""
    WITH RECURSIVE {SIGNATURES},
    n AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS i FROM signed),
    adj AS (
      SELECT b.i, list(a.i) AS earlier FROM n b JOIN n a ON a.i < b.i AND (a.checksum = b.checksum OR (
             least(a.text_length, b.text_length) / greatest(a.text_length, b.text_length) >= 0.92
             AND bit_count(xor(a.b0, b.b0)) + bit_count(xor(a.b1, b.b1)) + bit_count(xor(a.b2, b.b2)) + bit_count(xor(a.b3, b.b3)) <= 3))
      GROUP BY b.i),
    r AS (SELECT n.i, coalesce(earlier, []::BIGINT[]) AS earlier FROM n LEFT JOIN adj USING (i)),
    walk AS (
      SELECT 0::BIGINT AS i, []::BIGINT[] AS kept
      UNION ALL
      SELECT r.i, CASE WHEN list_has_any(kept, r.earlier) THEN kept ELSE list_append(kept, r.i) END
      FROM walk JOIN r ON r.i = walk.i + 1),
    kept AS (SELECT unnest(kept) AS i FROM walk WHERE i = (SELECT count(*) FROM n)),
    sums AS (SELECT checksum, min(i) AS first FROM n WHERE i IN (SELECT i FROM kept) GROUP BY checksum)
    SELECT doc_id, CASE WHEN i IN (SELECT i FROM kept) THEN 'kept' WHEN first < i THEN 'exact' ELSE 'near' END AS status
    FROM n LEFT JOIN sums USING (checksum)
    """
)
def greedy_dedup(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return dedup.greedy_dedup(dedup.signatures(docs), "doc_id", ["doc_id"]).drop("checksum")
