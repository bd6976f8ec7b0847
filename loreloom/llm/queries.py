"""Registered queries of the operators in this subpackage, with their SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreloom.catalog import Registry, table
from loreloom.llm import (
    backoff, bloom_dedup, collocations, cross_polytope, debruijn, hyperminhash, line_spread, merkle, packing, secret_scan, segments,
    spaced_seeds, tool_links,
)

registry = Registry()

#: The tool that the conversations' turns are read as.
ASK = {"ask": {"prompt": ("string", True), "turn": ("integer", True)}}


@registry.add(
    r"""
    WITH turns AS (SELECT conv_id, turn, role, text, 'c' || conv_id || '-' || turn AS own,
                          'c' || conv_id || '-' || (turn - 1) AS asked FROM conversations),
    calls AS (SELECT * FROM turns WHERE role = 'user'),
    results AS (SELECT conv_id, asked, count(*) AS n, min_by(text, (turn, text)) AS content
                FROM turns WHERE role = 'assistant' GROUP BY ALL),
    firsts AS (SELECT conv_id, own, min(turn) AS first_turn FROM calls GROUP BY ALL)
    SELECT c.conv_id, c.turn, c.own AS call_id, c.turn AS after_turn, 0 AS hops, coalesce(r.n, 0) AS n_results,
           CASE WHEN c.text IS NULL THEN 'missing: prompt;' ELSE '' END
           || CASE WHEN c.turn >= 2 AND d.own IS NULL THEN 'missing dependency;' ELSE '' END
           || CASE WHEN r.n IS NULL THEN 'no result;' ELSE '' END AS errors,
           '{"arguments":{"prompt":' || coalesce(to_json(c.text)::VARCHAR, 'null') || ',"turn":' || c.turn || '},"call_id":"' || c.own
           || '","depends_on":[' || CASE WHEN c.turn >= 2 THEN '"c' || c.conv_id || '-' || (c.turn - 2) || '"' ELSE '' END
           || '],"name":"ask","result":' || coalesce(to_json(r.content)::VARCHAR, 'null') || '}' AS json
    FROM calls c LEFT JOIN results r ON r.conv_id = c.conv_id AND r.asked = c.own
    LEFT JOIN (SELECT DISTINCT conv_id, own FROM calls) d
           ON d.conv_id = c.conv_id AND d.own = 'c' || c.conv_id || '-' || (c.turn - 2)
    """
)
def op1_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn is a call of ``ask`` that builds on the one before; the assistant's turn after it is its result."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conv"), "turn", "role", "text")
    own = lambda turn: F.concat(F.lit("c"), F.col("conv"), F.lit("-"), turn)
    calls = turns.where("role = 'user'").select(
        "conv", "turn", own(F.col("turn")).alias("call_id"), F.lit("ask").alias("name"),
        F.to_json(F.struct("turn", F.col("text").alias("prompt")), {"ignoreNullFields": "false"}).alias("arguments"),
        F.when(F.col("turn") >= 2, F.array(own(F.col("turn") - 2))).otherwise(F.expr("cast(array() as array<string>)")).alias("depends_on"),
    )
    results = turns.where("role = 'assistant'").select("conv", "turn", own(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    linked = tool_links.link(calls, results, ASK)
    text = F.array_join(F.transform("errors", lambda e: F.concat(e, F.lit(";"))), "")
    return linked.select(F.col("conv").alias("conv_id"), "turn", "call_id", "after_turn", "hops", "n_results", text.alias("errors"), "json")


@registry.add()
def op2_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


@registry.add()
def op3_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secrets(table(spark, sf_dir, "documents")))


@registry.add()
def op4_debruijn_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = debruijn.remove_repeats(table(spark, sf_dir, "documents"), size=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@registry.add(
    r"""
    WITH words AS (
      SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    total AS (SELECT sum(len(w)) AS n FROM words),
    flat AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM words),
    p AS (
      SELECT doc_id, i, lag(w, 2) OVER o AS u, lag(w) OVER o AS v, w FROM flat WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    o1 AS (SELECT doc_id, w, count(*) AS o FROM p GROUP BY ALL), l1 AS (SELECT *, sum(o) OVER (PARTITION BY w) - o AS c FROM o1),
    o2 AS (SELECT doc_id, v, w, count(*) AS o FROM p WHERE v IS NOT NULL GROUP BY ALL),
    l2 AS (SELECT *, sum(o) OVER (PARTITION BY v, w) - o AS c FROM o2),
    o3 AS (SELECT doc_id, u, v, w, count(*) AS o FROM p WHERE u IS NOT NULL GROUP BY ALL),
    l3 AS (SELECT *, sum(o) OVER (PARTITION BY u, v, w) - o AS c FROM o3),
    s AS (
      SELECT p.doc_id, i, coalesce(abc.c, 0) AS abc, coalesce(ab.c, 0) AS ab, coalesce(bc.c, 0) AS bc, b.c AS b,
             greatest(c.c, 1) / greatest((SELECT n FROM total) - len(d.w), 1) AS single
      FROM p JOIN words d USING (doc_id) JOIN l1 c ON c.doc_id = p.doc_id AND c.w = p.w
      LEFT JOIN l1 b ON b.doc_id = p.doc_id AND b.w = p.v LEFT JOIN l2 bc ON bc.doc_id = p.doc_id AND bc.v = p.v AND bc.w = p.w
      LEFT JOIN l2 ab ON ab.doc_id = p.doc_id AND ab.v = p.u AND ab.w = p.v
      LEFT JOIN l3 abc ON abc.doc_id = p.doc_id AND abc.u = p.u AND abc.v = p.v AND abc.w = p.w),
    sums AS (
      SELECT doc_id, count(*) FILTER (abc > 0 OR i = 1 AND bc > 0) AS n_seen,
             sum(CASE WHEN abc > 0 THEN ln(abc / greatest(ab, 1))
                      WHEN bc > 0 THEN ln(bc / greatest(b, 1)) + CASE WHEN i >= 2 THEN ln(0.4) ELSE 0 END
                      ELSE ln(single) + ln(0.4) * least(i, 2) END) AS log_score
      FROM s GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_seen, 0) AS n_seen, round(log_score, 4) AS log_score,
           round(log_score / len(w), 6) AS mean_log_score
    FROM words LEFT JOIN sums USING (doc_id)
    """
)
def op5_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = backoff.scores(table(spark, sf_dir, "documents"), alpha=0.4, order=3)
    return out.withColumn("log_score", F.round("log_score", 4)).withColumn("mean_log_score", F.round("mean_log_score", 6))


@registry.add()
def op6_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified overlaps of documents with benchmark items."""
    found = spaced_seeds.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "start", "n_words", "n_matching")


@registry.add()
def op7_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = segments.fit(docs, table(spark, sf_dir, "labels"))
    scored = segments.score(docs, model)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages"
    )


@registry.add()
def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), remembered=200_000)


@registry.add(
    r"""
    WITH lines AS (
      SELECT doc_id, source, i, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key
      FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i
            FROM documents WHERE text IS NOT NULL)),
    bad AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT source) + bool_or(source IS NULL)::INT >= 8)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (key IN (SELECT key FROM bad)) AS n_removed,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (key NOT IN (SELECT key FROM bad)), '')) AS kept_sha256
    FROM lines GROUP BY doc_id
    UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
    """
)
def op9_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_spread.remove_boilerplate(table(spark, sf_dir, "documents"), sites=8)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@registry.add(
    r"""
    WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
    FROM t WINDOW w AS (PARTITION BY text_sha256)
    """
)
def op10_bloom_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@registry.add(
    r"""
    WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
      FROM (SELECT lang, unnest(regexp_split_to_array(
              translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
    starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
    grams AS (
      SELECT lang, w[i : i + size - 1] AS g FROM starts, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE i + size - 1 <= len(w)),
    counts AS (SELECT lang, g, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
    totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
    cuts AS (SELECT lang, g, f AS a, unnest(range(1, len(g))) AS k FROM counts WHERE len(g) > 1),
    scored AS (
      SELECT c.lang, c.g, c.a, c.k, l.f AS l, r.f AS r, ((2000000::HUGEINT * c.a) // (l.f::HUGEINT + r.f))::BIGINT AS score
      FROM cuts c JOIN counts l ON l.lang = c.lang AND l.g = c.g[1 : c.k] JOIN counts r ON r.lang = c.lang AND r.g = c.g[c.k + 1 :]),
    lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
    inner_ AS (
      SELECT lang, h[i : i + size - 1] AS g, max(f) AS longer
      FROM (SELECT lang, g AS h, f, unnest(range(1, len(g) + 1)) AS i FROM counts WHERE len(g) > 2), (SELECT unnest([2, 3]) AS size)
      WHERE size < len(h) AND i + size - 1 <= len(h) GROUP BY ALL),
    left_ AS (
      SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM lowest LEFT JOIN inner_ USING (lang, g)
      WHERE longer IS NULL OR 100 * longer < 80 * a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM left_ JOIN totals USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
    """
)
def op11_prefix_free_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=30, contained=80, top=2000)


@registry.add(
    r"""
    WITH RECURSIVE fields AS (
      SELECT *, CASE WHEN bits % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS n_changed
      FROM (SELECT *, xor(list_reduce(
              list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
              lambda a, b: xor(xor(a, b) // 2, (xor(a, b) % 2) * 3988292384)), 4294967295) AS bits FROM documents)),
    leaves AS (
      SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
             sha256(head || coalesce(strlen(n_changed::VARCHAR) || ':' || n_changed, '-') || tail) AS claimed
      FROM (SELECT doc_id, lang, n_chars, n_changed,
                   coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                   || coalesce(strlen(lang) || ':' || lang, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS tail FROM fields)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS j FROM leaves),
    levels AS (
      SELECT lang, 0 AS level, list(leaf ORDER BY j) AS h FROM placed GROUP BY lang
      UNION ALL
      SELECT lang, level + 1, list_transform(range(0, len(h), 2), lambda k: sha256(h[k + 1] || coalesce(h[k + 2], ''))) FROM levels WHERE len(h) > 1),
    subroots AS (SELECT lang, h[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS top FROM levels WHERE len(h) = 1),
    tops AS (
      SELECT 0 AS level, list(subroot ORDER BY top) AS h FROM subroots
      UNION ALL
      SELECT level + 1, list_transform(range(0, len(h), 2), lambda k: sha256(h[k + 1] || coalesce(h[k + 2], ''))) FROM tops WHERE len(h) > 1),
    steps AS (
      SELECT p.doc_id, p.lang, p.leaf, level AS step, h[xor(j >> level, 1) + 1] AS sibling, (j >> level) % 2 AS odd
      FROM placed p JOIN levels l ON l.lang IS NOT DISTINCT FROM p.lang WHERE len(h) > 1
      UNION ALL
      SELECT p.doc_id, p.lang, p.leaf, 1000 + level, h[xor(top >> level, 1) + 1], (top >> level) % 2
      FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang, tops WHERE len(h) > 1),
    paths AS (
      SELECT doc_id, lang, leaf, list({'s': coalesce(sibling, ''), 'o': odd} ORDER BY step) AS path FROM steps GROUP BY ALL),
    folded AS (
      SELECT p.doc_id, p.lang, p.leaf, coalesce(path, []) AS path, 0 AS i, claimed AS node
      FROM placed p LEFT JOIN paths q ON q.doc_id IS NOT DISTINCT FROM p.doc_id AND q.lang IS NOT DISTINCT FROM p.lang AND q.leaf = p.leaf
      UNION ALL
      SELECT doc_id, lang, leaf, path, i + 1, CASE WHEN path[i + 1].o = 1 THEN sha256(path[i + 1].s || node) ELSE sha256(node || path[i + 1].s) END
      FROM folded WHERE i < len(path))
    SELECT f.doc_id, f.leaf, s.subroot, t.h[1] AS root, sha256(array_to_string(list_transform(path, lambda x: x.s), '')) AS proof_sha256,
           f.node AS folded_root, f.node = t.h[1] AS verified
    FROM folded f JOIN subroots s ON s.lang IS NOT DISTINCT FROM f.lang, tops t WHERE i = len(path) AND len(t.h) = 1
    """
)
def op12_merkle_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, proofs and roots of the documents by language; every seventh row by checksum is tampered with before its proof is checked."""
    docs = table(spark, sf_dir, "documents")
    fields = lambda n: [F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text")]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    own = merkle.leaf(*fields(F.col("n_chars")))
    rows = docs.select("doc_id", "lang", own.alias("leaf"), F.when(chosen, merkle.leaf(*fields(F.col("n_chars") + 1))).alias("changed"))
    proven = merkle.Manifest(rows, "lang", "doc_id").proven()
    folded = merkle.fold(F.coalesce("changed", "leaf"), F.col("proof"))
    checked = proven.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))


@registry.add()
def op13_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)
