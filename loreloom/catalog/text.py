"""Text normal forms and text preparation over ``documents`` and ``conversations``."""

from pyspark.sql import functions as F

from loreloom.catalog import registry, table
from loreloom.functions import text as tx
from loreloom.operators import answers as an, events as ev, memory as me

FOLD = "replace(lower(text), 'ß', 'ss')"
# DuckDB's upper() keeps one letter for one; the rule is the full mapping, where one letter may become several (ß: SS).
LONGER = {c: c.upper() for c in map(chr, range(0x80, 0xFB18)) if len(c.upper()) > 1}
UPPER = "CASE {0} " + " ".join(f"WHEN '{c}' THEN '{u}'" for c, u in LONGER.items()) + " ELSE upper({0}) END"
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


@registry.add(
    rf"""
    WITH t AS (SELECT doc_id, text, regexp_replace({STRIP.format('text')}, '[ _]+', ' ', 'g') AS k FROM documents)
    SELECT doc_id,
      md5(regexp_replace({FOLD}, '[^0-9a-z\x{{3400}}-\x{{9fff}}]+', '', 'g')) AS alias_key,
      md5(regexp_replace({FOLD}, '[^0-9a-z\x{{4e00}}-\x{{9fff}}]+', '', 'g')) AS memory_key,
      md5(trim(regexp_replace(regexp_replace(text, '[ \t\f\v]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'), ' ' || chr(10) || '|;：')) AS plain,
      md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS squeezed,
      md5(CASE WHEN instr(k, ':') > 0 THEN substr(k, 1, instr(k, ':')) ELSE '' END
          || {UPPER.format("substr(k, 1 + instr(k, ':'), 1)")} || substr(k, 2 + instr(k, ':'))) AS title_key
    FROM t
    """
)
def normal_forms(spark, sf_dir):
    """Every normal form of every document, as digests of the whole text."""
    t = F.col("text")
    forms = {
        "alias_key": tx.alias_key(t), "memory_key": tx.memory_key(t), "plain": tx.norm_plain(t),
        "squeezed": tx.squeeze(t), "title_key": tx.title_key(t),
    }
    return table(spark, sf_dir, "documents").select("doc_id", *[F.md5(c).alias(n) for n, c in forms.items()])


@registry.add(
    r"""
    WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    tidy AS (SELECT doc_id, i, trim(regexp_replace(regexp_replace(l, '^\s*[#*:;]+\s*', ''), '\s+', ' ', 'g')) AS l FROM lines)
    SELECT doc_id, md5(regexp_replace(regexp_replace(string_agg(l, chr(10) ORDER BY i), '\n{3,}', chr(10) || chr(10), 'g'),
                                      '^\s+|\s+$', '', 'g')) AS block
    FROM tidy GROUP BY doc_id
    """
)
def block_form(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.norm_block(F.col("text"))).alias("block"))


@registry.add(
    r"""
    WITH cleaned AS (
      SELECT item_id, regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), '["''():*^]', ' ', 'g'), '^\s+|\s+$', '', 'g') AS q FROM benchmark),
    placed AS (
      SELECT item_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS place FROM (
        SELECT item_id, list_concat([q], regexp_extract_all(q, '[0-9a-z]+|[\x{3400}-\x{9fff}]{2,}')) AS ts FROM cleaned)),
    firsts AS (SELECT item_id, term, min(place) AS place FROM placed WHERE term <> '' GROUP BY ALL)
    SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY place) AS term_no FROM firsts QUALIFY term_no <= 8
    """
)
def query_terms(spark, sf_dir):
    terms = F.posexplode(tx.query_terms(F.col("text"))).alias("n", "term")
    return table(spark, sf_dir, "benchmark").select("item_id", terms).select(
        "item_id", "term", (F.col("n") + 1).cast("long").alias("term_no")
    )


@registry.add(
    rf"""
    WITH w AS (SELECT item_id, regexp_extract_all({FOLD}, '[0-9a-z]+') AS w FROM benchmark),
    keys AS (
      SELECT DISTINCT item_id, array_to_string(w[s:s + n - 1], '') AS key, n
      FROM w, (SELECT unnest([1, 2, 3, 4]) AS n), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS s))
    SELECT DISTINCT item_id, key FROM keys WHERE length(key) >= 2 AND NOT (n = 1 AND regexp_matches(key, '^[0-9]+$'))
    """
)
def contained_keys(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(tx.contained_keys(F.col("text"))).alias("key"))


@registry.add(
    """
    SELECT o_orderkey, o_orderkey % 3 <> 2 AS exact_id, o_orderpriority LIKE '%URGENT%' AND o_orderkey % 3 = 2 AS out_of_scope
    FROM orders
    """
)
def query_flags(spark, sf_dir):
    """Explicit ids and out-of-scope texts among queries written from orders."""
    number = F.col("o_orderkey").cast("string")
    query = (
        F.when(F.col("o_orderkey") % 3 == 0, number)
        .when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Order:"), number))
        .otherwise(F.concat_ws(" ", F.lit("order"), number, F.lower("o_orderpriority")))
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", tx.is_exact_id(query).alias("exact_id"), tx.is_out_of_scope(query, [r"\burgent\b"]).alias("out_of_scope")
    )


@registry.add(
    """
    WITH r AS (SELECT conv_id, turn, role || ': ' || text AS u FROM conversations
               QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 12)
    SELECT conv_id, right(string_agg(u, '；' ORDER BY turn), 600) AS summary FROM r GROUP BY conv_id
    """
)
def carried_summary(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return an.carry_summary(turns, "conv_id", "turn", F.concat("role", F.lit(": "), "text"))


@registry.add(
    """
    WITH live AS (SELECT * FROM conversations QUALIFY turn // 4 = max(turn // 4) OVER (PARTITION BY conv_id))
    SELECT conv_id, left(string_agg(text, '' ORDER BY turn), 1000) AS text FROM live WHERE text <> '' GROUP BY conv_id
    """
)
def assembled_text(spark, sf_dir):
    """Deltas of the latest generation of each conversation as one bounded text."""
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("response_id"), F.floor(F.col("turn") / 4).alias("generation"),
        F.col("turn").alias("seq"), F.col("text").alias("delta"),
    )
    current = turns.groupBy("response_id").agg(F.max("generation").alias("generation"))
    return ev.assemble(turns, current).select(F.col("response_id").alias("conv_id"), "text")


TERMS = {"nicht": "NICHT", "que la": "QUE-LA", "the": "THE", "ß": "ss", "und": "UND"}


@registry.add(
    r"""
    SELECT conv_id, turn, md5(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(
      regexp_replace(text, '^\s+|\s+$', '', 'g'), 'que la', 'QUE-LA', 'gi'), 'nicht', 'NICHT', 'gi'), 'the', 'THE', 'gi'), 'ß', 'ss'),
      'und', 'UND', 'gi')) AS text
    FROM conversations
    """
)
def corrected_terms(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return an.correct_terms(turns, "text", TERMS).withColumn("text", F.md5("text"))


@registry.add(
    r"""
    WITH c AS (
      SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(text, 'https?://\S+', '', 'g'),
             '(?i)\b(?:chunk|entity|request|state)[-_ ]?id\b[^，。；]*', '', 'g'), '\s+', ' ', 'g')) AS t FROM conversations),
    s AS (
      SELECT conv_id, turn, unnest(l) AS s, generate_subscripts(l, 1) AS i
      FROM (SELECT *, regexp_extract_all(t, '[^。！？；]*[。！？；]|[^。！？；]+$') AS l FROM c)),
    p AS (
      SELECT conv_id, turn, i, unnest(l) AS p, generate_subscripts(l, 1) AS j
      FROM (SELECT *, regexp_extract_all(trim(s), '(?s)\s*(.{1,120}$|.{60,119}[，、]|.{1,120})', 1) AS l FROM s))
    SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i, j) - 1 AS segment_no, trim(p) AS segment
    FROM p WHERE trim(p) <> ''
    """
)
def text_segments(spark, sf_dir):
    """Every turn cut into pieces of at most 120 characters."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return an.segment_text(turns, "text", 120).select("conv_id", "turn", "segment_no", "segment")


MARKERS = ("license", "copyright", "@", "token=", "api key")


@registry.add(
    """
    SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'copyright')
    OR contains(text, '@') OR contains(lower(text), 'token=') OR contains(lower(text), 'api key')
    """
)
def unsafe_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(tx.looks_unsafe(F.col("text"), MARKERS)).select("doc_id")


STATED = (
    (r"(?:^| )[tT]he ([a-z]{1,24})", "profile", "profile:first", "name "),
    (r"(?:^| )und ([a-zäöüß]{1,24})", "guidance_preference", "guidance:und", "also "),
    (r"(?:^| )de ([a-zéèêç]{1,24})", "stable_preference", None, "likes "),
)


@registry.add(
    r"""
    WITH v AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS v FROM conversations WHERE role = 'user'),
    p AS (
      SELECT conv_id, turn, 'profile' AS kind, 'name ' || regexp_extract(v, '(?:^| )[tT]he ([a-z]{1,24})', 1) AS content,
             regexp_extract(v, '(?:^| )[tT]he ([a-z]{1,24})', 1) AS d FROM v WHERE v <> '' AND length(v) <= 300
      UNION ALL
      SELECT conv_id, turn, 'guidance_preference', 'also ' || regexp_extract(v, '(?:^| )und ([a-zäöüß]{1,24})', 1),
             regexp_extract(v, '(?:^| )und ([a-zäöüß]{1,24})', 1) FROM v WHERE v <> '' AND length(v) <= 300
      UNION ALL
      SELECT conv_id, turn, 'stable_preference', 'likes ' || regexp_extract(v, '(?:^| )de ([a-zéèêç]{1,24})', 1),
             regexp_extract(v, '(?:^| )de ([a-zéèêç]{1,24})', 1) FROM v WHERE v <> '' AND length(v) <= 300)
    SELECT conv_id, turn, kind, content FROM p WHERE d <> ''
    """
)
def stated_preferences(spark, sf_dir):
    """Preference candidates out of user turns by sentence patterns."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    return me.extract_candidates(turns, STATED).select("conv_id", "turn", "kind", "content")
