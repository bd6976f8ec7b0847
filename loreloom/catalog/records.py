"""Record, alias, memory and index operators over the tables' own columns."""

from pyspark.sql import functions as F

from loreloom.catalog import registry, table
from loreloom.catalog.corpus import GRAPH_SQL, _closed
from loreloom.catalog.retrieval import document_fields
from loreloom.functions import text as tx
from loreloom.operators import answers as an, entities as en, events as ev, index as ix, memory as me
from loreloom.operators import redirects as rd, retrieve as rt, structured as sd
from loreloom.operators.scan import by_span, top_per
from loreloom.session import spread, stage

KEY = r"regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^0-9a-z\x{{3400}}-\x{{9fff}}]+', '', 'g')"
MEMORY_KEY = r"regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^0-9a-z\x{{4e00}}-\x{{9fff}}]+', '', 'g')"
BODIES = r"""
bodies AS (
  SELECT doc_id, string_split(trim(regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents),
tokens AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS position FROM bodies)
"""


@registry.add(
    f"""
    WITH {BODIES}
    SELECT term, doc_id, count(*) AS tf, md5(string_agg(position::VARCHAR, ' ' ORDER BY position)) AS positions
    FROM tokens WHERE term <> '' GROUP BY ALL
    """
)
def postings_index(spark, sf_dir):
    """Every term's documents with the places it stands at."""
    post = ix.postings(document_fields(spark, sf_dir))
    places = F.array_join(F.transform("positions", lambda p: p.cast("string")), " ")
    return post.select("term", F.col("chunk_id").alias("doc_id"), "tf", F.md5(places).alias("positions"))


@registry.add(
    rf"""
    WITH {BODIES},
    asked AS (
      SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'en' END AS lang, CASE WHEN item_id % 4 = 1 THEN 'src0' END AS source,
             CASE WHEN item_id % 5 = 2 THEN '1' END AS version, item_id % 2 = 0 AS with_stale, text FROM benchmark),
    words AS (
      SELECT item_id, array_to_string(list_slice(string_split(trim(regexp_replace(strip_accents(lower(text)), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), 1, 2), ' ') AS p
      FROM asked),
    pairs AS (
      SELECT doc_id, len(list_filter(w, lambda x: x <> '')) AS dl, unnest(w) AS term, unnest(list_append(w[2:], NULL)) AS following FROM bodies),
    counts AS (
      SELECT p, doc_id, dl, count(*) AS tf
      FROM (SELECT DISTINCT p, split_part(p, ' ', 1) AS a, nullif(split_part(p, ' ', 2), '') AS b FROM words WHERE p <> '')
      JOIN pairs ON term = a AND (b IS NULL OR following = b) GROUP BY ALL),
    meta AS (SELECT doc_id, lang, source, (doc_id % 3)::VARCHAR AS version, doc_id % 7 = 0 AS stale FROM documents)
    SELECT item_id, doc_id, dl, tf FROM words JOIN counts USING (p) JOIN asked USING (item_id) JOIN meta m USING (doc_id)
    WHERE (asked.lang IS NULL OR asked.lang = m.lang) AND (asked.source IS NULL OR asked.source = m.source)
      AND (asked.version IS NULL OR asked.version = m.version) AND (with_stale OR NOT m.stale)
    """
)
def phrase_filtered(spark, sf_dir):
    """Documents that hold the first two words of a benchmark text in order, under the query's filters; from postings."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("lang").alias("entity_type"), F.lit("e").alias("entity_id"),
        (F.col("doc_id") % 3).cast("string").alias("game_version"), F.col("source").alias("source_type"), (F.col("doc_id") % 7 == 0).alias("stale"),
    )
    none = F.array().cast("array<string>")
    id_ = F.col("item_id")
    asked = table(spark, sf_dir, "benchmark").select(
        id_.alias("query_id"), F.col("text").alias("query"),
        F.when(id_ % 3 == 0, F.array(F.lit("en"))).otherwise(none).alias("entity_types"),
        F.when(id_ % 4 == 1, F.array(F.lit("src0"))).otherwise(none).alias("source_types"),
        F.when(id_ % 5 == 2, F.lit("1")).alias("game_version"), (id_ % 2 == 0).alias("include_stale"),
        F.array_join(F.slice(F.split(F.trim(tx.search_text(F.col("text"))), " +"), 1, 2), " ").alias("phrase"),
    )
    asked = stage(asked, "asked")
    post = stage(ix.postings(document_fields(spark, sf_dir)), "postings")
    found = rt.phrase_counts(post, asked.select("phrase").distinct()).join(asked, "phrase").drop("phrase")
    return found.alias("f").join(docs.alias("c"), "chunk_id").where(rt.passes()).select(
        F.col("query_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), "dl", "tf"
    )


@registry.add(
    f"""
    WITH RECURSIVE {GRAPH_SQL}
    SELECT tail AS title_key, string_agg(source_key, ',' ORDER BY source_key) AS sources FROM closed WHERE status = 'resolved' GROUP BY tail
    """
)
def redirect_sources(spark, sf_dir):
    """The redirects that end at each page, in title order."""
    closed = _closed(spark, sf_dir)
    pages = closed.select(
        F.col("source_key").alias("title_key"), F.col("source_key").alias("title"), F.lit(1).alias("page_id"),
        F.lit(1).alias("revision_id"), F.col("source_key").alias("document_id"),
    )
    found = rd.redirect_sources(closed, pages)
    return found.select("title_key", F.array_join(F.transform("redirect_sources", lambda s: s["title"]), ",").alias("sources"))


@registry.add(
    f"""
    WITH names AS (
      SELECT p_partkey, {KEY.format('p_name')} AS k FROM part
      UNION SELECT p_partkey, {KEY.format("p_brand || ' ' || p_size")} FROM part),
    offered AS (
      SELECT o_orderkey AS position, {KEY.format("'Brand#' || (o_orderkey % 60) || ' ' || (o_orderkey % 51)")} AS k FROM orders
      UNION SELECT o_orderkey, {KEY.format('o_orderpriority')} FROM orders)
    SELECT p_partkey::VARCHAR AS title_key, min(position) AS position FROM names JOIN offered USING (k) GROUP BY p_partkey
    """
)
def override_match(spark, sf_dir):
    """Parts named, by name or by brand and size, in a list of overrides; the first in the list wins."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("title_key"), F.col("p_name").alias("title"),
        F.array(F.concat_ws(" ", "p_brand", "p_size")).alias("aliases"),
    )
    o = F.col("o_orderkey")
    overrides = table(spark, sf_dir, "orders").select(
        o.alias("position"), F.concat(F.lit("Brand#"), (o % 60).cast("string"), F.lit(" "), (o % 51).cast("string")).alias("page_title"),
        F.array("o_orderpriority").alias("match_aliases"), F.lit("t").alias("entity_type"), o.cast("string").alias("entity_id"),
        F.lit("z").alias("name_zh"), F.lit("e").alias("name_en"), F.array(F.lit("a")).alias("aliases"),
    )
    return en.match_overrides(part, overrides).select("title_key", F.col("o_id").cast("long").alias("position"))


def _part_chunks(spark, sf_dir, kind, prefix):
    part = table(spark, sf_dir, "part")
    return part.select(
        F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("chunk_id"), F.lit(kind).alias("entity_type"),
        F.concat(F.lit(prefix), (F.col("p_partkey") % 300).cast("string")).alias("entity_id"),
        F.col("p_name").alias("name_zh"), F.upper("p_name").alias("name_en"), (F.col("p_size") % 5 == 0).alias("stale"),
    )


@registry.add(
    """
    WITH named AS (
      SELECT p_partkey % 300 AS id, arg_min(p_name, 'c' || p_partkey) AS name FROM part WHERE p_size % 5 <> 0 GROUP BY ALL)
    SELECT o_orderkey, r.name AS role_name, i.name AS active_item_name
    FROM orders LEFT JOIN named r ON r.id = o_custkey % 400 LEFT JOIN named i ON i.id = o_orderkey % 350
    """
)
def resolved_identities(spark, sf_dir):
    """Names of a role and an item for every order, from the first chunk of each that is not stale."""
    players = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 400).alias("player_type"), (F.col("o_orderkey") % 350).alias("active_item")
    )
    chunks = _part_chunks(spark, sf_dir, "character", "player:").unionByName(_part_chunks(spark, sf_dir, "item", "collectible:"))
    return an.resolve_identities(players, chunks).select("o_orderkey", "role_name", "active_item_name")


@registry.add(
    """
    WITH ids AS (SELECT DISTINCT p_partkey % 400 AS collectible_id FROM part),
    corpus AS (SELECT p_partkey % 300 AS id, arg_min(p_name, 'c' || p_partkey) AS name FROM part WHERE p_size % 5 <> 0 GROUP BY ALL),
    facts AS (SELECT s_suppkey AS id, s_name AS zh, s_name || '!' AS en FROM supplier WHERE s_suppkey % 3 = 0)
    SELECT collectible_id, coalesce(f.zh, c.name) AS name_zh, coalesce(f.en, upper(c.name)) AS name_en
    FROM ids LEFT JOIN facts f ON f.id = collectible_id LEFT JOIN corpus c ON c.id = collectible_id
    WHERE coalesce(f.zh, c.name) IS NOT NULL
    """
)
def item_names(spark, sf_dir):
    """Item names: from the facts (suppliers) first, then from the corpus (parts)."""
    ids = table(spark, sf_dir, "part").select((F.col("p_partkey") % 400).alias("collectible_id")).distinct()
    facts = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(
        F.col("s_suppkey").alias("collectible_id"), F.col("s_name").alias("name_zh"), F.concat("s_name", F.lit("!")).alias("name_en")
    )
    return an.item_descriptor(ids, facts, _part_chunks(spark, sf_dir, "item", "collectible:"))


@registry.add(
    """
    SELECT c_custkey AS id, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS evidence_no, o_orderpriority AS source
    FROM customer JOIN orders ON o_custkey = c_custkey
    UNION ALL SELECT c_custkey, NULL, NULL FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
    """
)
def memory_evidence(spark, sf_dir):
    """Customers as memories with their orders as numbered evidence; a memory without evidence stays."""
    memories = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    evidence = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("memory_id"), F.col("o_orderpriority").alias("source"),
        F.col("o_orderstatus").alias("excerpt"), F.col("o_orderdate").alias("created_at"),
    )
    return me.memories_with_evidence(memories, evidence, span=500).select("id", "evidence_no", "source")


@registry.add(
    """
    SELECT c_custkey AS id, c_mktsegment AS content, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 9 ELSE 1 END AS last_used_at
    FROM customer
    """
)
def stamped_memories(spark, sf_dir):
    """Customers with a finished order are stamped as used."""
    memories = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("content"), F.lit(1).alias("last_used_at"))
    picks = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    return me.stamp_used(memories, picks, F.lit(9))


@registry.add(
    """
    WITH c AS (
      SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS content, role AS source,
             CASE role WHEN 'user' THEN 'stable_preference' WHEN 'system' THEN 'profile' ELSE 'reply' END AS kind,
             CASE WHEN turn % 2 = 0 THEN 'explicit' ELSE 'guessed' END AS level, turn / 5.0 AS confidence FROM conversations)
    SELECT conv_id, turn,
           array_to_string(list_filter([
             CASE WHEN kind = 'reply' THEN 'kind' END, CASE WHEN level = 'guessed' THEN 'confirmation_level' END,
             CASE WHEN confidence > 1 THEN 'confidence' END, CASE WHEN length(content) NOT BETWEEN 1 AND 240 THEN 'content' END,
             CASE WHEN contains(lower(content), ' ofthth') THEN 'unsafe' END], lambda x: x IS NOT NULL), ',') AS violations
    FROM c
    """.replace("\\\\", "\\")
)
def candidate_rules(spark, sf_dir):
    """Every turn as a memory candidate with the rules it breaks."""
    turn = F.col("turn")
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.col("text").alias("content"), F.col("role").alias("source"), F.lit(None).cast("string").alias("evidence"),
        F.when(F.col("role") == "user", "stable_preference").when(F.col("role") == "system", "profile").otherwise("reply").alias("kind"),
        F.when(turn % 2 == 0, "explicit").otherwise("guessed").alias("confirmation_level"), (turn / 5.0).alias("confidence"),
    )
    checked = me.validate_candidates(rows, markers=(" ofthth",))
    return checked.select("conv_id", "turn", F.array_join("violations", ",").alias("violations"))


@registry.add(
    f"""
    SELECT conv_id, turn, CASE WHEN role = 'user' THEN left({MEMORY_KEY.format('role')}, 120)
           ELSE 'content:' || left(sha256({MEMORY_KEY.format('text')}), 24) END AS topic
    FROM conversations
    """
)
def topic_keys(spark, sf_dir):
    """Topic of every turn: the given one, else a digest of the text."""
    given = F.when(F.col("role") == "user", F.col("role")).otherwise("")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.topic_key(given, F.col("text")).alias("topic"))


@registry.add(
    r"""
    WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(url, '^https?://', ''), '[ _]+', ' ', 'g')) AS t FROM pages)
    SELECT page_id, CASE WHEN contains(t, ':') THEN left(t, instr(t, ':')) ELSE '' END
           || upper(substr(t, instr(t, ':') + 1, 1)) || substr(t, instr(t, ':') + 2) AS title_key
    FROM t
    """
)
def title_keys(spark, sf_dir):
    """Page addresses as title keys: one space, first letter upper case behind the name space."""
    bare = F.regexp_replace("url", "^https?://", "")
    return table(spark, sf_dir, "pages").select("page_id", tx.title_key(bare).alias("title_key"))


@registry.add(
    f"""
    WITH v AS (
      SELECT p_brand, p_partkey, x, {KEY.format('x')} AS k FROM (
        SELECT p_brand, p_partkey, unnest([p_name, upper(p_name), p_name || ' ' || p_size, 'C' || p_size]) AS x FROM part)),
    best AS (SELECT p_partkey, k, min((length(x), lower(x), x)) AS b FROM v WHERE k <> '' AND length(x) <= 120 GROUP BY ALL),
    fit AS (SELECT p_partkey, min((length(x), lower(x))) AS s FROM v WHERE NOT regexp_matches(x, '^[CcTtKk][0-9]+$') AND length(x) BETWEEN 2 AND 80 GROUP BY ALL)
    SELECT p_partkey, count(*) AS aliases, any_value(s[2]) AS best
    FROM best JOIN fit USING (p_partkey) GROUP BY p_partkey
    """
)
def part_aliases(spark, sf_dir):
    """Alias set and shortest plain name of every part."""
    size = F.col("p_size").cast("string")
    spelled = F.array("p_name", F.upper("p_name"), F.concat_ws(" ", "p_name", size), F.concat(F.lit("C"), size))
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")).select(
        "p_partkey", F.size(tx.unique_aliases(spelled)).cast("long").alias("aliases"), F.lower(tx.best_name(spelled, False)).alias("best")
    )


@registry.add(
    """
    WITH f AS (SELECT user_id, event_id, event_type AS text FROM events WHERE value > 20),
    p AS (SELECT *, lag(text) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM f)
    SELECT user_id, event_id FROM p WHERE text IS DISTINCT FROM before
    """
)
def new_finals(spark, sf_dir):
    """Final transcripts that differ from the final before of the same request."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("text"), F.coalesce(F.col("value") > 20, F.lit(False)).alias("final"))
    return ev.new_finals(rows, "user_id", ["event_id"], by_span("event_id", 500)).select("user_id", "event_id")


@registry.add(
    """
    SELECT user_id, min(ts) FILTER (NOT coalesce(value > 20, false)) AS first_partial_at, min(ts) FILTER (coalesce(value > 20, false)) AS first_final_at
    FROM events GROUP BY user_id
    """
)
def transcript_marks(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "ts", F.coalesce(F.col("value") > 20, F.lit(False)).alias("final"))
    return ev.transcript_marks(rows, "user_id", "ts")


@registry.add(
    """SELECT user_id || event_type AS call_id, min(event_id) AS event_id FROM events GROUP BY ALL"""
)
def first_calls(spark, sf_dir):
    """The first event of each user and type stands; a repeated identifier is rejected."""
    calls = table(spark, sf_dir, "events").select(F.concat(F.col("user_id").cast("string"), "event_type").alias("call_id"), "event_id")
    return ev.dedupe_calls(calls, "call_id", "event_id")


ITEM_SQL = """
WITH k AS (
  SELECT 'C' || (s_suppkey % 60) AS page, arg_max(s_name, s_suppkey) AS alias FROM supplier GROUP BY ALL),
i AS (
  SELECT *, ['C', 'T', 'K', 'P', 'X'][1 + p_partkey % 5] || (p_partkey % 60) AS page,
         ['item', 'trinket', 'card', 'pill'][1 + p_partkey % 5] AS t, ['collectible', 'trinket', 'card', 'pill'][1 + p_partkey % 5] AS pre,
         ['收藏品', '饰品', '卡牌或符文', '胶囊'][1 + p_partkey % 5] AS label FROM part)
SELECT p_partkey AS row_no, t AS entity_type, pre || ':' || (p_partkey % 60) AS entity_id, k.alias IS NOT NULL AS has_keyword,
       '名称：' || p_name || '；英文名：' || upper(p_name) || '；实体类型：' || label || '；稳定 ID：' || pre || ':' || (p_partkey % 60)
       || '；中文短描述：' || p_type || CASE WHEN p_size % 7 <> 0 THEN '；品质：' || p_size ELSE '' END || '。' AS text
FROM i LEFT JOIN k USING (page) WHERE t IS NOT NULL
"""


@registry.add(ITEM_SQL)
def item_sentences(spark, sf_dir):
    """Parts as item rows: code, keyword row (the last of several), labelled sentence; unset values are left out."""
    p = F.col("p_partkey")
    letter = F.get(F.array(*[F.lit(x) for x in "CTKPX"]), (p % 5).cast("int"))
    fields = F.create_map(
        F.lit("page"), F.concat(letter, (p % 60).cast("string")), F.lit("namezh"), F.col("p_name"), F.lit("nameen"), F.upper("p_name"),
        F.lit("desczh"), F.col("p_type"), F.lit("quality"), F.when(F.col("p_size") % 7 == 0, F.lit("-1")).otherwise(F.col("p_size").cast("string")),
    )
    items = table(spark, sf_dir, "part").select(p.alias("row_no"), fields.alias("fields"))
    s = F.col("s_suppkey")
    keywords = table(spark, sf_dir, "supplier").select(
        s.alias("row_no"), F.create_map(F.lit("page"), F.concat(F.lit("C"), (s % 60).cast("string")), F.lit("name_alias"), F.col("s_name")).alias("fields")
    )
    rows = sd.render_items(sd.attach_keywords(items, keywords)).where("entity_id IS NOT NULL")
    return rows.select("row_no", "entity_type", "entity_id", F.col("keyword").isNotNull().alias("has_keyword"), "text")


@registry.add(
    """
    WITH r AS (SELECT o_orderkey, o_custkey % 400 || '.' || o_orderkey % 3 || '.0' AS id, o_orderpriority AS zh, o_orderstatus AS tag FROM orders)
    SELECT o_orderkey AS row_no, 'game-entity:' || id AS entity_id, count(*) OVER w > 1 AS source_conflict,
           '实体 ID：' || id || '；中文名：' || zh || '；英文名：未填写；标签：' || tag
           || CASE WHEN count(*) OVER w > 1 THEN '；源数据冲突：相同 type.variant.subtype 存在多个名称记录，均予保留' ELSE '' END || '。' AS text
    FROM r WINDOW w AS (PARTITION BY id)
    """
)
def entity_sentences(spark, sf_dir):
    """Orders as game-entity rows; rows that share an identity are kept and marked."""
    o = F.col("o_orderkey")
    fields = F.create_map(
        F.lit("type"), (F.col("o_custkey") % 400).cast("string"), F.lit("variant"), (o % 3).cast("string"), F.lit("subtype"), F.lit("0"),
        F.lit("namezh"), F.col("o_orderpriority"), F.lit("tag"), F.col("o_orderstatus"),
    )
    rows = table(spark, sf_dir, "orders").select(o.alias("row_no"), fields.alias("fields"))
    return sd.render_entities(rows).select("row_no", "entity_id", "source_conflict", "text")


@registry.add(
    """
    SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity::INT % 2 = 0 THEN (l_quantity::INT // 2)::VARCHAR ELSE (l_quantity::INT / 2.0)::DECIMAL(9,1)::VARCHAR END AS hearts
    FROM lineitem
    """
)
def half_hearts(spark, sf_dir):
    """Quantities as half units."""
    from loreloom.operators import state as st

    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", st.half_hearts(F.col("l_quantity").cast("int")).alias("hearts"))


@registry.add(
    """
    SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS best
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS r FROM lineitem)
    WHERE r <= 2 GROUP BY l_orderkey
    """
)
def top_two_parts(spark, sf_dir):
    """The two dearest lines of every order, ties to the smaller line and part: top-k per key without a window over all of a key's rows."""
    order = [F.col("l_extendedprice").desc(), F.col("l_linenumber"), F.col("l_partkey")]
    best = top_per(table(spark, sf_dir, "lineitem"), ["l_orderkey"], order, 2)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("rank", "l_partkey"))), lambda s: s["l_partkey"].cast("string"))
    return best.groupBy("l_orderkey").agg(F.array_join(listed, ",").alias("best"))


@registry.add(
    """
    WITH p AS (
      SELECT *, CASE WHEN page_id % 7 = 0 THEN ' ' ELSE 'a' END AS ref, CASE WHEN page_id % 11 = 0 THEN 0 ELSE 3500 END AS namespace,
             CASE WHEN page_id % 13 = 0 THEN NULL ELSE false END AS stale, CASE WHEN page_id % 17 = 0 THEN 2 ELSE 1 END AS version,
             CASE WHEN page_id % 3 = 0 THEN url ELSE 'Data:' || url END AS title,
             CASE WHEN page_id % 5 = 0 THEN md5(html) ELSE sha256(html) END AS sum FROM pages)
    SELECT page_id, array_to_string(list_filter([
      CASE WHEN version <> 1 THEN 'schema_version' END, CASE WHEN namespace <> 3500 THEN 'namespace' END,
      CASE WHEN stale IS NULL THEN 'booleans' END, CASE WHEN sum <> sha256(html) THEN 'checksum' END,
      CASE WHEN NOT starts_with(title, 'Data:') THEN 'title' END, CASE WHEN NOT starts_with(url, 'https://') THEN 'https' END,
      CASE WHEN trim(ref) = '' THEN 'authorization_ref' END], lambda x: x IS NOT NULL), ',') AS violations
    FROM p
    """
)
def snapshot_rules(spark, sf_dir):
    """Pages as snapshot records, some with a wrong field, and the rules they break."""
    from loreloom.operators import validate as va

    p = F.col("page_id")
    text = lambda value, name: F.lit(value).alias(name)
    rows = table(spark, sf_dir, "pages").select(
        F.lit(None).cast("string").alias("_corrupt_record"), "page_id", p.alias("revision_id"),
        F.when(p % 7 == 0, " ").otherwise("a").alias("authorization_ref"),
        F.concat(F.lit("sha256:"), F.when(p % 5 == 0, F.md5("html")).otherwise(F.sha2("html", 256))).alias("content_checksum"),
        text("wikitext", "content_model"), F.concat(F.lit("p"), p.cast("string")).alias("document_id"), text("l", "license_note"),
        text("t", "retrieved_at"), text("s", "revision_sha1"), text("t", "revision_timestamp"), F.col("url").alias("revision_url"),
        text("w", "source_title"), text("w", "source_type"), F.col("url").alias("source_url"),
        F.when(p % 3 == 0, F.col("url")).otherwise(F.concat(F.lit("Data:"), "url")).alias("title"), F.col("html").alias("wikitext"),
        F.when(p % 11 == 0, 0).otherwise(3500).alias("namespace"), F.lit(False).alias("redirect"),
        F.when(p % 13 != 0, False).alias("stale"), F.when(p % 17 == 0, 2).otherwise(1).alias("schema_version"),
    )
    good, bad = va.validate_snapshot(rows, 3500)
    none = good.select("page_id", F.lit("").alias("violations"))
    return none.unionByName(bad.select("page_id", F.array_join("violations", ",").alias("violations")))


@registry.add(
    r"""
    WITH d AS (
      SELECT doc_id, lang, source, CASE WHEN doc_id % 6 = 0 THEN 'bad id ' || doc_id ELSE 'd' || doc_id END AS document_id,
             CASE WHEN doc_id % 4 = 0 THEN 'http' ELSE 'https' END || '://x/' || doc_id AS url,
             CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE left(text, 20) END AS title, CASE WHEN doc_id % 8 = 0 THEN '' ELSE 'b' END AS alias FROM documents)
    SELECT doc_id, array_to_string(list_filter([
      CASE WHEN NOT regexp_full_match(document_id, '[A-Za-z0-9_./:+-]+') THEN 'document_id' END,
      CASE WHEN trim(title, E' \n\r\t') = '' THEN 'title' END, CASE WHEN alias = '' THEN 'aliases' END,
      CASE WHEN NOT starts_with(url, 'https://') THEN 'https' END], lambda x: x IS NOT NULL), ',') AS violations
    FROM d
    """
)
def curated_rules(spark, sf_dir):
    """Documents as curated records, some with a wrong field, and the rules they break."""
    from loreloom.operators import validate as va

    d = F.col("doc_id")
    key = d.cast("string")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(d % 6 == 0, F.concat(F.lit("bad id "), key)).otherwise(F.concat(F.lit("d"), key)).alias("document_id"),
        F.col("lang").alias("entity_type"), F.col("source").alias("entity_id"), F.col("source").alias("name_zh"), F.col("lang").alias("name_en"),
        F.when(d % 9 == 0, " ").otherwise(F.substring("text", 1, 20)).alias("title"), "text", F.lit("2026").alias("acquired_on"),
        F.lit("1").alias("game_version"), F.lit("l").alias("license_note"), F.lit("1").alias("content_version"),
        F.array(F.lit("a"), F.when(d % 8 == 0, "").otherwise("b")).alias("aliases"),
        F.struct(
            F.col("source").alias("id"), F.col("lang").alias("type"), F.col("source").alias("title"),
            F.concat(F.when(d % 4 == 0, "http").otherwise("https"), F.lit("://x/"), key).alias("url"),
        ).alias("source"), F.lit(False).alias("stale"),
    )
    good, bad = va.validate_curated(rows, strict=False)
    none = good.select("doc_id", F.lit("").alias("violations"))
    return none.unionByName(bad.select("doc_id", F.array_join("violations", ",").alias("violations")))
