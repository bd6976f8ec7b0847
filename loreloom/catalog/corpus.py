"""Corpus operators over ``pages``, ``documents``, ``part``, ``orders`` and ``events``."""

import os
import uuid

from pyspark.sql import functions as F

from loreloom.catalog import registry, table
from loreloom.functions import text as tx
from loreloom.operators import audit as au, dedup as dd, entities as en, index as ix, publish as pb
from loreloom.operators import redirects as rd, sections as sc, structured as sd, validate as va
from loreloom.session import shared_folder, spread
from loreloom.sources import files as fl

K = "(props->>'k')::BIGINT"


@registry.add(
    r"""
    WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    clean AS (SELECT doc_id, i, trim(regexp_replace(regexp_replace(l, '[ \t\f\v]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'), ' ' || chr(10) || '|;：') AS t FROM lines),
    numbered AS (SELECT doc_id, i, length(t) AS chars, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM clean WHERE length(t) >= 12)
    SELECT 'd' || doc_id || '#sec:' || substr(sha256('导语'), 1, 12) || ':' || CASE WHEN n < 10 THEN '0' || n ELSE n::VARCHAR END AS chunk_id, chars
    FROM numbered
    """
)
def chunk_ids(spark, sf_dir):
    """Lines of documents as blocks of an untitled section, numbered after the length rule."""
    lines = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document"), F.posexplode(F.split("text", "\n")).alias("block_no", "block")
    ).withColumn("section_path", F.array().cast("array<string>"))
    return sc.assign_chunk_ids(lines, "document", ["block_no"]).select("chunk_id", F.length("text").alias("chars"))


@registry.add()
def sectioned_pages(spark, sf_dir):
    """Every page as titled sections of packed blocks with chunk ids."""
    pages = spread(table(spark, sf_dir, "pages")).select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("document"), "url", "html")
    blocks = sc.sections(pages, sc.html_markup(F.col("html")), F.col("url")).drop("html")
    return sc.assign_chunk_ids(blocks, "document", ["section_no", "block_no"]).select(
        "chunk_id", "section_key", "ordinal", F.length("text").alias("chars")
    )


HREF = 'href="([^"#]+)"'


def _links(spark, sf_dir):
    found = F.regexp_extract_all("html", F.lit(HREF), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(found).alias("name"))


@registry.add(
    f"""
    WITH l AS (SELECT unnest(regexp_extract_all(html, '{HREF}', 1)) AS name FROM pages)
    SELECT min(name) AS name, count(*) AS uses FROM l GROUP BY replace(lower(name), 'ß', 'ss')
    """
)
def link_dependencies(spark, sf_dir):
    """Link targets with their uses; spellings that differ in case are one target."""
    return sc.dependency_counts(_links(spark, sf_dir), by=())


@registry.add(
    f"""
    WITH l AS (SELECT DISTINCT unnest(regexp_extract_all(html, '{HREF}', 1)) AS name FROM pages),
    have AS (SELECT DISTINCT '/' || split_part(text, ' ', 1) AS name FROM documents)
    SELECT name FROM l WHERE name NOT IN (SELECT name FROM have)
    """
)
def missing_targets(spark, sf_dir):
    """Link targets that no document starts with."""
    have = table(spark, sf_dir, "documents").select(F.concat(F.lit("/"), F.split("text", " ")[0]).alias("name"))
    return au.missing(_links(spark, sf_dir).select("name").distinct(), have, ["name"])


# Functional graph: user -> k of the user's last event, for two thirds of the users; large targets do not exist.
GRAPH_SQL = f"""
last AS (SELECT user_id, arg_max({K}, event_id) AS k FROM events GROUP BY user_id),
edges AS (SELECT 'U' || user_id AS source_key, 'U' || CASE WHEN k >= 95 THEN k + 1000 ELSE k END AS target FROM last WHERE user_id % 3 <> 0),
walk AS (
  SELECT source_key, target AS tail, [source_key, target] AS chain, source_key = target AS looped FROM edges
  UNION ALL
  SELECT w.source_key, e.target, list_append(w.chain, e.target), list_contains(w.chain, e.target)
  FROM walk w JOIN edges e ON e.source_key = w.tail WHERE NOT w.looped),
ends AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY source_key ORDER BY len(chain) DESC) = 1),
closed AS (
  SELECT source_key, array_to_string(chain, '>') AS chain,
         CASE WHEN looped THEN 'cycle' WHEN tail IN (SELECT 'U' || user_id FROM last) THEN 'resolved' ELSE 'broken' END AS status, tail
  FROM ends)
"""


def _redirects(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    last = events.groupBy("user_id").agg(F.max_by("k", "event_id").alias("k"))
    pages = last.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("title"), (F.col("user_id") % 3 != 0).alias("redirect"),
        F.concat(F.lit("u"), F.when(F.col("k") >= 95, F.col("k") + 1000).otherwise(F.col("k")).cast("string")).alias("redirect_target"),
    ).withColumn("title_key", tx.title_key(F.col("title")))
    return rd.redirect_map(pages), pages


def _closed(spark, sf_dir):
    mapping, pages = _redirects(spark, sf_dir)
    return rd.close_redirects(mapping, pages.select("title_key"))


@registry.add(
    f"""WITH RECURSIVE {GRAPH_SQL} SELECT source_key, CASE WHEN status = 'resolved' THEN tail END AS final_key, status, chain FROM closed"""
)
def redirect_closure(spark, sf_dir):
    mapping, pages = _redirects(spark, sf_dir)
    closed = rd.close_redirects(mapping, pages.select("title_key"))
    steps = F.sort_array(F.collect_list(F.struct("step", "key")))
    chains = rd.redirect_chains(mapping, closed).groupBy("source_key").agg(F.array_join(F.transform(steps, lambda s: s["key"]), ">").alias("chain"))
    return closed.drop("steps").join(chains, "source_key")


@registry.add(
    f"""WITH RECURSIVE {GRAPH_SQL},
    c AS (SELECT source_key, string_split(chain, '>') AS keys FROM closed)
    SELECT source_key, unnest(range(len(keys))) AS step, unnest(keys) AS key FROM c"""
)
def redirect_chains(spark, sf_dir):
    """The keys on the way of every redirect, as rows."""
    mapping, pages = _redirects(spark, sf_dir)
    return rd.redirect_chains(mapping, rd.close_redirects(mapping, pages.select("title_key")))


@registry.add(f"WITH RECURSIVE {GRAPH_SQL} SELECT status, count(*) AS redirects FROM closed GROUP BY status")
def redirect_stats(spark, sf_dir):
    return rd.redirect_stats(_closed(spark, sf_dir))


def _entity_rows(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("entity_id"), F.col("p_type").alias("entity_type"), F.col("p_name").alias("name_zh"),
        F.upper("p_name").alias("name_en"), F.array("p_name", F.upper("p_name"), "p_type").alias("aliases"),
        F.col("p_partkey").cast("string").alias("document_id"), (F.col("p_size") > 40).alias("structured"),
        F.struct((F.col("p_size") > 40).alias("late"), F.col("p_partkey").alias("key")).alias("ord"),
    )


@registry.add(
    """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size > 40, p_partkey) AS i FROM part)
    SELECT p_brand AS entity_id, arg_min(p_type, i) AS entity_type,
           coalesce(arg_max(p_name, i) FILTER (p_size > 40), arg_min(p_name, i)) AS name_zh,
           coalesce(arg_max(upper(p_name), i) FILTER (p_size > 40), arg_min(upper(p_name), i)) AS name_en, count(*) AS rows
    FROM r GROUP BY p_brand
    """
)
def entity_merge(spark, sf_dir):
    return en.merge_entities(_entity_rows(spark, sf_dir))


@registry.add(
    """
    WITH r AS (SELECT p_brand, p_name, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY p_size > 40, p_partkey) AS i FROM part),
    a AS (SELECT p_brand, i, unnest([p_name, upper(p_name), p_type]) AS alias, unnest([0, 1, 2]) AS place FROM r),
    n AS (SELECT *, regexp_replace(lower(alias), '[^0-9a-z]+', '', 'g') AS normalized FROM a)
    SELECT p_brand AS entity_id, normalized, alias FROM n
    QUALIFY row_number() OVER (PARTITION BY p_brand, normalized ORDER BY length(alias), lower(alias), i, place) = 1
    """
)
def alias_set(spark, sf_dir):
    return en.entity_aliases(_entity_rows(spark, sf_dir))


@registry.add("SELECT p_partkey, count(*) OVER (PARTITION BY p_name, p_size) > 1 AS source_conflict FROM part")
def conflict_flag(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return dd.flag_conflicts(part, ["p_name", "p_size"]).select("p_partkey", "source_conflict")


@registry.add(
    """
    WITH c AS (SELECT 'P' || p_partkey AS chunk_id, p_name, p_type, 'part:' || p_partkey AS id, p_brand, p_partkey,
                      CASE WHEN p_size % 2 = 0 THEN 'item' ELSE 'card' END AS t FROM part),
    a AS (SELECT chunk_id, unnest(list_filter([p_name, p_type, id, p_brand, lower(p_brand), CASE WHEN t = 'item' THEN p_partkey::VARCHAR END], lambda x: x IS NOT NULL)) AS alias,
                 generate_subscripts(list_filter([p_name, p_type, id, p_brand, lower(p_brand), CASE WHEN t = 'item' THEN p_partkey::VARCHAR END], lambda x: x IS NOT NULL), 1) AS place FROM c),
    n AS (SELECT *, regexp_replace(lower(alias), '[^0-9a-z]+', '', 'g') AS normalized FROM a)
    SELECT chunk_id, normalized, alias FROM n QUALIFY row_number() OVER (PARTITION BY chunk_id, normalized ORDER BY place) = 1
    """
)
def index_aliases(spark, sf_dir):
    """Alias rows of a chunk table built from parts; the first alias of a normal form wins."""
    return ix.alias_rows(part_chunks(spark, sf_dir)).select("chunk_id", "normalized", "alias")


def part_chunks(spark, sf_dir):
    number = F.col("p_partkey").cast("string")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), number).alias("chunk_id"), F.col("p_name").alias("name_zh"), F.col("p_type").alias("name_en"),
        F.concat(F.lit("part:"), number).alias("entity_id"), F.when(F.col("p_size") % 2 == 0, "item").otherwise("card").alias("entity_type"),
        F.array("p_brand", F.lower("p_brand")).alias("aliases"), F.col("p_name").alias("title"),
        F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"), F.lit("1").alias("game_version"),
        F.lit("table").alias("source_type"), (F.col("p_size") <= 3).alias("stale"),
    )


@registry.add(
    r"""
    WITH t AS (SELECT doc_id, unnest(string_split(trim(regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')) AS term FROM documents)
    SELECT term, count(DISTINCT doc_id) AS df FROM t WHERE term <> '' GROUP BY term
    """
)
def term_stats(spark, sf_dir):
    """Document frequency of every term of the keyword index over documents."""
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"))
    fields = ix.with_length(docs.select("chunk_id", tx.search_text(F.col("text")).alias("body")))
    return ix.field_term_stats(fields)


@registry.add(
    """
    WITH r AS (
      SELECT page_id, url, html, [0, 10, 828, 3500, 7][1 + page_id % 5] AS ns FROM pages)
    SELECT page_id, concat_ws(',', CASE WHEN ns = 7 THEN 'namespace' END, CASE WHEN page_id % 11 = 0 THEN 'checksum' END,
           CASE WHEN NOT starts_with(url, 'https://') THEN 'https' END, CASE WHEN page_id % 13 = 0 THEN 'redirect_target' END) AS violations
    FROM r
    """
)
def record_rules(spark, sf_dir):
    """Pages written as raw records, some with a wrong namespace, checksum, URL or redirect."""
    marked = _raw_records(spark, sf_dir).withColumn("violations", F.array_join(va.broken(va.page_rules()), ","))
    return marked.select("page_id", "violations")


def _raw_records(spark, sf_dir):
    spaces = F.array(*[F.lit(n) for n in (0, 10, 828, 3500, 7)])
    digest = va.checksum_of("html")
    text = F.lit("x")
    return table(spark, sf_dir, "pages").select(
        F.lit(1).alias("schema_version"), F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("document_id"),
        F.get(spaces, (F.col("page_id") % 5).cast("int")).alias("namespace"), "page_id", (F.col("page_id") + 1).alias("revision_id"),
        *[text.alias(n) for n in ("revision_sha1", "revision_timestamp", "retrieved_at", "source_title", "source_type", "license_note", "authorization_ref")],
        F.col("url").alias("title"), (F.col("page_id") % 13 == 0).alias("redirect"), F.lit(False).alias("stale"),
        F.lit("wikitext").alias("content_model"), F.col("html").alias("wikitext"),
        F.when(F.col("page_id") % 11 == 0, "sha256:0").otherwise(digest).alias("content_checksum"),
        F.col("url").alias("source_url"), F.col("url").alias("revision_url"), F.lit(None).cast("string").alias("_corrupt_record"),
    )


@registry.add(
    f"""
    SELECT count(*) AS records, count(*) FILTER (event_type = 'error') AS redirects, 0 AS stale_records,
           count(*) FILTER (event_type <> 'error' AND {K} % 4 <> 0) AS json_pages,
           count(*) FILTER (event_type = 'view') AS room_pages,
           count(*) FILTER (event_type = 'view' AND {K} % 4 IN (1, 2)) AS room_layout_pages,
           count(DISTINCT {K} % 7) FILTER (event_type = 'view' AND {K} % 4 IN (1, 2)) AS distinct_room_files
    FROM events
    """
)
def snapshot_audit(spark, sf_dir):
    """Snapshot counters over events written as data pages."""
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.when(k % 4 == 3, "OTHER").otherwise("ROOM_STB")
    body = F.when(k % 4 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(kind.alias("_type"), F.concat(F.lit("f"), (k % 7).cast("string")).alias("_file"))))
    pages = table(spark, sf_dir, "events").select(
        F.concat(F.when(F.col("event_type") == "view", "Data:Rooms/").otherwise("Data:"), F.col("event_id").cast("string"), F.lit(".json")).alias("title"),
        (F.col("event_type") == "error").alias("redirect"), F.lit(False).alias("stale"), F.lit("text").alias("content_model"), body.alias("wikitext"),
    )
    return au.snapshot_profile(pages)


@registry.add(
    f"""
    SELECT event_id, r AS row_no, CASE WHEN r = 1 OR {K} % 2 = 0 THEN ({K} + r - 1)::VARCHAR END AS k, r = 1 OR {K} % 2 = 0 AS arity_ok
    FROM events, (SELECT unnest([1, 2]) AS r)
    """
)
def tabular_explode(spark, sf_dir):
    """One two-row table page per event; odd tables have a row of the wrong length."""
    k = F.get_json_object("props", "$.k").cast("long")
    second = F.when(k % 2 == 0, F.format_string('[%d,"b"]', k + 1)).otherwise(F.format_string("[%d]", k + 1))
    body = F.concat(F.lit('{"schema":{"fields":[{"name":"k"},{"name":"v"}]},"data":['), F.format_string('[%d,"a"]', k), F.lit(","), second, F.lit("]}"))
    pages = table(spark, sf_dir, "events").select("event_id", body.alias("wikitext"))
    return sd.explode_tabular(pages).select("event_id", "row_no", F.try_element_at("fields", F.lit("k")).alias("k"), "arity_ok")


@registry.add(
    """
    SELECT page_id, 'wiki:page:' || page_id || ':rev:' || (page_id + 1) AS document_id, page_id % 4 = 0 AS redirect,
           'sha256:' || sha256(html) AS content_checksum, url || '?oldid=' || (page_id + 1) AS revision_url
    FROM pages WHERE page_id % 5 <> 0
    """
)
def flattened_responses(spark, sf_dir):
    """API responses written from pages; one in five has no revision and is skipped."""
    revision = F.struct(
        (F.col("page_id") + 1).alias("revid"), F.struct(F.struct(F.col("html").alias("content")).alias("main")).alias("slots")
    )
    page = F.struct(
        F.col("page_id").alias("pageid"), F.lit(0).alias("ns"), F.col("url").alias("title"), F.col("url").alias("canonicalurl"),
        F.when(F.col("page_id") % 4 == 0, True).alias("redirect"), F.when(F.col("page_id") % 5 != 0, F.array(revision)).alias("revisions"),
    )
    body = F.to_json(F.struct(F.struct(F.array(page).alias("pages")).alias("query")))
    source = {"title_prefix": "Wiki: ", "source_type": "export", "license_note": "l", "authorization_ref": "a"}
    rows = fl.flatten_responses(table(spark, sf_dir, "pages").select(body.alias("value")), "2026-01-01T00:00:00Z", source)
    return rows.select("page_id", "document_id", "redirect", "content_checksum", "revision_url")


@registry.add("SELECT o_orderkey AS page_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def unseen_revisions(spark, sf_dir):
    """Orders that no line item has stored yet."""
    new = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), F.lit(1).alias("revision_id"))
    known = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.lit(1).alias("revision_id"))
    return pb.unseen_revisions(known, new).select("page_id")


@registry.add(
    """
    SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'vectors' ELSE 'chunks' END AS only_in
    FROM documents d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL
    """
)
def id_mismatch(spark, sf_dir):
    """Documents without a label row stand for chunks without a vector."""
    return ix.id_mismatch(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id")


@registry.add(
    """
    WITH a AS (SELECT substr(c, 1, 8) AS g, sha256(string_agg(c, '' ORDER BY c)) AS h
               FROM (SELECT sha256(doc_id || ':' || text) AS c FROM documents) GROUP BY ALL),
    b AS (SELECT substr(g, 1, 4) AS k, sha256(string_agg(h, '' ORDER BY g)) AS h FROM a GROUP BY ALL)
    SELECT 'sha256:' || sha256(string_agg(h, '' ORDER BY k)) AS corpus_checksum, (SELECT count(*) FROM documents) AS rows FROM b
    """
)
def corpus_publish(spark, sf_dir):
    """Publish documents as a versioned table and read the current version back."""
    docs = table(spark, sf_dir, "documents")
    digest = va.checksum_of(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "text"))
    chunks = docs.select("doc_id", "lang", "source", "text", digest.alias("checksum"))
    out = os.path.join(shared_folder(spark), "loreloom", f"publish-{uuid.uuid4().hex}")
    pb.publish_corpus({"chunks": chunks}, out, {"source": "documents"}, {"chunks": ["doc_id"]})
    published = pb.read_published(spark, out, "chunks")
    manifest = pb.read_manifest(spark, out)
    return published.agg(F.count("*").alias("rows")).withColumn("corpus_checksum", F.lit(manifest["corpus_checksum"]))
