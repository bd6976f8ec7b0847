"""Corpus build: raw pages to published chunks, entities, redirects and audits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.functions import text as tx
from loreloom.operators import audit, dedup, entities as en, redirects as rd, sections as sc, structured as sd
from loreloom.operators import validate as va
from loreloom.operators.publish import publish_corpus
from loreloom.session import stage

# Constants written into chunk records.
SCHEMA_VERSION = 2
PAGE_MATERIAL = "wiki-page-current-revision"
ROW_MATERIAL = "wiki-data-tabular-row"
ROOM_MATERIAL = "wiki-data-room-stb"
PAGE_NORMALIZATION = "wikitext-whitelist-static-v2"
DATA_NORMALIZATION = "json-whitelist-static-v2.1"
STRUCTURED_SECTION = "结构化数据"
ROOM_TITLE = " · 结构化房间布局"
ITEM_TABLE, KEYWORD_TABLE, ENTITY_TABLE = "Data:Item.tabx", "Data:ItemKeywords.tabx", "Data:Entity.tabx"
# End of fixed values.

EXTRAS = {
    "data_row": "int", "data_page_key": "string", "source_conflict": "boolean", "conflict_key": "string",
    "room_file": "string", "room_type": "string", "room_variant": "string", "room_subtype": "string", "room_shape": "string",
}


@dataclass(frozen=True)
class Corpus:
    """Result tables of one build."""

    chunks: DataFrame
    entities: DataFrame
    entity_aliases: DataFrame
    entity_documents: DataFrame
    redirects: DataFrame
    facts: DataFrame
    dependencies: DataFrame
    pages: DataFrame
    decisions: DataFrame
    #: (rule, title, row_no): every record, page or row that is not in the corpus because it breaks a rule.
    violations: DataFrame


def chunk_columns(content_version: str, game_version: str, material: Column, normalization: Column) -> list[Column]:
    """Record columns shared by prose and structured chunks, in one place."""
    return [
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.col("chunk_id"), F.col("chunk_document").alias("document_id"),
        F.col("entity_type"), F.col("entity_id"), F.col("name_zh"), F.col("name_en"), F.col("aliases"),
        F.col("chunk_title").alias("title"), F.col("section_path"), F.col("text"),
        F.struct(
            F.col("document_id").alias("id"), F.col("source_title").alias("title"), F.col("revision_url").alias("url"),
            F.col("source_url").alias("canonical_url"), F.col("source_type").alias("type"),
        ).alias("source"),
        material.alias("source_material_type"), F.col("page_id"), F.col("revision_id"), F.col("revision_timestamp"),
        tx.date_prefix(F.col("retrieved_at")).alias("acquired_on"), F.col("retrieved_at"),
        F.lit(game_version).alias("game_version"), F.col("license_note"), F.col("authorization_ref"),
        F.lit(content_version).alias("content_version"), F.col("stale"),
        F.col("document_id").alias("raw_document_id"), F.col("redirect_sources"), normalization.alias("normalization"),
        *[F.col(n).cast(t).alias(n) for n, t in EXTRAS.items()],
        F.col("group_no"), F.col("order_1"), F.col("order_2"), F.col("order_3"), F.col("near_allowed"),
    ]


def prose_blocks(pages: DataFrame, closed: DataFrame, overrides: DataFrame | None, id_prefix: str) -> DataFrame:
    """Classified content pages cut into numbered blocks."""
    sources = rd.redirect_sources(closed, pages)
    empty = F.array().cast("array<struct<title:string,page_id:bigint,revision_id:bigint,document_id:string>>")
    content = va.content_pages(pages).join(sources, "title_key", "left").withColumn(
        "redirect_sources", F.coalesce("redirect_sources", empty)
    ).withColumn("aliases", F.transform("redirect_sources", lambda s: s["title"]))
    classified = en.classify(content, overrides).withColumn(
        "chunk_document", F.concat(F.lit(f"{id_prefix}:page:"), F.col("page_id").cast("string"))
    )
    blocks = sc.sections(classified, F.col("wikitext"), F.col("title")).drop("wikitext")
    numbered = sc.assign_chunk_ids(blocks, "chunk_document", ["section_no", "block_no"])
    return numbered.withColumn("chunk_title", F.concat("title", F.lit(" · "), "section_key")).withColumns(
        {
            "group_no": F.lit(0), "order_1": F.col("title_key"), "order_2": F.col("section_no").cast("long"),
            "order_3": F.col("block_no").cast("long"), "near_allowed": F.lit(True),
            **{n: F.lit(None).cast(t) for n, t in EXTRAS.items()},
        }
    )


def structured_rows(pages: DataFrame, id_prefix: str) -> DataFrame:
    """Item, game-entity and room sentences in their build order."""
    data = pages.where(F.col("namespace") == va.DATA_NAMESPACE)
    carried = [c for c in data.columns if c != "wikitext"]

    def table(title: str) -> DataFrame:
        return sd.explode_tabular(data.where(F.col("title") == title)).where("arity_ok")

    def finish(rows: DataFrame, group: int, document: Column, title: Column, extras: dict[str, Column]) -> DataFrame:
        defaults = {n: F.lit(None).cast(t) for n, t in EXTRAS.items()}
        ordered = F.col("row_no").cast("long") if "row_no" in rows.columns else F.lit(0).cast("long")
        return rows.withColumns(
            {**defaults, **extras, "chunk_document": document, "chunk_title": title}
        ).withColumns(
            {
                "chunk_id": F.concat("chunk_document", F.lit("#structured:01")),
                "section_path": F.array(F.lit(STRUCTURED_SECTION)),
                "redirect_sources": F.array().cast("array<struct<title:string,page_id:bigint,revision_id:bigint,document_id:string>>"),
                "group_no": F.lit(group), "order_1": F.col("title_key"), "order_2": ordered,
                "order_3": F.lit(0).cast("long"), "near_allowed": F.lit(False),
            }
        ).select(
            *carried, "chunk_document", "chunk_id", "chunk_title", "section_path", "redirect_sources", "text",
            "entity_type", "entity_id", "name_zh", "name_en", "aliases", "group_no", "order_1", "order_2", "order_3",
            "near_allowed", *EXTRAS,
        )

    page = F.concat(F.lit(f"{id_prefix}:data:"), F.col("page_id").cast("string"))
    items = sd.render_items(sd.attach_keywords(table(ITEM_TABLE), table(KEYWORD_TABLE))).where("entity_id IS NOT NULL")
    number = F.col("row_no").cast("string")
    padded = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    game = sd.render_entities(table(ENTITY_TABLE))
    rooms = sd.render_rooms(sd.read_rooms(data))
    shown = F.when(F.col("name_zh") != "", F.col("name_zh")).otherwise(F.col("name_en"))
    return (
        finish(
            items, 1, F.concat(page, F.lit(":row:"), "page_key"), F.concat("title", F.lit(" · "), "name_zh"),
            {"data_row": F.col("row_no"), "data_page_key": F.col("page_key")},
        )
        .unionByName(finish(
            game, 2, F.concat(page, F.lit(":row:"), padded), F.concat("title", F.lit(" · "), shown),
            {"data_row": F.col("row_no"), "source_conflict": F.col("source_conflict"), "conflict_key": F.col("conflict_key")},
        ))
        .unionByName(finish(
            rooms, 3, F.concat(F.lit(f"{id_prefix}:data:page:"), F.col("page_id").cast("string")),
            F.concat("title", F.lit(ROOM_TITLE)),
            {f"room_{n}": F.col(f"room.{f}") for n, f in
             (("file", "_file"), ("type", "type"), ("variant", "variant"), ("subtype", "subtype"), ("shape", "shape"))},
        ))
    )


ORDER = ["group_no", "order_1", "order_2", "order_3", "chunk_id"]


def _violation(rule: Column, title: Column, row_no: Column | None = None) -> list[Column]:
    return [rule.alias("rule"), title.cast("string").alias("title"), (F.lit(None) if row_no is None else row_no).cast("int").alias("row_no")]


def structured_violations(pages: DataFrame) -> DataFrame:
    """What ``structured_rows`` cannot render: broken tables, rows, codes, identities and rooms."""
    data = pages.where(F.col("namespace") == va.DATA_NAMESPACE)
    tables = data.where(F.col("title").isin(ITEM_TABLE, KEYWORD_TABLE, ENTITY_TABLE))
    rows = sd.explode_tabular(tables)
    fine = rows.where("arity_ok")
    page_key = F.trim(F.coalesce(F.try_element_at("fields", F.lit("page")), F.lit("")))
    found = (
        sd.table_violations(tables, rows)
        .unionByName(sd.identity_violations(fine.where(F.col("title") == ITEM_TABLE), sd.item_identity(page_key)[1], "item code"))
        .unionByName(sd.identity_violations(fine.where(F.col("title") == ENTITY_TABLE), sd.entity_key(), "entity identity"))
        .unionByName(sd.bad_rooms(data))
        .unionByName(sd.identity_violations(sd.read_rooms(data), sd.room_key(), "room identity"))
    )
    return found.select(*_violation(F.col("rule"), F.col("title"), F.col("row_no")))


def first_of_repeated(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One page per (page_id, revision_id) and per title key, and the pages left out with their rule.

    Of equal pairs the row with the smallest hash stays; of equal titles the newest revision.
    """
    row = F.struct(*[F.col(c) for c in pages.columns])
    keys = ["page_id", "revision_id"]
    pair = pages.groupBy(*keys).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("p"), F.count("*").alias("n"))
    repeated = pair.where("n > 1").select(*_violation(F.lit("page_revision"), F.col("p.title")))
    single = pair.select("p.*")
    newest = single.groupBy("title_key").agg(F.max(F.struct("revision_id", "page_id")).alias("last"))
    marked = single.join(newest, "title_key")
    last = (F.col("revision_id") == F.col("last.revision_id")) & (F.col("page_id") == F.col("last.page_id"))
    older = marked.where(~last).select(*_violation(F.lit("title_key"), F.col("title")))
    return marked.where(last).select(*pages.columns), repeated.unionByName(older)


def build_corpus(
    raw: DataFrame, overrides: DataFrame | None = None, content_version: str = "1", game_version: str = "1",
    id_prefix: str = "wiki", strict: bool = True,
) -> Corpus:
    """Validate, close redirects, cut and render, remove duplicates, merge entities.

    Nothing is left out silently: ``violations`` has a row for each record, page or row that breaks a rule, and
    ``strict`` raises when there is any.
    """
    pages, rejected = va.validate_pages(raw)
    pages, repeated = first_of_repeated(stage(pages, "valid-pages"))
    pages = stage(pages, "pages")
    violations = stage(
        rejected.select(F.explode("violations").alias("rule"), "title").select(*_violation(F.col("rule"), F.col("title")))
        .unionByName(repeated).unionByName(structured_violations(pages)), "violations",
    )
    if strict and not violations.isEmpty():
        found = [tuple(r) for r in violations.limit(3).collect()]
        raise va.RuleError(f"records break rules, for example {found}")
    closed = rd.close_redirects(rd.redirect_map(pages), pages.select("title_key"))
    prose = prose_blocks(pages, closed, overrides, id_prefix)
    both = prose.select(*structured_columns(prose)).unionByName(structured_rows(pages, id_prefix))
    candidates = stage(dedup.signatures(both), "candidates")
    decisions = decide(candidates)
    kept = candidates.join(decisions.where("status = 'kept'").select("chunk_id"), "chunk_id", "left_semi")
    material = F.when(F.col("group_no") == 0, PAGE_MATERIAL).when(F.col("group_no") == 3, ROOM_MATERIAL).otherwise(ROW_MATERIAL)
    normal = F.when(F.col("group_no") == 0, PAGE_NORMALIZATION).otherwise(DATA_NORMALIZATION)
    records = kept.drop("checksum").select(*chunk_columns(content_version, game_version, material, normal))
    internal = ["group_no", "order_1", "order_2", "order_3", "near_allowed"]
    chunks = records.withColumn("checksum", va.row_checksum(records.drop(*internal)))
    rows = chunks.select(
        "entity_id", "entity_type", "name_zh", "name_en", "aliases", "document_id",
        F.struct(*ORDER).alias("ord"), (F.col("group_no") > 0).alias("structured"),
    )
    facts = sc.literal_facts(pages.where(F.col("namespace") == 828))
    uses = sc.dependencies(
        pages.where(F.col("namespace").isin(0, 10, 828)).select("namespace", "page_id", "wikitext")
    ).where((F.col("kind") != "data") | F.col("namespace").isin(10, 828))
    return Corpus(
        chunks.drop(*internal), en.merge_entities(rows), en.entity_aliases(rows), en.entity_documents(rows),
        rd.redirect_report(closed, pages), facts, uses, pages, decisions, violations,
    )


def structured_columns(prose: DataFrame) -> list[str]:
    drop = {"section_no", "block_no", "block", "section_key", "section_hash", "ordinal", "section_path"}
    return [c for c in prose.columns if c not in drop] + ["section_path"]


def decide(candidates: DataFrame) -> DataFrame:
    """Keep or drop every candidate: prose by exact and near duplicates, structured rows by exact ones.

    Structured rows come after all prose, so prose is decided first and its kept
    checksums stand before every structured row.
    """
    prose = dedup.greedy_dedup(candidates.where("near_allowed"), "chunk_id", ORDER)
    prose = stage(prose, "prose-decisions").select(*ORDER, "checksum", "status")
    rows = candidates.where("NOT near_allowed").select(*ORDER, "checksum")
    taken = prose.where("status = 'kept'").select("checksum").distinct()
    first = rows.join(taken, "checksum", "left_anti").groupBy("checksum").agg(
        F.min_by("chunk_id", F.struct(*ORDER)).alias("chunk_id")
    ).select("chunk_id", F.lit("kept").alias("status"))
    marked = rows.join(first, "chunk_id", "left").select(*ORDER, "checksum", F.coalesce("status", F.lit("exact")).alias("status"))
    return prose.unionByName(marked)


def manifest_totals(corpus: Corpus) -> dict:
    """Counts for the manifest, from small aggregates."""
    counts = audit.corpus_counts(corpus.pages).first().asDict()
    status = {r["status"]: r["redirects"] for r in rd.redirect_stats(corpus.redirects).collect()}
    removed = {r["status"]: r["n"] for r in corpus.decisions.groupBy("status").agg(F.count("*").alias("n")).collect()}
    chunk = corpus.chunks.agg(
        F.count("*").alias("chunks"), F.count_distinct("document_id").alias("documents"),
        F.count_if(F.col("normalization") == DATA_NORMALIZATION).alias("data_chunks"),
        F.count_if(F.col("source_material_type") == ROOM_MATERIAL).alias("rooms"),
    ).first()
    pages = va.content_pages(corpus.pages)
    cut = corpus.decisions.where("group_no = 0").select(F.col("order_1").alias("title_key")).distinct()
    tables = corpus.pages.where(
        (F.col("namespace") == va.DATA_NAMESPACE) & F.col("title").isin(ITEM_TABLE, KEYWORD_TABLE, ENTITY_TABLE)
    ).count()
    named = corpus.pages.where((F.col("namespace") == va.DATA_NAMESPACE) & F.startswith("title", F.lit(sd.ROOM_PREFIX))).count()
    skipped = max(0, counts[f"namespace_{va.DATA_NAMESPACE}"] - chunk["rooms"] - tables)
    return {
        **counts,
        "document_count": chunk["documents"], "chunk_count": chunk["chunks"], "entity_count": corpus.entities.count(),
        "redirect_resolved": status.get("resolved", 0), "redirect_cycles": status.get("cycle", 0),
        "redirect_broken": status.get("broken", 0), "exact_duplicates": removed.get("exact", 0),
        "near_duplicates": removed.get("near", 0), "data_chunk_count": chunk["data_chunks"],
        "room_layout_count": chunk["rooms"], "fact_count": corpus.facts.count(),
        "pages_without_chunks": pages.join(cut, "title_key", "left_anti").count(),
        "violations": corpus.violations.count(),
        "skipped_data_pages": skipped,
        # as published manifests count: a room page that is no layout once more
        "skipped_data_pages_published": skipped + named - chunk["rooms"],
    }


def publish(corpus: Corpus, out: str, **totals) -> dict:
    """Publish all tables of a build as one version."""
    tables = {
        "chunks": corpus.chunks, "entities": corpus.entities, "entity_aliases": corpus.entity_aliases,
        "entity_documents": corpus.entity_documents, "redirects": corpus.redirects, "facts": corpus.facts,
        "dependencies": corpus.dependencies, "violations": corpus.violations,
    }
    order = {
        "chunks": ["chunk_id"], "entities": ["entity_type", "entity_id"], "redirects": ["source_key"],
        "facts": ["module_title", "fact_key", "fact_value"],
    }
    return publish_corpus(tables, out, {**manifest_totals(corpus), **totals}, order)
