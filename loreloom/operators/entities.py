"""Entity classification of pages and merging of entity rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.functions import text as tx
from loreloom.operators.sections import intro_aliases

# Title patterns and type names of the classification.
ID_TITLES = (("^[Cc]([0-9]+)$", "item", "collectible:"), ("^[Tt]([0-9]+)$", "trinket", "trinket:"),
             ("^[Kk]([0-9]+)$", "card", "card:"))
CHARACTER_BOX = r"(?i)\{\{\s*infobox\s+character\s*\|\s*(\d+)"
ROOM_TITLE = "^房间$|^房间/|(?:房|房间)$"
ROUTE_TITLE = r"^章节$|^章节/|\(章节\)|（章节）"
ROUTE_CATEGORY = r"(?i)\[\[(?:分类|Category):章节(?:\]|\|)"
# End of fixed values.


def match_overrides(pages: DataFrame, overrides: DataFrame) -> DataFrame:
    """First override (by position) that names the page by title or alias.

    ``pages``: title_key, title, aliases. ``overrides``: position, page_title,
    match_aliases and the entity columns. Only titles and redirects can match,
    never text.
    """
    names = F.concat(F.array("title"), "aliases")
    wanted = pages.select("title_key", F.explode(F.array_distinct(F.transform(names, tx.alias_key))).alias("key"))
    given = F.concat(
        F.array(F.coalesce("page_title", F.lit(""))), F.coalesce("match_aliases", F.array().cast("array<string>"))
    )
    offered = overrides.select(
        "position", F.explode(F.array_distinct(F.transform(F.filter(given, lambda v: v != ""), tx.alias_key))).alias("key")
    ).groupBy("key").agg(F.min("position").alias("position"))
    first = wanted.join(offered, "key").groupBy("title_key").agg(F.min("position").alias("position"))
    chosen = overrides.select(
        "position", F.col("entity_type").alias("o_type"), F.col("entity_id").alias("o_id"),
        F.col("name_zh").alias("o_zh"), F.col("name_en").alias("o_en"), F.col("aliases").alias("o_aliases"),
    )
    return first.join(chosen, "position").drop("position")


def classify(pages: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Add entity_type, entity_id, name_zh, name_en and the alias set to content pages.

    ``pages``: title_key, title, page_id, wikitext, and ``aliases`` (the titles
    that redirect here).
    """
    rows = pages
    if overrides is not None:
        rows = pages.join(match_overrides(pages, overrides), "title_key", "left")
    compact = F.replace("title", F.lit(" "), F.lit(""))
    code = F.lit(None).cast("struct<t:string,i:string>")

    def typed(kind: str, ident: Column) -> Column:
        return F.struct(F.lit(kind).alias("t"), ident.alias("i"))

    def numbered(prefix: str, digits: Column) -> Column:
        return F.concat(F.lit(prefix), F.regexp_replace(digits, "^0+(?=[0-9])", ""))

    page_id = F.col("page_id").cast("string")
    box = F.regexp_extract("wikitext", CHARACTER_BOX, 1)
    route = F.col("title").rlike(ROUTE_TITLE) | F.col("wikitext").rlike(ROUTE_CATEGORY)
    code = F.when(F.lit(False), code)
    for pattern, kind, prefix in ID_TITLES:
        digits = F.regexp_extract(compact, pattern, 1)
        code = code.when(digits != "", typed(kind, numbered(prefix, digits)))
    code = (
        code.when(box != "", typed("character", numbered("player:", box)))
        .when(F.col("title").rlike(ROOM_TITLE), typed("room", F.concat(F.lit("wiki-room:"), page_id)))
        .when(route, typed("route", F.concat(F.lit("wiki-route:"), page_id)))
        .otherwise(typed("wiki_page", F.concat(F.lit("wiki-page:"), page_id)))
    )
    names = tx.unique_aliases(F.concat(F.array("title"), "aliases", intro_aliases(F.col("wikitext"))))
    rows = rows.withColumn("_code", code).withColumn("_names", names)
    zh = F.coalesce(tx.best_name(F.col("_names"), True), "title")
    en = F.coalesce(tx.best_name(F.col("_names"), False), "title")
    if overrides is None:
        fields = {"entity_type": F.col("_code.t"), "entity_id": F.col("_code.i"), "name_zh": zh, "name_en": en,
                  "aliases": F.col("_names")}
    else:
        hit = F.col("o_id").isNotNull()
        fields = {
            "entity_type": F.when(hit, F.col("o_type")).otherwise(F.col("_code.t")),
            "entity_id": F.when(hit, F.col("o_id")).otherwise(F.col("_code.i")),
            "name_zh": F.when(hit, F.col("o_zh")).otherwise(zh),
            "name_en": F.when(hit, F.col("o_en")).otherwise(en),
            "aliases": F.when(hit, tx.unique_aliases(F.concat("_names", "o_aliases"))).otherwise(F.col("_names")),
        }
    kept = [c for c in pages.columns if c not in fields]
    return rows.select(*kept, *[v.alias(k) for k, v in fields.items()])


def merge_entities(rows: DataFrame) -> DataFrame:
    """One row per entity with names and counts.

    ``rows``: entity_id, entity_type, name_zh, name_en, aliases, document_id,
    ``ord`` (total order) and ``structured``. Among pages the first names win;
    structured rows come later and their last names win.
    """
    def name(column: str) -> Column:
        last = F.max_by(column, F.when(F.col("structured"), F.col("ord")))
        return F.coalesce(last, F.min_by(column, "ord")).alias(column)

    return rows.groupBy("entity_id").agg(
        F.min_by("entity_type", "ord").alias("entity_type"), name("name_zh"), name("name_en"),
        F.count("*").alias("rows"),
    )


def entity_aliases(rows: DataFrame) -> DataFrame:
    """Alias set per entity, one row per alias: per normal form the shortest, then folded order."""
    spelled = rows.select("entity_id", "ord", F.posexplode("aliases").alias("at", "raw")).withColumn(
        "alias", tx.norm_plain(F.col("raw"))
    ).withColumn("normalized", tx.alias_key(F.col("alias"))).where(
        (F.col("normalized") != "") & (F.length("alias") <= 120)
    )
    best = F.min(F.struct(F.length("alias").alias("n"), tx.fold(F.col("alias")).alias("f"), "ord", "at", "alias"))
    return spelled.groupBy("entity_id", "normalized").agg(best.alias("b")).select(
        "entity_id", "normalized", F.col("b.alias").alias("alias")
    )


def entity_documents(rows: DataFrame) -> DataFrame:
    return rows.select("entity_id", "document_id").distinct()


def nested_entities(entities: DataFrame, aliases: DataFrame, documents: DataFrame) -> DataFrame:
    """Export form with alias and document arrays inside the entity record."""
    a = aliases.groupBy("entity_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct(tx.fold(F.col("alias")).alias("f"), "alias"))), lambda s: s["alias"]
        ).alias("aliases")
    )
    d = documents.groupBy("entity_id").agg(F.sort_array(F.collect_list("document_id")).alias("document_ids"))
    return entities.join(a, "entity_id", "left").join(d, "entity_id", "left")
