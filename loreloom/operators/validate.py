"""Record rules. Every check adds ``violations``; nothing is dropped silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.functions import text as tx

# Field lists and allowed codes of the raw page record.
NAMESPACES = (0, 10, 828, 3500)
DATA_NAMESPACE = 3500
REQUIRED_TEXT = (
    "authorization_ref", "content_checksum", "content_model", "document_id", "license_note", "retrieved_at",
    "revision_sha1", "revision_timestamp", "revision_url", "source_title", "source_type", "source_url", "title",
    "wikitext",
)
NON_BLANK = (
    "authorization_ref", "document_id", "license_note", "retrieved_at", "revision_sha1", "revision_timestamp",
    "source_title", "source_type",
)
STABLE_ID = "^[A-Za-z0-9_./:+-]+$"
# End of fixed values.


class RuleError(ValueError):
    """Raised in strict mode when any record breaks a rule."""


def broken(rules: dict[str, Column]) -> Column:
    """Names of the rules that do not hold; an unknown result counts as broken."""
    marks = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return F.array_compact(F.array(*marks))


def checksum_of(text: str | Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def page_rules() -> dict[str, Column]:
    present = F.lit(True)
    for name in REQUIRED_TEXT:
        present = present & F.col(name).isNotNull()
    return {
        "json": F.col("_corrupt_record").isNull(),
        "fields": present,
        "schema_version": F.col("schema_version") == 1,
        "ids": F.col("page_id").isNotNull() & F.col("revision_id").isNotNull(),
        "namespace": F.col("namespace").isin(*NAMESPACES),
        "booleans": F.col("redirect").isNotNull() & F.col("stale").isNotNull(),
        "content_model": F.col("content_model") != "",
        "checksum": F.col("content_checksum") == checksum_of("wikitext"),
        "https": F.startswith("source_url", F.lit("https://")),
        "redirect_target": ~F.col("redirect") | tx.redirect_target(F.col("wikitext")).isNotNull(),
    }


def snapshot_rules(namespace: int) -> dict[str, Column]:
    rules = page_rules()
    for name in ("content_model", "redirect_target", "https"):
        rules.pop(name)
    rules["namespace"] = F.col("namespace") == namespace
    rules["title"] = F.startswith("title", F.lit("Data:"))
    rules["https"] = F.startswith("source_url", F.lit("https://")) & F.startswith("revision_url", F.lit("https://"))
    for name in NON_BLANK:
        rules[name] = tx.strip(F.col(name)) != ""
    return rules


def split_valid(rows: DataFrame, rules: dict[str, Column], strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good rows, rows with their violations). ``strict`` raises when there is any."""
    marked = rows.withColumn("violations", broken(rules))
    bad = marked.where(F.size("violations") > 0)
    if strict and not bad.isEmpty():
        first = bad.select("violations").first()[0]
        raise RuleError(f"records break rules, for example {list(first)}")
    return marked.where(F.size("violations") == 0).drop("violations"), bad


def validate_pages(raw: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Valid pages with ``title_key`` and ``redirect_target``, and the rejected rows."""
    good, bad = split_valid(raw, page_rules(), strict)
    target = F.when(F.col("redirect"), tx.redirect_target(F.col("wikitext")))
    return good.drop("_corrupt_record").withColumn("title_key", tx.title_key(F.col("title"))).withColumn(
        "redirect_target", target
    ), bad


def validate_snapshot(raw: DataFrame, namespace: int, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    return split_valid(raw, snapshot_rules(namespace), strict)


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def page_key_violations(pages: DataFrame) -> DataFrame:
    """Repeated (page_id, revision_id) and repeated title keys as (rule, key)."""
    pairs = repeated(pages, "page_id", "revision_id").select(
        F.lit("page_revision").alias("rule"), F.concat_ws("/", "page_id", "revision_id").alias("key")
    )
    titles = repeated(pages, "title_key").select(F.lit("title_key").alias("rule"), F.col("title_key").alias("key"))
    return pairs.unionByName(titles)


def titles_with_two_revisions(pages: DataFrame) -> DataFrame:
    return pages.groupBy("title").agg(
        F.count_distinct(F.struct("page_id", "revision_id")).alias("revisions")
    ).where("revisions > 1")


def content_pages(pages: DataFrame) -> DataFrame:
    return pages.where((F.col("namespace") == 0) & ~F.col("redirect"))


def curated_rules() -> dict[str, Column]:
    filled = lambda name: tx.strip(F.col(name)) != ""
    rules = {name: F.col(name).rlike(STABLE_ID) for name in ("document_id", "entity_type", "entity_id")}
    rules |= {name: filled(name) for name in ("name_zh", "name_en", "title", "text", "acquired_on", "game_version",
                                              "license_note", "content_version")}
    rules |= {
        "aliases": F.forall("aliases", lambda a: tx.strip(a) != ""),
        "source.id": F.col("source.id").rlike(STABLE_ID),
        "source.type": F.col("source.type").rlike(STABLE_ID),
        "source.title": filled("source.title"),
        "https": F.startswith("source.url", F.lit("https://")),
        "stale": F.col("stale").isNotNull(),
    }
    return rules


def validate_curated(docs: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Curated documents as chunks; a repeated id or checksum is an error, never a drop."""
    good, bad = split_valid(docs, curated_rules(), strict)
    aliases = F.array_sort(F.transform(F.array_distinct(F.transform("aliases", tx.strip)),
                                       lambda a: F.struct(tx.fold(a).alias("f"), a.alias("a"))))
    chunks = good.withColumn("text", tx.squeeze(F.col("text"))).withColumn(
        "aliases", F.transform(aliases, lambda s: s["a"])
    ).withColumn("chunk_id", F.concat("document_id", F.lit("#0001")))
    chunks = chunks.withColumn("checksum", row_checksum(chunks))
    if strict:
        for key in ("document_id", "checksum"):
            if not repeated(chunks, key).isEmpty():
                raise RuleError(f"repeated {key} in curated documents")
    return chunks, bad


def row_checksum(df: DataFrame, leave_out: tuple[str, ...] = ("checksum",)) -> Column:
    """Checksum of all columns as JSON with the keys in alphabetical order."""
    names = sorted(c for c in df.columns if c not in leave_out)
    return checksum_of(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}))


def item_fact_rules() -> dict[str, Column]:
    return {
        "collectible_id": F.col("collectible_id") >= 1,
        **{n: tx.strip(F.col(n)) != "" for n in ("name_zh", "name_en", "advice_hint")},
        "facts": (F.size("facts") > 0) & F.forall("facts", lambda x: tx.strip(x) != ""),
        "sources": (F.size("sources") > 0)
        & F.forall("sources", lambda s: (tx.strip(s["id"]) != "") & (tx.strip(s["title"]) != "")
                   & F.startswith(s["url"], F.lit("https://"))),
    }


def is_json_page(title: Column, model: Column) -> Column:
    folded = tx.fold(model)
    return tx.fold(title).rlike(r"\.(?:json|tab|tabx)$") | folded.contains("json") | folded.contains("tabular")
