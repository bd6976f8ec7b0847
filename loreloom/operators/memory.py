"""Long-term memory: candidates, versions per topic, recall and management actions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.functions import text as tx
from loreloom.operators.scan import by_span, running, top_per

# Enumerations, limits and sentence patterns.
KINDS = ("profile", "stable_preference", "guidance_preference", "milestone")
STATUSES = ("active", "disabled", "pending", "conflicted", "deleted")
LEVELS = ("manual", "explicit", "confirmed", "inferred")
SWITCHABLE = ("active", "disabled", "pending")
ALWAYS_RELEVANT_KINDS = ("profile", "guidance_preference")
ALWAYS_RELEVANT_SCORE = 4
MAX_CONTENT = 240
MAX_SOURCE = 120
MAX_EXCERPT = 160
MAX_TURN = 300
NEWEST = 100
SOURCE_STATED = "玩家明确表达"
SOURCE_CORRECTED = "用户在记忆管理中纠正"
EVIDENCE_CORRECTED = "用户手动纠正现有记忆"
PATTERNS = (
    (r"(?:以后)?请叫我[“\"']?([^，。！？!?；;]{1,24})", "profile", "profile:preferred_name", "称呼偏好："),
    (r"(?:以后)?(?:请)?(?:少|不要|别)(?:再)?提醒我?([^，。！？!?；;]{1,60})", "guidance_preference",
     "guidance:reminder", "提示偏好：少提醒"),
    (r"(?:以后)?(?:请)?(?:解释|讲)(?:得)?(详细|简短|简单|深入)(?:一点|些)?", "guidance_preference",
     "guidance:explanation_depth", "解释深度偏好："),
    (r"我(?:很)?喜欢[“\"']?([^，。！？!?；;]{1,60})", "stable_preference", None, "喜欢"),
)
DETAIL_TRIM = " “\"'”"
# End of fixed values.


def extract_candidates(
    turns: DataFrame, patterns: Sequence[tuple] = PATTERNS, max_turn: int | None = MAX_TURN
) -> DataFrame:
    """Preference candidates out of user turns; all columns of ``turns`` are kept.

    Turns longer than ``max_turn`` characters state no preference; None reads them all.

    Each pattern is (regex with one group, kind, topic key or None, content prefix).
    """
    value = tx.squeeze(F.col("text"))
    short = F.lit(True) if max_turn is None else F.length("_v") <= max_turn
    clean = turns.withColumn("_v", value).where((F.col("_v") != "") & short & ~tx.looks_unsafe(F.col("_v")))
    options = []
    for number, (regex, kind, topic, prefix) in enumerate(patterns):
        detail = F.btrim(F.regexp_extract("_v", regex, 1), F.lit(DETAIL_TRIM))
        options.append(
            F.when(
                detail != "",
                F.struct(
                    F.lit(number).alias("pattern_no"),
                    F.lit(kind).alias("kind"),
                    F.lit(topic).cast("string").alias("topic"),
                    F.concat(F.lit(prefix), detail).alias("content"),
                    F.substring(F.regexp_extract("_v", regex, 0), 1, 120).alias("evidence"),
                ),
            )
        )
    found = clean.withColumn("_c", F.explode(F.array_compact(F.array(*options))))
    return found.select(
        *turns.columns, "_c.*",
        F.lit(SOURCE_STATED).alias("source"), F.lit(1.0).alias("confidence"),
        F.lit("explicit").alias("confirmation_level"),
    )


def validate_candidates(df: DataFrame, markers: Sequence[str] = tx.UNSAFE_MARKERS) -> DataFrame:
    """Normalise text columns and list the broken rules of each candidate."""
    rows = df.withColumn("content", tx.squeeze(F.col("content"))).withColumn(
        "source", tx.squeeze(F.col("source"))
    )
    rules = {
        "kind": F.col("kind").isin(*KINDS),
        "confirmation_level": F.col("confirmation_level").isin(*LEVELS),
        "confidence": F.col("confidence").between(0, 1),
        "content": F.length("content").between(1, MAX_CONTENT),
        "source": F.length("source").between(1, MAX_SOURCE),
        "unsafe": ~tx.looks_unsafe(F.col("content"), markers)
        & ~tx.looks_unsafe(F.coalesce("evidence", F.lit("")), markers),
    }
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return rows.withColumn("violations", F.array_compact(F.array(*broken))).withColumn(
        "evidence", F.substring("evidence", 1, MAX_EXCERPT)
    )


def candidate_status() -> Column:
    weak = (F.col("confirmation_level") == "inferred") | (F.col("confidence") < 0.8)
    return F.when(weak, "pending").otherwise("active")


def memory_versions(
    candidates: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column
) -> DataFrame:
    """Memories out of valid candidates in order.

    A candidate with the text of the latest memory of its topic refreshes it:
    highest confidence, latest level, source and status. Any other text starts a
    new memory and leaves the one before ``conflicted``, even when the newcomer
    is only pending. Needs content, confidence, confirmation_level, source and
    ``at`` (time); ``keys`` are typically (kind, topic_key).
    """
    keys = list(keys)
    rows = candidates.withColumn("normalized", tx.memory_key(F.col("content")))
    seen = running(
        rows, keys, order, chunk, {"_before": ("prev", F.col("normalized")), "_n": ("count", F.lit(1))},
        keep_chunk=True,
    )
    fresh = (F.col("_n") == 0) | ~F.col("normalized").eqNullSafe(F.col("_before"))
    numbered = running(
        seen.withColumn("_new", fresh.cast("long")), keys, order, F.col("_chunk"),
        {"version": ("sum", F.col("_new"))}, inclusive=True,
    )
    place = F.struct(*order)
    versions = numbered.groupBy(*keys, "version").agg(
        F.min_by("content", place).alias("content"),
        F.max("confidence").alias("confidence"),
        F.max_by(candidate_status(), place).alias("latest_status"),
        F.max_by("confirmation_level", place).alias("confirmation_level"),
        F.max_by("source", place).alias("source_summary"),
        F.min("at").alias("created_at"),
        F.max("at").alias("updated_at"),
        F.count("*").alias("evidence_count"),
    )
    last = versions.groupBy(*keys).agg(F.max("version").alias("_last"))
    return versions.join(last, keys).withColumn(
        "status", F.when(F.col("version") == F.col("_last"), F.col("latest_status")).otherwise("conflicted")
    ).withColumn(
        "supersedes_version", F.when(F.col("version") > 1, F.col("version") - 1)
    ).drop("_last", "latest_status")


def recall(
    queries: DataFrame, memories: DataFrame, owner: str, max_items: int = 3, max_chars: int = 360, newest_only: int | None = NEWEST
) -> DataFrame:
    """Memories each query may use: (query_id, item_no, id, content, kind, score).

    Only the ``newest_only`` newest active memories of an owner take part, so the list that
    travels with a query has a fixed bound; None lets all take part. In score order an item is taken when
    it fits the characters left; one that does not fit is skipped.
    """
    active = memories.where("status = 'active'")
    order = [F.col("updated_at").desc(), F.col("id").desc()]
    newest = active if newest_only is None else top_per(active, [owner], order, newest_only)
    packed = newest.groupBy(owner).agg(
        F.collect_list(
            F.struct("updated_at", "id", "kind", "content", tx.bigrams(tx.memory_key(F.col("content"))).alias("pairs"))
        ).alias("_memories")
    )
    asked = queries.withColumn("_pairs", tx.bigrams(tx.memory_key(F.col("query")))).join(packed, owner)
    base = lambda m: F.when(m["kind"].isin(*ALWAYS_RELEVANT_KINDS), ALWAYS_RELEVANT_SCORE).otherwise(0)
    scored = F.transform(
        "_memories",
        lambda m: F.struct(
            (base(m) + F.size(F.array_intersect("_pairs", m["pairs"]))).alias("score"),
            m["updated_at"].alias("updated_at"), m["id"].alias("id"),
            m["content"].alias("content"), m["kind"].alias("kind"),
        ),
    )
    ranked = F.sort_array(F.filter(scored, lambda m: m["score"] > 0), asc=False)
    # The generator makes the ranked list a column of its own, computed once per query.
    flat = asked.select("query_id", owner, F.explode(F.array(ranked)).alias("_ranked"))
    pick = "struct<used:int,at:array<int>>"
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("at")).cast(pick)

    def take(acc: Column, i: Column) -> Column:
        size = F.length(F.element_at("_ranked", i)["content"])
        fits = (F.size(acc["at"]) < max_items) & (size <= max_chars - acc["used"])
        taken = F.struct(
            (acc["used"] + size).cast("int").alias("used"),
            F.concat(acc["at"], F.array(i.cast("int"))).alias("at"),
        )
        return F.when(fits, taken).otherwise(acc)

    places = F.when(F.size("_ranked") > 0, F.sequence(F.lit(1), F.size("_ranked"))).otherwise(
        F.array().cast("array<int>")
    )
    chosen = F.aggregate(places, start, take)["at"]
    picked = flat.select(
        "query_id", owner,
        F.posexplode(F.transform(chosen, lambda i: F.element_at("_ranked", i))).alias("item_no", "m"),
    )
    return picked.select("query_id", owner, (F.col("item_no") + 1).alias("item_no"), "m.*")


def stamp_used(memories: DataFrame, picks: DataFrame, now: Column) -> DataFrame:
    """Set ``last_used_at`` on the recalled rows only."""
    used = picks.select("id").distinct().withColumn("_used", F.lit(True))
    return memories.join(used, "id", "left").withColumn(
        "last_used_at", F.when(F.col("_used"), now).otherwise(F.col("last_used_at"))
    ).drop("_used")


def valid_corrections(actions: DataFrame) -> DataFrame:
    """The corrections of an action log that are carried out: content of a proper length, nothing unsafe, a known kind or none."""
    content = F.col("content")
    return actions.where(
        (F.col("action") == "correct") & F.col("id").isNotNull() & F.length(tx.squeeze(content)).between(1, MAX_CONTENT)
        & ~tx.looks_unsafe(content) & (F.col("kind").isNull() | F.col("kind").isin(*KINDS))
    )


def correction_evidence(memories: DataFrame, actions: DataFrame, span: int = 100_000) -> DataFrame:
    """(memory_id, source, excerpt, created_at): every correction of a memory that exists at that time leaves a piece of evidence.

    A memory is gone from its first deletion on, and with a clear that comes after its creation. Rows go to the evidence table;
    ``surviving_evidence`` then drops those of memories that were deleted later.
    """
    gone = actions.where("action = 'delete' AND id IS NOT NULL").groupBy("id").agg(F.min("at").alias("gone_at"))
    clears = actions.where("action = 'clear'").select("at", F.lit(1).alias("n"))
    fixes = valid_corrections(actions).select("id", "at")
    held = fixes.join(memories.select("id", "created_at"), "id").join(gone, "id", "left").where(F.col("gone_at").isNull() | (F.col("at") < F.col("gone_at")))
    # clears before the memory and before the correction: more of them in between, and the memory was gone
    ends = held.select("id", F.col("at").alias("fixed_at"), F.explode(F.array(F.struct(F.lit(0).alias("row"), F.col("created_at").alias("at")), F.struct(
        F.lit(1).alias("row"), F.col("at")))).alias("e")).select("id", "fixed_at", "e.*", F.lit(0).alias("n"))
    marks = ends.unionByName(clears, allowMissingColumns=True)
    counted = running(marks, [], ["at", "n", "row", "id", "fixed_at"], F.floor(F.col("at").cast("double") / span).cast("long"), {"before": ("sum", F.col("n"))})
    alive = counted.where("n = 0").groupBy("id", "fixed_at").agg((F.max("before") == F.min("before")).alias("alive"))
    return alive.where("alive").select(
        F.col("id").alias("memory_id"), F.lit(SOURCE_CORRECTED).alias("source"), F.lit(EVIDENCE_CORRECTED).alias("excerpt"), F.col("fixed_at").alias("created_at")
    )


def apply_actions(memories: DataFrame, actions: DataFrame) -> DataFrame:
    """Memory table after an action log: correct, enable, disable, delete, clear.

    ``actions``: at, action, id (null for clear), content, kind. The outcome per
    memory only needs its last correction and the switches after it, so a long
    log of one memory is reduced by partial aggregates, not replayed.
    """
    per_id = actions.where("id IS NOT NULL")
    fixes = valid_corrections(per_id).groupBy("id").agg(
        F.max("at").alias("fixed_at"),
        F.max_by(tx.squeeze(F.col("content")), "at").alias("new_content"),
        F.max_by("kind", F.when(F.col("kind").isNotNull(), F.col("at"))).alias("new_kind"),
    )
    gone = per_id.where("action = 'delete'").select("id").distinct()
    cleared = actions.where("action = 'clear'").agg(F.max("at").alias("at")).select("at").scalar()
    alive = memories.join(gone, "id", "left_anti").where(
        cleared.isNull() | (F.col("created_at") > cleared)
    ).join(fixes, "id", "left")
    switches = per_id.where(F.col("action").isin("enable", "disable")).join(
        fixes.select("id", "fixed_at"), "id", "left"
    ).where(F.col("fixed_at").isNull() | (F.col("at") > F.col("fixed_at"))).groupBy("id").agg(
        F.max("at").alias("switched_at"),
        F.max_by("action", "at").alias("last_switch"),
        F.max(F.col("action") == "enable").alias("was_enabled"),
    )
    fixed = F.col("fixed_at").isNotNull()
    can_switch = fixed | F.col("status").isin(*SWITCHABLE)
    switched = can_switch & F.col("last_switch").isNotNull()
    enabled = switched & F.col("was_enabled")
    confidence = F.when(fixed, 1.0).otherwise(F.col("confidence"))
    rows = alive.join(switches, "id", "left")
    new = {
        "content": F.coalesce("new_content", "content"),
        "kind": F.coalesce("new_kind", "kind"),
        "status": F.when(switched, F.when(F.col("last_switch") == "enable", "active").otherwise("disabled"))
        .when(fixed, "active").otherwise(F.col("status")),
        "confidence": F.when(enabled, F.greatest(confidence, F.lit(0.8))).otherwise(confidence),
        "confirmation_level": F.when(enabled, "confirmed").when(fixed, "manual").otherwise(
            F.col("confirmation_level")
        ),
        "source_summary": F.when(fixed, F.lit(SOURCE_CORRECTED)).otherwise(F.col("source_summary")),
        "updated_at": F.coalesce(F.when(switched, F.col("switched_at")), "fixed_at", "updated_at"),
    }
    return rows.select(*[new.get(c, F.col(c)).alias(c) for c in memories.columns])


def surviving_evidence(evidence: DataFrame, memories: DataFrame) -> DataFrame:
    return evidence.join(memories.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")


def memories_with_evidence(memories: DataFrame, evidence: DataFrame, span: int = 100_000) -> DataFrame:
    """Memory rows with their evidence in id order; without evidence one row of nulls."""
    numbered = running(
        evidence, ["memory_id"], ["id"], by_span("id", span), {"evidence_no": ("count", F.lit(1))}, inclusive=True
    ).select(F.col("memory_id").alias("id"), "evidence_no", "source", "excerpt", F.col("created_at").alias("evidence_at"))
    return memories.join(numbered, "id", "left")
