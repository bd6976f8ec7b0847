"""Evidence for answers, answer guards and text preparation around an answer."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreloom.functions import text as tx
from loreloom.operators.retrieve import describe_entities
from loreloom.operators.scan import top_per

# Field names, length limits, claim patterns and fixed texts.
DRAFT_KEYS = ("advice", "confidence", "reason", "sources", "state_seq")
QUERY_LIMITS = {"advice": 240, "reason": 320, "min_sources": 0, "max_sources": 5}
ADVICE_LIMITS = {"advice": 160, "reason": 240, "min_sources": 1, "max_sources": 5}
VISUAL_KEYS = ("confidence", "evidence_type", "explanation", "identification", "scene", "state_seq")
VISUAL_EVIDENCE = "visual_supplement"
ROLE_CLAIM = r"当前角色(?:是|为)\s*([^，。；：:（(]+)"
ACTIVE_ITEM_CLAIM = r"(?:持有|携带)(?:的)?主动道具(?:是|为)?\s*([^，。；：:（(]+)"
NO_ANSWER = "当前离线资料中没有与这个问题匹配的内容；连接在线模型后，我可以继续进行一般问答。"
UNRELIABLE = "无法可靠识别"
UNRELIABLE_WHY = "当前画面的视觉证据置信度不足，请补充文字描述或稍后重试。"
DEFAULT_HINT = "建议结合当前构筑评估后拾取。"
CORRECTED_TYPES = ("item", "character", "room", "route", "trinket", "card")
MAX_CORRECTIONS = 320
BASE_CORRECTIONS = {
    "妈刀": "妈妈的菜刀", "硫磺火": "硫磺火", "r key": "R键", "boss rush": "Boss Rush",
    "恶魔房": "恶魔房", "天使房": "天使房",
}
# End of fixed values.


def evidence_json(hits: DataFrame, max_chars: int = 2000, max_hits: int = 3, max_text: int = 500) -> DataFrame:
    """One bounded JSON record of the top hits per query.

    ``hits``: query_id, rank, chunk_id, entity_type, entity_id, text, source_id,
    source_title. A record over the limit is replaced by a short error record.
    """
    item = F.struct(
        "rank",
        F.struct(
            "entity_type", "entity_id", F.substring("text", 1, max_text).alias("text"), "source_id", "source_title"
        ).alias("hit"),
    )
    top = hits.where(F.col("rank") <= max_hits).groupBy("query_id").agg(
        F.transform(F.sort_array(F.collect_list(item)), lambda s: s["hit"]).alias("data")
    )
    return top.select("query_id", bounded_json(F.struct(F.lit(True).alias("ok"), "data"), max_chars).alias("evidence"))


def bounded_json(record: Column, max_chars: int) -> Column:
    encoded = F.to_json(record)
    error = F.lit('{"ok":false,"code":"result_too_large"}')
    return F.when(F.length(encoded) <= max_chars, encoded).otherwise(F.substring(error, 1, max_chars))


def shorten(c: Column, limit: int = 120) -> Column:
    """White space collapsed; longer text is cut to one less and gets an ellipsis."""
    flat = tx.squeeze(c)
    cut = F.concat(F.regexp_replace(F.substring(flat, 1, limit - 1), r"(?U)\s+$", ""), F.lit("…"))
    return F.when(F.length(flat) > limit, cut).otherwise(flat)


def fallback_answer(queries: DataFrame, hits: DataFrame) -> DataFrame:
    best = hits.groupBy("query_id").agg(F.min_by("text", "rank").alias("best"))
    return queries.join(best, "query_id", "left").select(
        "query_id", F.coalesce(shorten(F.col("best")), F.lit(NO_ANSWER)).alias("answer")
    )


def _broken(rules: dict[str, Column]) -> Column:
    marks = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return F.array_compact(F.array(*marks))


def _variant_kind(path: str) -> Column:
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get("_v", path, "variant")), "^[A-Z]+", 0)


def _number(path: str) -> Column:
    numeric = _variant_kind(path).isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT")
    return F.when(numeric, F.try_variant_get("_v", path, "double"))


def _text(path: str) -> Column:
    return F.when(_variant_kind(path) == "STRING", tx.strip(F.try_variant_get("_v", path, "string")))


def _opened(drafts: DataFrame, fields: Column) -> DataFrame:
    """Parse ``content`` once; the generators keep the parsed struct a real column."""
    parsed = drafts.select("*", F.explode_outer(F.array(F.try_parse_json("content"))).alias("_v"))
    return parsed.select("*", F.explode_outer(F.array(fields)).alias("_f")).drop("_v")


def guard_answers(drafts: DataFrame, limits: dict = QUERY_LIMITS) -> DataFrame:
    """Check answer drafts. ``drafts``: content JSON, allowed_sources array, expected_seq.

    Adds the draft fields, ``broken_rules`` and ``valid``. Sources keep their
    first-seen order without repeats.
    """
    listed = F.when(
        _variant_kind("$.sources") == "ARRAY", F.try_variant_get("_v", "$.sources", "array<variant>")
    )
    kinds = F.transform(listed, lambda v: F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0))
    fields = F.struct(
        F.array_sort(F.json_object_keys("content")).alias("keys"),
        _text("$.advice").alias("advice"),
        _text("$.reason").alias("reason"),
        _number("$.confidence").alias("confidence"),
        F.when(
            F.forall(kinds, lambda k: k == "STRING"), F.try_variant_get("_v", "$.sources", "array<string>")
        ).alias("sources"),
        F.when(_variant_kind("$.state_seq") == "BIGINT", F.try_variant_get("_v", "$.state_seq", "long")).alias("state_seq"),
    )
    rows = _opened(drafts, fields)
    f = lambda name: F.col(f"_f.{name}")
    rules = {
        "keys": f("keys") == F.array(*[F.lit(k) for k in DRAFT_KEYS]),
        "advice": F.length(f("advice")).between(1, limits["advice"]),
        "reason": F.length(f("reason")).between(1, limits["reason"]),
        "confidence": f("confidence").between(0, 1),
        "state_seq": f("state_seq") == F.col("expected_seq"),
        "source_count": F.size(f("sources")).between(limits["min_sources"], limits["max_sources"]),
        "source_allowed": F.size(F.array_except(f("sources"), "allowed_sources")) == 0,
    }
    return rows.select(
        *drafts.columns,
        f("advice").alias("advice"), f("reason").alias("reason"), f("confidence").alias("confidence"),
        F.array_distinct(f("sources")).alias("sources"), f("state_seq").alias("state_seq"),
        _broken(rules).alias("broken_rules"),
    ).withColumn("valid", F.size("broken_rules") == 0)


def guard_claims(drafts: DataFrame) -> DataFrame:
    """A role or active item named in ``advice`` must be the resolved one.

    ``drafts`` carries role_name and active_item_name (null when not resolved).
    """
    def agrees(pattern: str, expected: str) -> Column:
        claims = F.transform(
            F.regexp_extract_all("advice", F.lit(pattern), F.lit(1)),
            lambda c: F.regexp_replace(tx.strip(c), "[，。；：:]+$", ""),
        )
        unknown = F.coalesce(F.col(expected), F.lit("")) == ""
        return unknown | F.coalesce(F.forall(claims, lambda c: c == F.col(expected)), F.lit(True))

    return drafts.withColumn(
        "claims_ok", agrees(ROLE_CLAIM, "role_name") & agrees(ACTIVE_ITEM_CLAIM, "active_item_name")
    )


def guard_visual(results: DataFrame, min_confidence: float) -> DataFrame:
    """Check visual results. ``results``: content JSON, expected_seq, expected_scene.

    A valid result below ``min_confidence`` gets the fixed "unreliable" texts.
    """
    fields = F.struct(
        F.array_sort(F.json_object_keys("content")).alias("keys"),
        _text("$.identification").alias("identification"),
        _text("$.explanation").alias("explanation"),
        _number("$.confidence").alias("confidence"),
        F.when(_variant_kind("$.state_seq") == "BIGINT", F.try_variant_get("_v", "$.state_seq", "long")).alias("state_seq"),
        F.when(_variant_kind("$.evidence_type") == "STRING", F.try_variant_get("_v", "$.evidence_type", "string")).alias("evidence_type"),
        F.when(_variant_kind("$.scene") == "STRING", F.try_variant_get("_v", "$.scene", "string")).alias("scene"),
    )
    rows = _opened(results, fields)
    f = lambda name: F.col(f"_f.{name}")
    rules = {
        "keys": f("keys") == F.array(*[F.lit(k) for k in VISUAL_KEYS]),
        "identification": F.length(f("identification")).between(1, 160),
        "explanation": F.length(f("explanation")).between(1, 240),
        "confidence": f("confidence").between(0, 1),
        "state_seq": f("state_seq") == F.col("expected_seq"),
        "evidence_type": f("evidence_type") == VISUAL_EVIDENCE,
        "scene": f("scene") == F.col("expected_scene"),
    }
    weak = f("confidence") < min_confidence
    return rows.select(
        *results.columns,
        F.when(weak, F.lit(UNRELIABLE)).otherwise(f("identification")).alias("identification"),
        F.when(weak, F.lit(UNRELIABLE_WHY)).otherwise(f("explanation")).alias("explanation"),
        f("confidence").alias("confidence"),
        (~weak).alias("reliable"),
        _broken(rules).alias("broken_rules"),
    ).withColumn("valid", F.size("broken_rules") == 0)


def valid_tool_calls(calls: DataFrame) -> DataFrame:
    """Add ``error`` to read-only lookup calls: name, arguments JSON, repeated ids aside."""
    keys = F.json_object_keys("arguments")
    query = F.from_json("arguments", "query string, top_k bigint")
    has = lambda name: F.array_contains(keys, F.lit(name))
    searching = F.col("name").isin("retrieve_local_rag", "recall_confirmed_preferences")
    allowed = F.when(F.col("name") == "recall_confirmed_preferences", F.array(F.lit("query"))).otherwise(
        F.array(F.lit("query"), F.lit("top_k"))
    )
    bad_query = ~has("query") | (tx.strip(query["query"]) == "") | (F.length(query["query"]) > 120)
    error = (
        F.when(~F.length("call_id").between(1, 128), "invalid_call_id")
        .when(~(searching | (F.col("name") == "get_current_game_state")), "unknown_tool")
        .when(keys.isNull(), "invalid_arguments")
        .when(~searching & (F.size(keys) > 0), "invalid_arguments")
        .when(searching & (F.size(F.array_except(keys, allowed)) > 0), "invalid_arguments")
        .when(searching & F.coalesce(bad_query, F.lit(True)), "invalid_arguments")
        .when(searching & has("top_k") & ~F.coalesce(query["top_k"].between(1, 3), F.lit(False)), "invalid_arguments")
    )
    return calls.withColumn("error", error)


def resolve_identities(players: DataFrame, chunks: DataFrame) -> DataFrame:
    """Names for the player's role and active item. ``players``: player_type, active_item."""
    def named(kind: str, prefix: str, source: str, target: str, df: DataFrame) -> DataFrame:
        ids = df.select(source).where(f"{source} IS NOT NULL").distinct().select(
            source, F.lit(kind).alias("entity_type"),
            F.concat(F.lit(prefix), F.col(source).cast("string")).alias("entity_id"),
        )
        names = describe_entities(ids, chunks).select(source, F.col("name_zh").alias(target))
        return df.join(names, source, "left")

    with_role = named("character", "player:", "player_type", "role_name", players)
    return named("item", "collectible:", "active_item", "active_item_name", with_role)


def item_descriptor(ids: DataFrame, items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Names of an item: the fact dictionary first, then the corpus."""
    wanted = ids.select(
        "collectible_id", F.lit("item").alias("entity_type"),
        F.concat(F.lit("collectible:"), F.col("collectible_id").cast("string")).alias("entity_id"),
    )
    corpus = describe_entities(wanted, chunks).select(
        "collectible_id", F.col("name_zh").alias("c_zh"), F.col("name_en").alias("c_en")
    )
    facts = items.select("collectible_id", F.col("name_zh").alias("f_zh"), F.col("name_en").alias("f_en"))
    joined = ids.join(facts, "collectible_id", "left").join(corpus, "collectible_id", "left")
    return joined.select(
        "collectible_id", F.coalesce("f_zh", "c_zh").alias("name_zh"), F.coalesce("f_en", "c_en").alias("name_en")
    ).where("name_zh IS NOT NULL")


def item_evidence(triggers: DataFrame, hits: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Evidence per triggered item out of its own hits: first names and text, up to five sources.

    ``hits`` come from searching the item id: query_id = collectible_id, at most top-k rows each.
    """
    own = hits.where(
        F.col("entity_id") == F.concat(F.lit("collectible:"), F.col("query_id").cast("string"))
    )
    ordered = F.sort_array(F.collect_list(F.struct("rank", F.col("source.id").alias("id"))))
    found = own.groupBy(F.col("query_id").alias("collectible_id")).agg(
        F.min_by("name_zh", "rank").alias("name_zh"),
        F.min_by("name_en", "rank").alias("name_en"),
        F.min_by("text", "rank").alias("text"),
        F.slice(F.array_distinct(F.transform(ordered, lambda s: s["id"])), 1, 5).alias("source_ids"),
    )
    if items is None:
        found = found.withColumn("hint", F.lit(DEFAULT_HINT))
    else:
        hints = items.select("collectible_id", F.col("advice_hint").alias("hint"))
        found = found.join(hints, "collectible_id", "left").fillna({"hint": DEFAULT_HINT})
    return triggers.join(found, "collectible_id")


AnswerFn = Callable[[pd.DataFrame], pd.Series]


def answer_batch(questions: DataFrame, hits: DataFrame, answer_fn: AnswerFn, max_question: int | None = 300) -> DataFrame:
    """Answer questions with a user function and guard the drafts.

    ``questions``: query_id, question, state_seq, role_name, active_item_name.
    ``hits``: at most top-k rows per query with rank, text and source. The
    function gets a frame with question, evidence and allowed_sources and returns
    draft JSON. A draft that fails a check is replaced by the best evidence. An empty question, or one longer than
    ``max_question`` (None for no limit), is not asked and gets a row with the error and no answer.
    """
    ordered = F.sort_array(F.collect_list(F.struct("rank", F.col("source.id").alias("id"), "text")))
    evidence = hits.groupBy("query_id").agg(ordered.alias("_hits"))
    size = F.length(F.coalesce(tx.strip(F.col("question")), F.lit("")))
    refused = F.when(size == 0, "empty question").when(F.lit(max_question is not None) & (size > (max_question or 0)), "question too long")
    errors = questions.where(refused.isNotNull()).select("query_id", "question", "state_seq", refused.alias("refused"))
    asked = questions.where(refused.isNull()).join(evidence, "query_id", "left")
    asked = asked.withColumn(
        "allowed_sources",
        F.coalesce(F.array_distinct(F.transform("_hits", lambda h: h["id"])), F.array().cast("array<string>")),
    ).withColumn(
        "fallback", F.coalesce(shorten(F.get("_hits", F.lit(0))["text"]), F.lit(NO_ANSWER))
    ).withColumn("evidence", F.to_json("_hits")).drop("_hits")
    schema = T.StructType(asked.schema.fields + [T.StructField("content", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(content=answer_fn(frame))

    drafts = asked.mapInPandas(run, schema).withColumn("expected_seq", F.col("state_seq")).drop("state_seq")
    checked = guard_claims(guard_answers(drafts))
    good = F.col("valid") & F.col("claims_ok")
    answered = checked.select(
        "query_id", "question",
        F.when(good, F.col("advice")).otherwise(F.col("fallback")).alias("answer"),
        F.when(good, F.col("sources")).otherwise(F.slice("allowed_sources", 1, 1)).alias("sources"),
        F.col("expected_seq").alias("state_seq"),
        F.when(good, F.lit(None).cast("string")).when(F.col("valid"), "state claim").otherwise("format or source").alias("replaced_because"),
        "broken_rules",
    )
    return answered.unionByName(errors.select(
        "query_id", "question", F.lit(None).cast("string").alias("answer"), F.array().cast("array<string>").alias("sources"),
        F.col("state_seq").cast(answered.schema["state_seq"].dataType).alias("state_seq"), F.col("refused").alias("replaced_because"),
        F.array().cast(answered.schema["broken_rules"].dataType).alias("broken_rules"),
    ))


def carry_summary(turns: DataFrame, session: str, order: str, utterance: Column, last: int = 12, max_chars: int = 600) -> DataFrame:
    """The last utterances of a session joined, rightmost ``max_chars`` kept."""
    recent = top_per(turns.withColumn("_u", utterance), [session], [F.col(order).desc()], last)
    joined = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct(order, "_u"))), lambda s: s["_u"]), "；"
    )
    return recent.groupBy(session).agg(joined.alias("_j")).select(
        session, F.substring("_j", F.greatest(F.lit(1), F.length("_j") - max_chars + 1), F.lit(max_chars)).alias("summary")
    )


def correction_table(entities: DataFrame, limit: int = MAX_CORRECTIONS) -> dict[str, str]:
    """Alias to name replacements: the fixed ones, then aliases in entity order up to ``limit``.

    The limit makes this a small dictionary, and only that many rows are read back.
    """
    target = F.coalesce(F.when(F.col("name_zh") != "", F.col("name_zh")), F.col("name_en"))
    rows = entities.where(F.col("entity_type").isin(*CORRECTED_TYPES)).select(
        "entity_type", "entity_id", target.alias("target"), F.posexplode("aliases").alias("at", "alias")
    ).where(
        F.length("alias").between(2, 40) & (tx.fold(F.col("alias")) != tx.fold(F.col("target")))
        & ~F.col("alias").isin(*BASE_CORRECTIONS)
    )
    first = rows.groupBy("alias").agg(F.min(F.struct("entity_type", "entity_id", "at", "target")).alias("s"))
    room = max(0, limit - len(BASE_CORRECTIONS))
    taken = first.orderBy("s.entity_type", "s.entity_id", "s.at").limit(room).collect()
    return {**BASE_CORRECTIONS, **{row["alias"]: row["s"]["target"] for row in taken}}


def correct_terms(df: DataFrame, column: str, replacements: dict[str, str]) -> DataFrame:
    """Replace terms, longest first; ASCII terms match in any case."""
    text = tx.strip(F.col(column))
    for source, target in sorted(replacements.items(), key=lambda item: -len(item[0])):
        if source.isascii():
            quoted = "(?i)" + re.escape(source)
            text = F.regexp_replace(text, F.lit(quoted), F.lit(target.replace("\\", "\\\\").replace("$", "\\$")))
        else:
            text = F.replace(text, F.lit(source), F.lit(target))
    return df.withColumn(column, text)


# What is removed before text is spoken, and where it may be cut.
SPOKEN_URL = r"https?://\S+"
SPOKEN_ID = r"(?i)\b(?:chunk|entity|request|state)[-_ ]?id\b[^，。；]*"
SENTENCE_END = "(?<=[。！？；])"
# End of fixed values.


def piece_pattern(max_chars: int) -> str:
    """What one piece matches: the rest if it fits, else up to the last comma in the second half, else ``max_chars``."""
    return rf"(?s)\s*(.{{1,{max_chars}}}$|.{{{max_chars // 2},{max_chars - 1}}}[，、]|.{{1,{max_chars}}})"


def segment_text(df: DataFrame, column: str, max_chars: int) -> DataFrame:
    """Short segments: whole sentences, long ones cut at a comma or hard at the limit."""
    clean = F.regexp_replace(F.regexp_replace(F.col(column), SPOKEN_URL, ""), SPOKEN_ID, "")
    sentences = F.filter(F.split(tx.squeeze(clean), SENTENCE_END), lambda s: s != "")
    trimmed = F.filter(F.transform(sentences, tx.strip), lambda s: s != "")
    pieces = F.flatten(F.transform(trimmed, lambda s: F.regexp_extract_all(s, F.lit(piece_pattern(max_chars)), F.lit(1))))
    cut = F.filter(F.transform(pieces, tx.strip), lambda s: s != "")
    return df.select("*", F.posexplode(cut).alias("segment_no", "segment"))
