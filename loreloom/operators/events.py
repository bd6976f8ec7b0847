"""Event lines to validated events, ordering checks, visits, changes and staleness.

Batch forms. Everything that follows the order inside a run goes through
``scan.running``, so one very long run is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.functions import text as tx
from loreloom.operators.scan import CHUNK, by_span, running, top_per

# Envelope of an event.
SCHEMA_VERSION = 1
ROOM_FIELDS = ("room_index", "room_spawn_seed")
CONTEXT_FIELDS = (
    "stage", "stage_type", "room_index", "room_type", "room_variant", "room_spawn_seed",
)
ENVELOPE_FIELDS = ("schema_version", "seq", "run_id", "type", "game_frame", "context", "payload")
ITEM_ROOM_TYPE = 4
# End of fixed values.

DEFAULT_PREFIX = "[EVENT]"


def event_json(line: Column, prefix: str = DEFAULT_PREFIX) -> Column:
    """JSON part of a log line: after the prefix, or a bare object; otherwise null."""
    text = tx.strip(line)
    at = F.instr(text, prefix)
    after = tx.strip(F.substring(text, at + len(prefix), F.length(text)))
    return F.when(at > 0, after).when(F.startswith(text, F.lit("{")), text)


def _members(value: str, names: Sequence[str]) -> Column:
    """Members of an object value, each a variant of its own; null when the value is no object."""
    return F.try_variant_get(value, "$", "struct<" + ", ".join(f"{name}: variant" for name in names) + ">")


def _kind(value: str) -> Column:
    """Type name of a variant value, an object's with its members; null when the key is absent."""
    return F.schema_of_variant(F.col(value))


def _is_object(value: str) -> Column:
    return F.startswith(_kind(value), F.lit("OBJECT"))


def _whole(value: str) -> Column:
    """Strict whole number: no booleans, strings or fractions."""
    return F.when(_kind(value) == "BIGINT", F.try_variant_get(value, "$", "long"))


def _string(value: str) -> Column:
    return F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def parse_events(lines: DataFrame, line: str = "value", prefix: str = DEFAULT_PREFIX) -> DataFrame:
    """One row per line with ``status`` valid, invalid or ignored and the event columns.

    Stateless, so the same function serves batch and streaming input.
    """
    # Single-element generators keep the parse a step of its own: their output is a
    # column, so later filters and projections cannot repeat the parsing.
    kept = [c for c in lines.columns]
    tokens = lines.select(*kept, event_json(F.col(line), prefix).alias("json"))
    # The object is taken apart once; a path per field would search it from the root each time.
    tokens = tokens.select("*", F.explode_outer(F.array(F.try_parse_json("json"))).alias("v"))
    tokens = tokens.select(*kept, "json", F.explode_outer(F.array(_members("v", ENVELOPE_FIELDS))).alias("m"))
    tokens = tokens.select("*", F.explode_outer(F.array(_members("m.context", (*CONTEXT_FIELDS, "room_clear")))).alias("c"))
    context = F.struct(
        *[_whole(f"c.{name}").alias(name) for name in CONTEXT_FIELDS],
        F.when(_kind("c.room_clear") == "BOOLEAN", F.try_variant_get("c.room_clear", "$", "boolean")).alias("room_clear"),
    )
    envelope = F.struct(
        F.col("m").isNotNull().alias("is_object"),
        _whole("m.schema_version").alias("schema_version"),
        _whole("m.seq").alias("seq"),
        _string("m.run_id").alias("run_id"),
        _string("m.type").alias("type"),
        _whole("m.game_frame").alias("game_frame"),
        F.coalesce(_is_object("m.context"), F.lit(True)).alias("context_ok"),
        F.coalesce(_is_object("m.payload"), F.lit(True)).alias("payload_ok"),
        context.alias("context"),
        F.coalesce(F.to_json("m.payload"), F.lit("{}")).alias("payload"),
    )
    parsed = tokens.select(*kept, "json", F.explode_outer(F.array(envelope)).alias("e"))
    rules = {
        "json": F.col("e.is_object"),
        "schema_version": F.col("e.schema_version") == SCHEMA_VERSION,
        "seq": F.col("e.seq") >= 1,
        "run_id": F.col("e.run_id") != "",
        "type": F.col("e.type") != "",
        "game_frame": F.col("e.game_frame") >= 0,
        "context": F.col("e.context_ok"),
        "payload": F.col("e.payload_ok"),
    }
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    )
    return parsed.select(
        *kept,
        *[F.col(f"e.{f}").alias(f) for f in ENVELOPE_FIELDS],
        F.when(F.col("json").isNotNull(), broken).alias("broken_rules"),
    ).withColumn(
        "status",
        F.when(F.col("broken_rules").isNull(), "ignored")
        .when(F.size("broken_rules") > 0, "invalid")
        .otherwise("valid"),
    )


def valid_events(parsed: DataFrame) -> DataFrame:
    return parsed.where("status = 'valid'").drop("status", "broken_rules")


def seq_check(
    events: DataFrame, run: str, seq: str, order: Sequence[str], chunk: Column, keep_chunk: bool = False
) -> DataFrame:
    """Add ``accepted`` and ``gap`` per event in arrival order.

    A sequence number at or below the highest seen is out of order. Rejected
    rows are never above that maximum, so the plain running maximum is exact.
    """
    checked = running(
        events, [run], order, chunk, {"_seen": ("max", F.col(seq))}, keep_chunk=keep_chunk
    )
    seen = F.coalesce("_seen", F.lit(0))
    accepted = F.col(seq) > seen
    gap = F.when(accepted & (seen > 0), F.col(seq) - seen - 1).otherwise(F.lit(0))
    return checked.withColumn("accepted", accepted).withColumn("gap", gap).drop("_seen")


def diagnostics(checked: DataFrame, run: str) -> DataFrame:
    return checked.groupBy(run).agg(
        F.count_if("accepted").alias("parsed_events"),
        F.count_if(~F.col("accepted")).alias("out_of_order_events"),
        F.sum("gap").alias("sequence_gaps"),
    )


def line_counts(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("status").agg(F.count("*").alias("lines"))


def visits(
    events: DataFrame, run: str, seq: str, room: Sequence[str], span: int = 100_000
) -> DataFrame:
    """Number the room visits of each run: a new visit starts when a room column changes.

    ``events`` are the accepted ones. Sequence numbers are unique in a run, so a
    chunk has at most ``span`` rows.
    """
    here = F.struct(*[F.col(c) for c in room])
    with_prev = running(
        events, [run], [seq], by_span(seq, span),
        {"_room": ("prev", here), "_n": ("count", F.col(seq))}, keep_chunk=True,
    )
    changed = F.when(F.col("_n") == 0, 1).otherwise((~F.col("_room").eqNullSafe(here)).cast("int"))
    flagged = with_prev.withColumn("_new", changed.cast("long"))
    return running(
        flagged, [run], [seq], F.col(CHUNK), {"visit": ("sum", F.col("_new"))}, inclusive=True
    ).drop("_new", "_room", "_n")


def sessions(events: DataFrame, run: str, seq: str, ts: str, type_: str, end_type: str) -> DataFrame:
    """One row per run: first and last time, size, and whether it was ended or cut off."""
    ended = F.max(F.when(F.col(type_) == end_type, F.col(seq)))
    return events.groupBy(run).agg(
        F.min(ts).alias("opened_at"),
        F.max(ts).alias("last_at"),
        F.count("*").alias("events"),
        ended.alias("ended_seq"),
        F.max(seq).alias("last_seq"),
    ).withColumn(
        "end_reason", F.when(F.col("ended_seq").isNotNull(), "ended").otherwise("run_change")
    )


def liveness_gaps(
    events: DataFrame, run: str, ts: str, order: Sequence[str], max_seconds: float, chunk: Column
) -> DataFrame:
    """Silences longer than the limit, as (run, from, to, seconds)."""
    prior = running(events, [run], order, chunk, {"_before": ("prev", F.col(ts))})
    seconds = (F.unix_micros(ts) - F.unix_micros("_before")) / 1_000_000
    return prior.select(
        run, F.col("_before").alias("silent_from"), F.col(ts).alias("silent_to"), seconds.alias("seconds")
    ).where(F.col("seconds") > max_seconds)


def change_events(
    snapshots: DataFrame, key: Sequence[str], order: Sequence[str], columns: Sequence[str], chunk: Column
) -> DataFrame:
    """Snapshots whose fingerprint differs from the one before; the first always counts."""
    mark = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    marked = snapshots.withColumn("fingerprint", mark)
    prior = running(marked, key, order, chunk, {"_before": ("prev", F.col("fingerprint"))})
    return prior.where(~F.col("fingerprint").eqNullSafe(F.col("_before"))).drop("_before")


def inventory_gains(
    snapshots: DataFrame, key: Sequence[str], order: Sequence[str], counts: str, chunk: Column
) -> DataFrame:
    """Items whose count grew since the snapshot before; ``counts`` is a map id to count."""
    pairs = F.transform(
        F.array_sort(F.map_entries(counts)), lambda e: F.struct(e["key"].alias("item"), e["value"].alias("n"))
    )
    prior = running(snapshots.withColumn("_now", pairs), key, order, chunk, {"_then": ("prev", F.col("_now"))})
    exploded = prior.withColumn("_item", F.explode("_now"))
    before = F.filter("_then", lambda e: e["item"] == F.col("_item.item"))
    had = F.coalesce(F.get(before, F.lit(0))["n"], F.lit(0))
    added = F.col("_item.n") - had
    return exploded.withColumn("item", F.col("_item.item")).withColumn(
        "count_added", added
    ).withColumn("total_count", F.col("_item.n")).where("count_added > 0").drop("_now", "_then", "_item")


def death_edges(snapshots: DataFrame, key: Sequence[str], order: Sequence[str], dead: str, chunk: Column) -> DataFrame:
    """Snapshots where a player turned dead."""
    prior = running(snapshots, key, order, chunk, {"_before": ("prev", F.col(dead))})
    return prior.where(F.col(dead) & ~F.coalesce("_before", F.lit(False))).drop("_before")


def mark_stale(
    results: DataFrame, events: DataFrame, run: str, ts: str, seq: str, room: Sequence[str],
    chunk: Column, strict_seq: bool = False,
) -> DataFrame:
    """As-of check: is the state at completion still the state the request was made in?

    ``results``: result_id, run, ts (completion), and the token columns
    ``token_seq`` and ``token_<room column>``. A heartbeat may advance the
    sequence number; ``strict_seq`` (visual results) allows no accepted event.
    """
    state_columns = F.struct(F.col(seq).alias("seq"), *[F.col(c).alias(c) for c in room])
    token = [f"token_{c}" for c in ("seq", *room)]
    left = results.select(
        run, ts, F.lit(1).alias("_kind"), "result_id", *token,
        F.lit(None).cast(events.select(state_columns.alias("s")).schema["s"].dataType).alias("_state"),
        F.lit(None).cast("long").alias("_tie"),
    )
    right = events.select(
        run, ts, F.lit(0).alias("_kind"), F.lit(None).cast(results.schema["result_id"].dataType).alias("result_id"),
        *[F.lit(None).cast(results.schema[t].dataType).alias(t) for t in token],
        state_columns.alias("_state"), F.col(seq).cast("long").alias("_tie"),
    )
    both = left.unionByName(right)
    seen = running(
        both, [run], [ts, "_kind", "_tie", "result_id"], chunk, {"_now": ("last", F.col("_state"))}
    ).where("_kind = 1")
    same_room = F.lit(True)
    for c in room:
        same_room = same_room & F.col(f"_now.{c}").eqNullSafe(F.col(f"token_{c}"))
    seq_ok = (
        F.col("_now.seq") == F.col("token_seq") if strict_seq else F.col("_now.seq") >= F.col("token_seq")
    )
    current = F.col("_now").isNotNull() & seq_ok & same_room
    return seen.select(
        "result_id", run, ts, *token, F.col("_now.seq").alias("state_seq"),
        F.coalesce(current, F.lit(False)).alias("current"),
    )


def suppress_stale(marked: DataFrame) -> DataFrame:
    return marked.where("current")


def drop_paused(events: DataFrame, pauses: DataFrame, ts: str, bucket_seconds: int = 3600) -> DataFrame:
    """Drop events inside a pause [paused_at, resumed_at).

    Pauses are cut into time buckets, where those that cover a whole bucket are one row, and events meet them by
    bucket: nothing is ordered, and a busy bucket is an ordinary join key. A pause without an end, or
    one that ends in the future, ends with the events.
    """
    step = bucket_seconds * 1_000_000
    last = events.agg((F.unix_micros(F.max(ts)) + 1).alias("m")).select("m").scalar()
    start = F.unix_micros("paused_at")
    spans = pauses.withColumn("_last", last).select(
        start.alias("_from"), F.least(F.coalesce(F.unix_micros("resumed_at"), "_last"), "_last").alias("_to")
    ).where("_from < _to")
    buckets = F.sequence(F.floor(F.col("_from") / step), F.floor((F.col("_to") - 1) / step))
    clipped = spans.select("_from", "_to", F.explode(buckets).alias("_bucket")).select(
        "_bucket", F.greatest("_from", F.col("_bucket") * step).alias("_from"), F.least("_to", (F.col("_bucket") + 1) * step).alias("_to")
    ).distinct()
    at = F.unix_micros(F.col(ts))
    met = (F.floor(at / step) == F.col("_bucket")) & (at >= F.col("_from")) & (at < F.col("_to"))
    return events.join(clipped, met, "left_anti")


def advice_triggers(events: DataFrame, known: DataFrame) -> DataFrame:
    """Spawn events in an item room whose item is known; ``known`` has ``collectible_id``."""
    spawned = events.where(
        (F.col("type") == "collectible_spawned") & (F.col("context.room_type") == ITEM_ROOM_TYPE)
    ).withColumn("collectible_id", payload_int("collectible_id"))
    return spawned.where("collectible_id IS NOT NULL").join(known, "collectible_id", "left_semi")


def payload_int(name: str) -> Column:
    """Strict whole number out of the payload JSON."""
    return F.from_json("payload", f"{name} bigint")[name]


def recent_events(events: DataFrame, run: str, seq: str, type_: str, n: int) -> DataFrame:
    """Last ``n`` events of each run, newest first, as ``#seq  type``."""
    last = top_per(events, [run], [F.col(seq).desc()], n)
    label = F.concat(F.lit("#"), F.col(seq).cast("string"), F.lit("  "), F.col(type_))
    return last.groupBy(run).agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("rank", label.alias("t")))), lambda s: s["t"]), "\n"
        ).alias("recent")
    )


def dedupe_calls(calls: DataFrame, key: str = "call_id", order: str | None = None) -> DataFrame:
    """First call per id by ``order`` (of equal ones the smallest row hash); a repeated id is rejected."""
    row = F.struct(*[F.col(f"`{c}`") for c in calls.columns])
    place = F.struct(*([F.col(order)] if order else []), F.xxhash64(F.to_json(row)))
    return calls.groupBy(F.col(key).alias("_key")).agg(F.min_by(row, place).alias("_row")).select("_row.*")


def transcript_marks(transcripts: DataFrame, request: str, ts: str) -> DataFrame:
    """First partial and first final time per request, and the distinct finals in a row."""
    return transcripts.groupBy(request).agg(
        F.min(F.when(~F.col("final"), F.col(ts))).alias("first_partial_at"),
        F.min(F.when(F.col("final"), F.col(ts))).alias("first_final_at"),
    )


def new_finals(transcripts: DataFrame, request: str, order: Sequence[str], chunk: Column) -> DataFrame:
    """Final transcripts that differ from the final before; a repeat is ignored."""
    finals = transcripts.where("final")
    prior = running(finals, [request], order, chunk, {"_before": ("prev", F.col("text"))})
    return prior.where(~F.col("text").eqNullSafe(F.col("_before"))).drop("_before")


def assemble(deltas: DataFrame, current: DataFrame, max_chars: int = 1000, span: int = 100_000) -> DataFrame:
    """Response text from ordered deltas of the current generation, cut at ``max_chars``.

    Deltas that start behind the cut are removed before the text is collected,
    so at most ``max_chars`` pieces of one response meet in one place.
    """
    live = deltas.join(current, ["response_id", "generation"], "left_semi").where("length(delta) > 0")
    placed = running(
        live, ["response_id"], ["seq"], by_span("seq", span), {"_start": ("sum", F.length("delta"))}
    )
    kept = placed.where(F.coalesce("_start", F.lit(0)) < max_chars)
    parts = F.sort_array(F.collect_list(F.struct("seq", "delta")))
    text = F.array_join(F.transform(parts, lambda s: s["delta"]), "")
    return kept.groupBy("response_id").agg(F.substring(text, 1, max_chars).alias("text"))
