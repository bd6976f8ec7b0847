"""Game state per run from its accepted events: the batch twin of the stream fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.operators.events import ROOM_FIELDS, payload_int, visits
from loreloom.operators.scan import by_span, running, top_per
from loreloom.session import stage

# Event types by their effect on the state, and labels for display.
PLAYER_LIST_TYPES = ("run_started", "state_snapshot")
PLAYER_TYPES = ("player_state_changed", "inventory_changed")
SPAWNED, TAKEN = "collectible_spawned", "collectible_taken"
VERSION_ONLY = "bridge_ready"
SCENES = {2: "shop", 14: "devil-deal", 15: "angel-room"}
OTHER_SCENE = "unstructured-ui"
ROOM_NAMES = {
    0: "无房间类型", 1: "普通房", 2: "商店", 3: "错误房", 4: "道具房", 5: "Boss 房",
    6: "小 Boss 房", 7: "隐藏房", 8: "超级隐藏房", 9: "游戏厅", 10: "诅咒房（刺房）",
    11: "挑战房", 12: "图书馆", 13: "献祭房", 14: "恶魔房", 15: "天使房", 16: "地牢房",
    17: "Boss Rush 房", 18: "以撒的房间", 19: "荒废房间", 20: "宝箱房", 21: "骰子房",
    22: "黑市", 23: "贪婪模式出口", 24: "星象房", 25: "传送入口", 26: "传送出口",
    27: "隐藏出口房", 28: "蓝色房间", 29: "究极隐藏房", 30: "死斗房",
}
SUBJECT_PHRASES = (
    "这个道具", "这件道具", "这个物品", "这件物品", "眼前的道具", "当前房间的道具", "面前的道具",
)
# End of fixed values.


def run_heads(events: DataFrame) -> DataFrame:
    """Latest scalar state per run: sequence, frame, context, type and activity.

    A version event is the latest type like any other, but moves neither sequence nor room.
    """
    toggles = F.when(F.col("type").isin("run_started", "run_ended"), F.col("seq"))
    moves = F.when(F.col("type") != VERSION_ONLY, F.col("seq"))
    return events.groupBy("run_id").agg(
        F.coalesce(F.max(moves), F.lit(0)).alias("last_seq"),
        F.coalesce(F.max_by("game_frame", moves), F.lit(0)).alias("game_frame"),
        F.max_by("context", moves).alias("context"),
        F.max_by("type", "seq").alias("last_event_type"),
        F.coalesce(F.max_by(F.col("type") == "run_started", toggles), F.lit(False)).alias("active"),
    )


def player_fields(events: DataFrame) -> DataFrame:
    """Latest value of every player field: (run_id, controller, field, value JSON).

    A player record updates only the keys it carries, so the state of a player is
    the last value of each key.
    """
    many = F.from_json(F.get_json_object("payload", "$.players"), "array<string>")
    one = F.array(F.get_json_object("payload", "$.player"))
    records = F.when(F.col("type").isin(*PLAYER_LIST_TYPES), many).when(
        F.col("type").isin(*PLAYER_TYPES), one
    )
    rows = events.select("run_id", "seq", F.posexplode(records).alias("at", "player"))
    controller = F.from_json("player", "controller_index bigint")["controller_index"]
    rows = rows.where(controller.isNotNull()).select(
        "run_id", "seq", "at",
        controller.alias("controller"),
        F.explode(F.from_json("player", "map<string,string>")).alias("field", "value"),
    )
    return rows.groupBy("run_id", "controller", "field").agg(
        F.max_by("value", F.struct("seq", "at")).alias("value")
    )


def players(events: DataFrame) -> DataFrame:
    """One row per (run, controller) with a map of its fields; a player has few of them."""
    return player_fields(events).groupBy("run_id", "controller").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("player")
    )


def room_visits(events: DataFrame, span: int = 100_000) -> DataFrame:
    """Accepted events with their room visit; announcing a version is not part of any room."""
    stateful = events.where(F.col("type") != VERSION_ONLY).select(
        "run_id", "seq", "type", "payload", *[F.col(f"context.{c}").alias(c) for c in ROOM_FIELDS]
    )
    return visits(stateful, "run_id", "seq", ROOM_FIELDS, span)


def visit_items(visited: DataFrame, span: int = 100_000) -> DataFrame:
    """Items per visit: (run_id, visit, item_no, collectible_id, init_seed, taken).

    A spawn with a known ``init_seed`` updates that item in place. A take marks
    every item that carried its id at that moment: the first take of the id after
    a spawn counts when it comes before the item is spawned again.
    """
    staged = visited.where(F.col("type").isin(SPAWNED, TAKEN)).select(
        "run_id", "visit", "seq", (-F.col("seq")).alias("back"), (F.col("type") == TAKEN).alias("is_take"),
        payload_int("collectible_id").alias("collectible_id"), F.get_json_object("payload", "$.init_seed").alias("init_seed"),
    ).where(F.col("collectible_id").isNotNull() & (F.col("is_take") | (F.col("collectible_id") >= 1)))
    takes = running(
        staged, ["run_id", "visit", "collectible_id"], ["back"], by_span("back", span),
        {"next_take": ("last", F.when(F.col("is_take"), F.col("seq")))},
    )
    spawned = takes.where(~F.col("is_take")).withColumn(
        "item_key", F.coalesce("init_seed", F.concat(F.lit("seq "), F.col("seq").cast("string")))
    )
    versions = running(
        spawned, ["run_id", "visit", "item_key"], ["back"], by_span("back", span), {"until": ("prev", F.col("seq"))}
    )
    taken = F.col("next_take").isNotNull() & (F.col("until").isNull() | (F.col("next_take") < F.col("until")))
    return versions.groupBy("run_id", "visit", "item_key").agg(
        F.min("seq").alias("item_no"),
        F.max_by("collectible_id", "seq").alias("collectible_id"),
        F.max_by("init_seed", "seq").alias("init_seed"),
        F.max(taken).alias("taken"),
    ).drop("item_key")


def stage_events(events: DataFrame) -> DataFrame:
    """What the state needs of accepted events, written once: the running steps read them several times, and parsing costs most."""
    return stage(events.select("run_id", "seq", "type", "game_frame", "context", "payload"), "state-events")


def room_items(events: DataFrame, span: int = 100_000) -> DataFrame:
    """Items of every room visit."""
    return visit_items(stage(room_visits(stage_events(events), span), "visits"), span)


def current_items(events: DataFrame, span: int = 100_000) -> DataFrame:
    """Items of each run's latest visit only."""
    return _latest_items(stage_events(events), span)


def _latest_items(staged: DataFrame, span: int) -> DataFrame:
    visited = stage(room_visits(staged, span), "visits")
    last = visited.groupBy("run_id").agg(F.max("visit").alias("visit"))
    return visit_items(visited.join(last, ["run_id", "visit"], "left_semi"), span)


def bridge_versions(events: DataFrame) -> DataFrame:
    """Latest version announced per run; announcing touches nothing else."""
    version = F.get_json_object("payload", "$.bridge_version")
    return events.where(F.col("type") == VERSION_ONLY).groupBy("run_id").agg(
        F.max_by(version, "seq").alias("bridge_version")
    )


def rebuild_state(events: DataFrame, span: int = 100_000) -> DataFrame:
    """Head state per run with the number of open and taken items in the current room."""
    slim = stage_events(events)
    items = _latest_items(slim, span).groupBy("run_id").agg(
        F.count("*").alias("room_items"), F.count_if("taken").alias("taken_items")
    )
    return run_heads(slim).join(items, "run_id", "left").fillna(0, ["room_items", "taken_items"])


def latest_untaken(items: DataFrame) -> DataFrame:
    """Latest item of each run's room that is still there."""
    open_ = F.when(~F.col("taken") & (F.col("collectible_id") > 0), F.col("item_no"))
    return items.groupBy("run_id").agg(F.max_by("collectible_id", open_).alias("collectible_id")).where(
        "collectible_id IS NOT NULL"
    )


def scene_context(heads: DataFrame, items: DataFrame, limit: int = 8) -> DataFrame:
    """Scene label and the first ``limit`` untaken item ids of each run."""
    room_type = F.col("context.room_type")
    scene = F.lit(None).cast("string")
    for code, label in SCENES.items():
        scene = F.when(room_type == code, F.lit(label)).otherwise(scene)
    first = top_per(items.where(~F.col("taken")), ["run_id"], [F.col("item_no")], limit)
    known = first.groupBy("run_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "collectible_id"))), lambda s: s["collectible_id"]
        ).alias("known_collectible_ids")
    )
    return heads.join(known, "run_id", "left").select(
        "run_id",
        F.coalesce(scene, F.lit(OTHER_SCENE)).alias("scene"),
        F.col("last_seq").alias("state_seq"),
        room_type.alias("room_type"),
        F.coalesce("known_collectible_ids", F.array().cast("array<bigint>")).alias("known_collectible_ids"),
    )


def half_hearts(c: Column) -> Column:
    """Half-unit health as text: whole numbers without a fraction."""
    half = c / F.lit(2)
    return F.when(c.isNull(), "—").when(c % 2 == 0, half.cast("long").cast("string")).otherwise(
        half.cast("string")
    )


def room_label(room_type: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROOM_NAMES.items() for x in pair])
    known = F.try_element_at(names, room_type.cast("int"))
    other = F.when(room_type != 0, F.concat(F.lit("房间类型 "), room_type.cast("string")))
    return F.coalesce(known, other, F.lit("未知房间"))


def refers_to_room_item(question: Column, phrases=SUBJECT_PHRASES) -> Column:
    compact = F.regexp_replace(F.lower(question), r"(?U)\s+", "")
    verdict = F.lit(False)
    for phrase in phrases:
        verdict = verdict | F.contains(compact, F.lit(phrase))
    return verdict


def resolve_subject(questions: DataFrame, items: DataFrame) -> DataFrame:
    """Item a demonstrative question means: ``subject_id``, or an ``error`` when there is none."""
    latest = latest_untaken(items)
    asked = questions.withColumn("_points", refers_to_room_item(F.col("question")))
    joined = asked.join(latest, "run_id", "left")
    return joined.withColumn(
        "subject_id",
        F.when(
            F.col("_points") & F.col("collectible_id").isNotNull(),
            F.concat(F.lit("collectible:"), F.col("collectible_id").cast("string")),
        ),
    ).withColumn(
        "error", F.when(F.col("_points") & F.col("collectible_id").isNull(), F.lit("no item in the room"))
    ).drop("_points", "collectible_id")
