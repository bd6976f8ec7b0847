"""Structured Streaming forms of the event operators.

State is kept per run (or session) in the state store; a key's state is a few
fields, never its history. Ordering is by sequence number, as in the batch
forms, so no watermark is involved except where one bounds the state.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator, Mapping, Sequence
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loreloom.operators import cost as cost_rules
from loreloom.operators.events import ROOM_FIELDS
from loreloom.operators.state import PLAYER_LIST_TYPES, PLAYER_TYPES, SPAWNED, TAKEN, VERSION_ONLY
from loreloom.session import shared_folder

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(STATE_STORE, ROCKSDB)


def _in_order(frames: Iterator[pd.DataFrame], order: Sequence[str]) -> pd.DataFrame:
    parts = list(frames)
    rows = pd.concat(parts) if len(parts) > 1 else parts[0]
    return rows.sort_values(list(order), kind="stable")


class _SeqGuard(StatefulProcessor):
    """Highest accepted sequence number per run."""

    def __init__(self, order: Sequence[str], seq: str) -> None:
        self.order, self.seq = order, seq

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.top = handle.getValueState("top", "seq bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _in_order(rows, self.order)
        stored = self.top.get()
        start = stored[0] if stored else 0
        seq = frame[self.seq].astype("int64")
        before = seq.cummax().shift(fill_value=0).clip(lower=start)
        accepted = seq > before
        gap = (seq - before - 1).where(accepted & (before > 0), 0)
        self.top.update((int(max(start, seq.max())),))
        yield frame.assign(accepted=accepted.to_numpy(), gap=gap.to_numpy())

    def close(self) -> None:
        pass


def order_guard(events: DataFrame, run: str, seq: str, order: Sequence[str]) -> DataFrame:
    """Add ``accepted`` and ``gap``; rows of one micro-batch are taken in ``order``."""
    use_rocksdb(events.sparkSession)
    schema = T.StructType(
        events.schema.fields + [T.StructField("accepted", T.BooleanType()), T.StructField("gap", T.LongType())]
    )
    return events.groupBy(run).transformWithStateInPandas(
        statefulProcessor=_SeqGuard(order, seq), outputStructType=schema, outputMode="Append", timeMode="None"
    )


def _new_run() -> dict:
    return {"active": False, "last_seq": 0, "frame": 0, "context": {}, "players": {}, "items": [], "type": None, "version": None}


def fold_event(state: dict, event: dict) -> None:
    """Apply one accepted event to a run's state."""
    kind, payload = event["type"], event["payload"]
    state["type"] = kind
    if kind == VERSION_ONLY:
        version = payload.get("bridge_version")
        state["version"] = version if isinstance(version, str) else state["version"]
        return
    context = event["context"]
    if any(context.get(f) != state["context"].get(f) for f in ROOM_FIELDS):
        state["items"] = []
    state.update(last_seq=event["seq"], frame=event["game_frame"], context=context)
    if kind in ("run_started", "run_ended"):
        state["active"] = kind == "run_started"
    records = payload.get("players") if kind in PLAYER_LIST_TYPES else [payload.get("player")]
    if kind in (*PLAYER_LIST_TYPES, *PLAYER_TYPES) and isinstance(records, list):
        for record in records:
            number = record.get("controller_index") if isinstance(record, dict) else None
            if type(number) is int:
                state["players"].setdefault(str(number), {}).update(record)
    item = payload.get("collectible_id")
    if kind == SPAWNED and type(item) is int and item > 0:
        seed = payload.get("init_seed")
        same = [i for i in state["items"] if seed is not None and i.get("init_seed") == seed]
        if same:
            same[0].update(payload)
        else:
            state["items"].append({**payload, "taken": False, "item_no": event["seq"]})
    elif kind == TAKEN:
        for held in state["items"]:
            held["taken"] = held["taken"] or held.get("collectible_id") == item


STATE_SCHEMA = (
    "run_id string, last_seq bigint, game_frame bigint, room_index bigint, active boolean, last_event_type string, "
    "room_items bigint, taken_items bigint, state string"
)


class _StateFold(StatefulProcessor):
    """Game state of a run, with the sequence check in front: one row of plain fields, a map of player fields and a map of the
    room's items. A micro-batch reads and writes the fields it touches; a run's players and past rooms are not copied about."""

    HEAD = "top bigint, seq bigint, frame bigint, context string, active boolean, type string, version string"

    def __init__(self, order: Sequence[str]) -> None:
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", self.HEAD)
        self.players = handle.getMapState("players", "controller string, field string", "value string")
        self.items = handle.getMapState("items", "item_no bigint", "taken boolean, body string")

    def _load(self) -> tuple[int, dict]:
        state, top = _new_run(), 0
        if self.head.exists():
            top, state["last_seq"], state["frame"], context, state["active"], state["type"], state["version"] = self.head.get()
            state["context"] = json.loads(context)
        for (controller, field), (value,) in self.players.iterator() if self.players.exists() else ():
            state["players"].setdefault(controller, {})[field] = json.loads(value)
        held = sorted((key[0], value) for key, value in self.items.iterator()) if self.items.exists() else []
        state["items"] = [{**json.loads(body), "taken": taken, "item_no": number} for number, (taken, body) in held]
        return top, state

    def _save(self, top: int, state: dict, before: dict) -> None:
        dump = lambda value: json.dumps(value, ensure_ascii=False, sort_keys=True)
        self.head.update((top, state["last_seq"], state["frame"], dump(state["context"]), state["active"], state["type"], state["version"]))
        for controller, fields in state["players"].items():
            known = before["players"].get(controller, {})
            for field, value in fields.items():
                if field not in known or known[field] != value:
                    self.players.updateValue((controller, field), (dump(value),))
        split = lambda items: {i["item_no"]: (i["taken"], dump({k: v for k, v in i.items() if k not in ("taken", "item_no")})) for i in items}
        old, new = split(before["items"]), split(state["items"])
        for number in old.keys() - new.keys():
            self.items.removeKey((number,))
        for number, value in new.items():
            if old.get(number) != value:
                self.items.updateValue((number,), value)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        top, state = self._load()
        before = {"players": {c: dict(f) for c, f in state["players"].items()}, "items": [dict(i) for i in state["items"]]}
        for row in _in_order(rows, self.order).to_dict("records"):
            if row["seq"] <= top:
                continue
            top = int(row["seq"])
            context = json.loads(row["context_json"])
            fold_event(state, {**row, "seq": top, "game_frame": int(row["game_frame"]), "context": context,
                               "payload": json.loads(row["payload"])})
        self._save(top, state, before)
        yield pd.DataFrame(
            {
                "run_id": [key[0]], "last_seq": [state["last_seq"]], "game_frame": [state["frame"]],
                "room_index": pd.array([state["context"].get("room_index")], dtype="Int64"),
                "active": [state["active"]], "last_event_type": [state["type"]],
                "room_items": [len(state["items"])], "taken_items": [sum(i["taken"] for i in state["items"])],
                "state": [json.dumps(state, ensure_ascii=False, sort_keys=True)],
            }
        )

    def close(self) -> None:
        pass


def state_stream(events: DataFrame, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Latest state per run after every micro-batch, from valid parsed events."""
    use_rocksdb(events.sparkSession)
    slim = events.select(
        "run_id", "seq", "type", "game_frame", F.to_json("context").alias("context_json"), "payload",
        *[c for c in order if c not in ("seq", "run_id", "type", "game_frame")],
    )
    return slim.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=_StateFold(order), outputStructType=STATE_SCHEMA, outputMode="Update", timeMode="None"
    )


class _CostSum(StatefulProcessor):
    """Money spent per session so far."""

    def __init__(self, order: Sequence[str], soft: float, hard: float) -> None:
        self.order = order
        self.hard = Decimal(str(hard))
        self.warn = min(Decimal(str(soft)), self.hard * Decimal(str(cost_rules.HARD_BUDGET_WARNING)))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "total " + cost_rules.MONEY)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _in_order(rows, self.order)
        stored = self.total.get()
        spent, running = (stored[0] if stored else Decimal(0)), []
        for cost in frame["cost"]:
            spent += cost
            running.append(spent)
        self.total.update((spent,))
        yield frame.assign(
            session_cost=running, warning=[t >= self.warn for t in running], exhausted=[t >= self.hard for t in running]
        )

    def close(self) -> None:
        pass


def cost_stream(
    usage: DataFrame, session: str, order: Sequence[str], prices: Mapping[str, float], soft: float, hard: float
) -> DataFrame:
    """Running session cost with warning and exhausted flags."""
    use_rocksdb(usage.sparkSession)
    priced = usage.withColumn("cost", cost_rules.four_way_cost(prices))
    schema = T.StructType(
        priced.schema.fields
        + [T.StructField("session_cost", T.DecimalType(28, 9)), T.StructField("warning", T.BooleanType()),
           T.StructField("exhausted", T.BooleanType())]
    )
    return priced.groupBy(session).transformWithStateInPandas(
        statefulProcessor=_CostSum(order, soft, hard), outputStructType=schema, outputMode="Append", timeMode="None"
    )


class _Liveness(StatefulProcessor):
    """Report a run once when no event came for the limit; a new event re-arms it."""

    def __init__(self, max_ms: int) -> None:
        self.max_ms = max_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        count = sum(len(frame) for frame in rows)
        armed = self.timer.get()
        if armed:
            self.handle.deleteTimer(armed[0])
        due = timerValues.getCurrentProcessingTimeInMs() + self.max_ms
        self.handle.registerTimer(due)
        self.timer.update((due,))
        yield pd.DataFrame({"run_id": [str(key[0])], "status": ["live"], "events": [count]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        yield pd.DataFrame({"run_id": [str(key[0])], "status": ["waiting"], "events": [0]})

    def close(self) -> None:
        pass


def liveness_stream(events: DataFrame, run: str, max_seconds: float = 3.0) -> DataFrame:
    use_rocksdb(events.sparkSession)
    return events.groupBy(run).transformWithStateInPandas(
        statefulProcessor=_Liveness(int(max_seconds * 1000)),
        outputStructType="run_id string, status string, events bigint", outputMode="Update", timeMode="ProcessingTime",
    )


class _StaleFilter(StatefulProcessor):
    """Latest room and sequence of a run; a result passes only while they match its token."""

    def __init__(self, order: Sequence[str], room: Sequence[str], strict_seq: bool) -> None:
        self.order, self.room, self.strict = order, room, strict_seq

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "seq bigint, room string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stored = self.now.get()
        seq, room = stored if stored else (None, None)
        passed = []
        for row in _in_order(rows, self.order).to_dict("records"):
            place = json.dumps([None if pd.isna(row[c]) else row[c] for c in self.room], default=str)
            if not row["is_result"]:
                seq, room = int(row["seq"]), place
            elif seq is not None and place == room:
                token = int(row["seq"])
                if seq == token or (seq > token and not self.strict):
                    passed.append(row["result_id"])
        if seq is not None:
            self.now.update((seq, room))
        if passed:
            yield pd.DataFrame({"result_id": passed, "state_seq": seq})

    def close(self) -> None:
        pass


def suppress_stale_stream(
    mixed: DataFrame, run: str, order: Sequence[str], room: Sequence[str], strict_seq: bool = False
) -> DataFrame:
    """Results that are still current. ``mixed``: events and results in one stream,
    told apart by ``is_result``; a result carries its token in the same columns."""
    use_rocksdb(mixed.sparkSession)
    schema = T.StructType([mixed.schema["result_id"], T.StructField("state_seq", T.LongType())])
    return mixed.groupBy(run).transformWithStateInPandas(
        statefulProcessor=_StaleFilter(order, room, strict_seq), outputStructType=schema, outputMode="Append", timeMode="None"
    )


class _ChangeFilter(StatefulProcessor):
    """Last fingerprint per key."""

    def __init__(self, order: Sequence[str]) -> None:
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "mark string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _in_order(rows, self.order)
        stored = self.last.get()
        before = frame["fingerprint"].shift()
        before.iloc[0] = stored[0] if stored else None
        self.last.update((frame["fingerprint"].iloc[-1],))
        yield frame[frame["fingerprint"] != before]

    def close(self) -> None:
        pass


def change_stream(snapshots: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    use_rocksdb(snapshots.sparkSession)
    mark = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    marked = snapshots.withColumn("fingerprint", mark)
    return marked.groupBy(key).transformWithStateInPandas(
        statefulProcessor=_ChangeFilter(order), outputStructType=marked.schema, outputMode="Append", timeMode="None"
    )


def advice_stream(accepted: DataFrame, known: DataFrame) -> DataFrame:
    """Trigger events whose item is known: a stream-static semi join."""
    from loreloom.operators.events import advice_triggers

    return advice_triggers(accepted, known)


def drop_paused_stream(events: DataFrame, pauses: DataFrame, ts: str, bucket_seconds: int = 3600, coarse: int = 1024) -> DataFrame:
    """Drop streamed events inside a pause [paused_at, resumed_at) of the static control table.

    A pause is cut into time buckets; where it covers ``coarse`` of them in a row, one coarse row stands for all, so a pause
    of years is no more rows than one of weeks. A pause without an end is no interval: from the first one on, everything is dropped.
    """
    step, wide = bucket_seconds * 1_000_000, bucket_seconds * coarse * 1_000_000
    start, end = F.unix_micros("paused_at"), F.unix_micros("resumed_at")
    closed = pauses.where("paused_at IS NOT NULL AND resumed_at IS NOT NULL").select(start.alias("_from"), end.alias("_to")).where("_from < _to")
    # whole coarse buckets inside the pause, and the fine ones before and after them
    first, last = F.ceil(F.col("_from") / wide), F.floor(F.col("_to") / wide)
    split = closed.withColumns({"_first": first, "_last": F.greatest(first, last)})
    whole = split.where("_first < _last").select(F.explode(F.sequence("_first", F.col("_last") - 1)).alias("_wide")).distinct()
    inner = F.col("_first") < F.col("_last")
    edges = split.select(F.explode(F.when(inner, F.array(
        F.struct(F.col("_from").alias("_from"), (F.col("_first") * wide).alias("_to")), F.struct((F.col("_last") * wide).alias("_from"), F.col("_to").alias("_to"))
    )).otherwise(F.array(F.struct("_from", "_to")))).alias("e")).select("e.*").where("_from < _to")
    fine = edges.select("_from", "_to", F.explode(F.sequence(F.floor(F.col("_from") / step), F.floor((F.col("_to") - 1) / step))).alias("_fine"))
    since = pauses.where("paused_at IS NOT NULL AND resumed_at IS NULL").agg(F.min(start).alias("_since"))
    at = F.unix_micros(F.col(ts))
    kept = events.join(F.broadcast(since), at >= F.col("_since"), "left_anti")  # one row
    kept = kept.join(whole, F.floor(at / wide) == F.col("_wide"), "left_anti")
    return kept.join(fine, (F.floor(at / step) == F.col("_fine")) & (at >= F.col("_from")) & (at < F.col("_to")), "left_anti")


def dedupe_calls_stream(calls: DataFrame, ts: str, delay: str = "1 hour", key: str = "call_id") -> DataFrame:
    """First call per id. The watermark only bounds how long ids are remembered."""
    return calls.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def record(stream: DataFrame, out: str, checkpoint: str, **trigger):
    """Append accepted events as JSON lines."""
    writer = stream.writeStream.format("json").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start(out)


def stream_folder(spark: SparkSession, label: str) -> str:
    """A new folder in shared storage for a stream's rows and progress."""
    return os.path.join(shared_folder(spark), "loreloom", f"{label}-{uuid.uuid4().hex}")


def run_to_table(stream: DataFrame, label: str, root: str | None = None) -> DataFrame:
    """Process everything available now into a table in the shared folder and read it back.

    With the ``root`` of an earlier run, the query goes on from that run's checkpoint and adds its batches.
    """
    spark = stream.sparkSession
    root = root or stream_folder(spark, label)

    def write(batch: DataFrame, number: int) -> None:
        # The batch number names the folder, so a replayed batch replaces itself.
        batch.write.mode("overwrite").parquet(os.path.join(root, "rows", f"batch={number}"))

    query = stream.writeStream.foreachBatch(write).outputMode("update").option(
        "checkpointLocation", os.path.join(root, "progress")
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(T.StructType(stream.schema.fields + [T.StructField("batch", T.LongType())])).parquet(
        os.path.join(root, "rows")
    )
