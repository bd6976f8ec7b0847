"""Session life cycle, throttling, admission and rotation as keyed streams.

Each keeps a few fields per key as typed state and carries the open chain from one micro-batch to the next; results equal the batch
forms, however the events are cut into micro-batches. Where a key's state cannot matter any more it is given up: at the end of a run,
and by an event-time timer once the watermark has passed the point after which a fresh start gives the same result.

A micro-batch's rows of one key are ordered in the handler; the trigger's size limits (``maxFilesPerTrigger``,
``maxBytesPerTrigger``) bound them. Loops run over sessions and emissions, not over rows. Sessions and admission can handle a bucket of
keys at a time, so that Python is called a bounded number of times a micro-batch; a bucket's state is read and written whole.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loreloom.streaming.events import _in_order, use_rocksdb

MICROS = 1_000_000
BLOCK = 1_000  # turns looked at in one go


def _micros(ts: pd.Series) -> np.ndarray:
    return ts.astype("datetime64[us]").astype("int64").to_numpy()


class _Timer:
    """The one event-time timer of a key, remembered so that it can be moved."""

    def __init__(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.due = handle, handle.getValueState("due", "at bigint")

    def move(self, at_ms: int) -> None:
        self.drop()
        self.handle.registerTimer(at_ms)
        self.due.update((at_ms,))

    def drop(self) -> None:
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()


class _Kept:
    """The states of a bucket's keys, as one Arrow table in one value: a call of Python for each key would cost more than the work on it."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, fields: dict[str, pa.DataType]) -> None:
        self.schema = pa.schema(list(fields.items()))
        self.value = handle.getValueState(name, "kept binary")

    def get(self) -> pa.Table:
        held = self.value.get() if self.value.exists() else None
        return pa.ipc.open_stream(held[0]).read_all() if held else self.schema.empty_table()

    def put(self, table: pa.Table) -> None:
        if not len(table):
            self.value.clear()
            return
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.schema) as writer:
            writer.write_table(table)
        self.value.update((sink.getvalue().to_pybytes(),))

    def numbered(self, held: pa.Table, keys: pd.Series) -> tuple[np.ndarray, pa.Array]:
        """Numbers of the keys, and the keys by number; those held come first, in their order."""
        kind = self.schema.field(0).type
        both = pa.concat_arrays([held.column(0).combine_chunks(), pa.array(keys, kind, from_pandas=True)]).dictionary_encode(null_encoding="encode")
        return both.indices.to_numpy()[len(held) :], both.dictionary


def _grouped(rows: DataFrame, key: str, buckets: int | None) -> GroupedData:
    """Rows by the bucket of their key's hash, or by the key itself."""
    if buckets is None:
        return rows.groupBy(key)
    return rows.withColumn("state_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).groupBy("state_bucket")


def _kind(events: DataFrame, key: str) -> pa.DataType:
    return to_arrow_type(events.schema[key].dataType)


class _Sessions(StatefulProcessor):
    """The open sessions of a bucket of runs: (run, opened, last, events)."""

    def __init__(self, run: str, kind: pa.DataType, order: Sequence[str], ts: str, type_: str, end_type: str, idle_us: int) -> None:
        self.run, self.kind, self.order, self.ts, self.type, self.end_type, self.idle_us = run, kind, order, ts, type_, end_type, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = _Kept(handle, "open", {"run": self.kind} | dict.fromkeys(("opened", "last", "events"), pa.int64()))
        self.timer = _Timer(handle)

    def _rows(self, closed: pa.Table, reason) -> Iterator[pd.DataFrame]:
        if len(closed):
            out = closed.to_pandas()
            out.columns = [self.run, "opened_us", "last_us", "events"]
            yield out.assign(end_reason=reason)

    def _keep(self, held: pa.Table) -> None:
        self.open.put(held)
        if len(held):
            self.timer.move((int(held.column("last").to_numpy().min()) + self.idle_us) // 1000 + 1)
        else:
            self.timer.drop()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame, held = pd.concat(list(rows)), self.open.get()
        number, keys = self.open.numbered(held, frame[self.run])
        frame = frame.assign(_number=number).sort_values(["_number", *self.order], kind="stable")
        at = _micros(frame[self.ts])
        # an open session is a row before the others of its run
        number = np.concatenate([np.arange(len(held)), frame["_number"].to_numpy()])
        by = np.argsort(number, kind="stable")
        opened, last, size = (held.column(c).to_numpy() for c in ("opened", "last", "events"))
        ends = np.concatenate([np.zeros(len(held), dtype=bool), (frame[self.type] == self.end_type).to_numpy()])[by]
        opened, last = np.concatenate([opened, at])[by], np.concatenate([last, at])[by]
        size, number = np.concatenate([size, np.ones(len(at), dtype=np.int64)])[by], number[by]
        fresh = np.concatenate([[True], number[1:] != number[:-1]])
        start = np.flatnonzero(fresh | np.concatenate([[False], ends[:-1] | (last[1:] - last[:-1] > self.idle_us)]))
        final = np.append(start[1:], len(number)) - 1
        of_run = np.append(fresh, True)[final + 1]
        table = pa.table([keys.take(pa.array(number[start])), *(pa.array(v) for v in (opened[start], last[final], np.add.reduceat(size, start)))], schema=self.open.schema)
        stays = of_run & ~ends[final]
        self._keep(table.filter(pa.array(stays)))
        yield from self._rows(table.filter(pa.array(~stays)), np.where(ends[final], "ended", "idle")[~stays])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        held = self.open.get()
        gone = (held.column("last").to_numpy() + self.idle_us) // 1000 + 1 <= now
        self.timer.due.clear()
        self._keep(held.filter(pa.array(~gone)))
        yield from self._rows(held.filter(pa.array(gone)), "idle")

    def close(self) -> None:
        pass


def sessions_stream(
    events: DataFrame, run: str, order: Sequence[str], ts: str, type_: str, end_type: str, idle_seconds: int, delay: str = "0 seconds",
    buckets: int | None = None,
) -> DataFrame:
    """(run, opened_us, last_us, events, end_reason) of every session, when it closes: at an end event, or after ``idle_seconds``
    without one. The watermark closes a session for which nothing comes any more, and its state goes with it. ``buckets`` handles and
    keeps many runs at a time, by their hash."""
    use_rocksdb(events.sparkSession)
    slim = events.select(*dict.fromkeys([run, ts, type_, *order])).withWatermark(ts, delay)
    schema = T.StructType([events.schema[run]] + [T.StructField(c, T.LongType()) for c in ("opened_us", "last_us", "events")] + [
        T.StructField("end_reason", T.StringType())
    ])
    return _grouped(slim, run, buckets).transformWithStateInPandas(
        statefulProcessor=_Sessions(run, _kind(events, run), order, ts, type_, end_type, idle_seconds * MICROS), outputStructType=schema,
        outputMode="Append", timeMode="EventTime",
    )


def sessions_by_idle(events: DataFrame, run: str, order: Sequence[str], ts: str, type_: str, end_type: str, idle_seconds: int, chunk) -> DataFrame:
    """The same sessions over a whole table; the last one of a run that did not end counts as idle."""
    from loreloom.operators.scan import running

    at = F.unix_micros(ts)
    before = {"_at": ("prev", at), "_type": ("prev", F.col(type_))}
    seen = running(events, [run], order, chunk, before, keep_chunk=True)
    opens = F.col("_at").isNull() | (F.col("_type") == end_type) | (at - F.col("_at") > idle_seconds * MICROS)
    flagged = seen.withColumn("_opens", F.coalesce(opens, F.lit(False)).cast("long"))
    numbered = running(flagged, [run], order, chunk, {"_session": ("sum", F.col("_opens"))}, inclusive=True)
    ended = F.max((F.col(type_) == end_type).cast("int")) == 1
    return numbered.groupBy(run, "_session").agg(
        F.min(at).alias("opened_us"), F.max(at).alias("last_us"), F.count(F.lit(1)).alias("events"),
        F.when(ended, "ended").otherwise("idle").alias("end_reason"),
    ).drop("_session")


class _Throttle(StatefulProcessor):
    """The last emitted frame of a key; none once the gap has passed for good."""

    def __init__(self, frame: str, gap: int, frame_ms: int) -> None:
        self.frame, self.gap, self.frame_ms = frame, gap, frame_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "frame bigint")
        self.timer = _Timer(handle) if self.frame_ms else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [part[[*part.columns]] for part in rows]
        frame = pd.concat(parts).drop_duplicates(self.frame).sort_values(self.frame)
        f = frame[self.frame].astype("int64").to_numpy()
        at = int(np.searchsorted(f, self.last.get()[0] + self.gap)) if self.last.exists() else 0
        chosen = []
        while at < len(f):
            chosen.append(at)
            at = int(np.searchsorted(f, f[at] + self.gap))
        if chosen:
            last = int(f[chosen[-1]])
            self.last.update((last,))
            if self.timer:
                self.timer.move((last + self.gap) * self.frame_ms)
            yield frame.iloc[chosen]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        self.timer.due.clear()
        return iter(())

    def close(self) -> None:
        pass


def throttle_stream(
    events: DataFrame, key: str, frame: str, gap: int, ts: str | None = None, frame_seconds: int = 0, delay: str = "0 seconds"
) -> DataFrame:
    """(key, frame) of the emitted frames: the first, then each at least ``gap`` after the last emitted.

    Frames may come late only within a micro-batch. If frames follow event time (``frame`` is ``ts`` in steps of
    ``frame_seconds``), a key's state is given up when the watermark is a gap past its last emission: the next frame is emitted anyway.
    """
    use_rocksdb(events.sparkSession)
    schema = T.StructType([events.schema[key], T.StructField(frame, T.LongType())])
    slim = events.select(key, F.col(frame).cast("long").alias(frame), *([ts] if ts else []))
    if ts:
        slim = slim.withWatermark(ts, delay)
        schema.add(events.schema[ts])
    out = slim.groupBy(key).transformWithStateInPandas(
        statefulProcessor=_Throttle(frame, gap, frame_seconds * 1000 if ts else 0), outputStructType=schema, outputMode="Append",
        timeMode="EventTime" if ts else "None",
    )
    return out.select(key, frame)


class _Admission(StatefulProcessor):
    """Last accepted time, number and cost of what each key of a bucket was granted."""

    def __init__(self, columns: list[str], key: str, kind: pa.DataType, at: str, cost: str, gap: int, most: int, budget: float) -> None:
        self.columns, self.key, self.kind, self.at, self.cost = columns, key, kind, at, cost
        self.gap, self.most, self.budget = gap, most, budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.granted = _Kept(handle, "granted", {"key": self.kind, "last": pa.int64(), "n": pa.int64(), "spent": pa.decimal128(38, 9)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame, held = pd.concat(list(rows)), self.granted.get()
        number, keys = self.granted.numbered(held, frame[self.key])
        granted = dict(enumerate(zip(*(held.column(c).to_pylist() for c in ("last", "n", "spent")))))
        full = [k for k, (_, n, spent) in granted.items() if n >= self.most or spent >= self.budget]
        frame = frame.assign(_number=number)[~np.isin(number, full)].sort_values(["_number", self.at], kind="stable")
        number, at, cost = frame["_number"].to_numpy(), frame[self.at].astype("int64").to_list(), frame[self.cost].to_list()
        edges = [*np.flatnonzero(np.diff(number, prepend=-1)).tolist(), len(at)]
        chosen: list[int] = []
        for i, end in zip(edges[:-1], edges[1:]):
            own = int(number[i])
            last, n, spent = granted.get(own, (None, 0, Decimal(0)))
            i = bisect_left(at, last + self.gap, i, end) if n else i
            while i < end and n < self.most and spent < self.budget:
                chosen.append(i)
                last, n, spent = at[i], n + 1, spent + (cost[i] or 0)
                i = bisect_left(at, last + self.gap, i, end)
            if n:
                granted[own] = (last, n, spent)
        if chosen:
            columns = [pa.array(v, t) for v, t in zip(zip(*granted.values()), self.granted.schema.types[1:])]
            self.granted.put(pa.table([keys.take(pa.array(list(granted), pa.int64())), *columns], schema=self.granted.schema))
            yield frame.iloc[chosen][self.columns]

    def close(self) -> None:
        pass


def admission_stream(
    requests: DataFrame, key: str, at: str, cost: str, min_gap: int, max_accepted: int, budget: float, buckets: int | None = None
) -> DataFrame:
    """The accepted requests: far enough from the last accepted, below the count, budget left. ``cost`` is a decimal. ``buckets``
    handles and keeps many keys at a time, by their hash."""
    use_rocksdb(requests.sparkSession)
    return _grouped(requests, key, buckets).transformWithStateInPandas(
        statefulProcessor=_Admission(requests.columns, key, _kind(requests, key), at, cost, min_gap, max_accepted, budget),
        outputStructType=requests.schema, outputMode="Append", timeMode="None",
    )


class _Rotation(StatefulProcessor):
    """The open session of a key: its number, start, turns and audio, and the latest time seen."""

    def __init__(self, order: str, seconds: str, audio: str, max_seconds: float, max_turns: int, max_audio: float) -> None:
        self.order, self.seconds, self.audio = order, seconds, audio
        self.limits = max_seconds, max_turns, max_audio

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "no bigint, start double, turns bigint, audio double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _in_order(rows, [self.order])
        no, start, turns, audio = self.open.get() if self.open.exists() else (0, 0.0, 0, 0.0)
        s, a = (frame[c].astype("float64").to_numpy() for c in (self.seconds, self.audio))
        max_seconds, max_turns, max_audio = self.limits
        number, i = np.empty(len(s), dtype="int64"), 0
        while i < len(s):
            if not no or s[i] - start >= max_seconds or turns >= max_turns or audio >= max_audio:
                no, start, turns, audio = no + 1, float(s[i]), 0, 0.0
            # the first turn that finds the session used up; audio is added turn by turn, so that the cut into micro-batches does not matter
            until = min(i + max(max_turns - turns, 1), i + BLOCK, len(s))
            heard = np.cumsum(np.append(audio, a[i:until]))
            full = np.flatnonzero((s[i + 1 : until] - start >= max_seconds) | (heard[1:-1] >= max_audio))
            until = i + 1 + int(full[0]) if len(full) else until
            number[i:until] = no
            turns, audio, i = turns + until - i, float(heard[until - i]), until
        self.open.update((int(no), start, int(turns), audio))
        yield frame.assign(session_no=number)

    def close(self) -> None:
        pass


def rotation_stream(
    turns: DataFrame, key: str, order: str, seconds: str, audio: str, max_seconds: float, max_turns: int, max_audio: float
) -> DataFrame:
    """Add ``session_no``: a turn opens a new session when the open one is too old, has its turns, or has its audio."""
    use_rocksdb(turns.sparkSession)
    schema = T.StructType([*turns.schema.fields, T.StructField("session_no", T.LongType())])
    return turns.groupBy(key).transformWithStateInPandas(
        statefulProcessor=_Rotation(order, seconds, audio, max_seconds, max_turns, max_audio), outputStructType=schema, outputMode="Append",
        timeMode="None",
    )
