"""Greedy chains along an ordered group: throttle, admission and session rotation.

Each step depends on the last accepted row, so a window cannot express it. Groups
of at most ``span`` rows are walked whole, all groups of a batch in step: first
the first row of each, then the second. The order of larger groups is cut into
chunks. A chunk can only be entered through one of its first rows; pass one works
out, for each such entry, the state in which the chunk is left. The short list of
chunk summaries is then walked per group, and pass two marks the rows of each
chunk from its known entry. No task ever holds more than one chunk, one group's
summaries or a batch of small groups.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreloom.operators.scan import by_span, running
from loreloom.session import python_groups, stage

CHUNK = "_chunk"


def _schema(df: DataFrame, keys: Sequence[str], *extra: T.StructField) -> T.StructType:
    return T.StructType([df.schema[k] for k in keys] + list(extra))


def _by_size(rows: DataFrame, keys: Sequence[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the keys with at most ``most`` rows, and those of the larger ones; None if there are none."""
    larger = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > most)
    larger = stage(larger.select(*[F.col(k).alias(f"_large_{k}") for k in keys]), "large-keys")
    if larger.isEmpty():
        return rows, None
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_large_{k}")) for k in keys])
    return rows.join(larger, same, "left_anti"), rows.join(larger, same, "left_semi")


def _new_key(rows: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """True where a row has another key than the row before."""
    new = np.zeros(rows.num_rows, dtype=bool)
    new[:1] = True
    for k in keys:
        column = rows[k].combine_chunks()
        here, before = column.slice(1), column.slice(0, max(len(column) - 1, 0))
        differ = pc.coalesce(pc.not_equal(here, before), pc.xor(pc.is_null(here), pc.is_null(before)))
        new[1:] |= differ.to_numpy(zero_copy_only=False)
    return new


def _whole_keys(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Batches of a partition sorted by key, cut anew so that no key's rows are split."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        tail = [held[-1].slice(held[-1].num_rows - 1)] if held else []
        cut = int(np.flatnonzero(_new_key(pa.Table.from_batches([*tail, batch]), keys))[-1]) - len(tail)
        if cut < 0:
            held.append(batch)
            continue
        done = pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
        if done.num_rows:
            yield done
    if held:
        yield pa.Table.from_batches(held)


def _in_step(new: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers of every key's first row, then of every second row, and so on; a key keeps its place in the list."""
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(new)))
    order = np.argsort(-sizes, kind="stable")
    first, below = first[order], -sizes[order]
    for k in range(int(-below[0]) if len(below) else 0):
        yield first[: np.searchsorted(below, -k)] + k


def _apart(rows: DataFrame, keys: Sequence[str], at: str, gap: int, most: int | None = None) -> DataFrame:
    """Rows of each key that are at least ``gap`` after the last one taken, the first ``most`` of them."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_keys(batches, keys):
            times, new = table[at].to_numpy(), _new_key(table, keys)
            taken = np.zeros(len(times), dtype=bool)
            last, count = np.zeros(int(new.sum()), dtype="int64"), np.zeros(int(new.sum()), dtype="int64")
            for here in _in_step(new):
                m, t = len(here), times[here]
                go = (count[:m] == 0) | ((t >= last[:m] + gap) & (t != last[:m]))
                if most is not None:
                    go &= count[:m] < most
                taken[here] = go
                last[:m][go] = t[go]
                count[:m] += go
            yield from table.filter(pa.array(taken)).to_batches()

    return python_groups(rows, *keys).sortWithinPartitions(*keys, at).mapInArrow(take, rows.schema)


def throttle(df: DataFrame, keys: Sequence[str], frame: str, gap: int, span: int = 100_000) -> DataFrame:
    """Frames that are emitted: the first, then each at least ``gap`` after the last emitted.

    Returns the distinct emitted (keys, frame). ``span`` is the chunk width in
    frames, and the size from which on a group is cut; it must not be below ``gap``.
    """
    keys = list(keys)
    if span < gap:
        raise ValueError("span must be at least gap")
    frames = df.select(*keys, F.col(frame).cast("long").alias(frame)).where(F.col(frame).isNotNull())
    small, large = _by_size(frames, keys, span)
    emitted = _apart(small, keys, frame, gap)
    return emitted if large is None else emitted.unionByName(_throttle_chunks(large, keys, frame, gap, span))


def _throttle_chunks(df: DataFrame, keys: list[str], frame: str, gap: int, span: int) -> DataFrame:
    rows = df.select(*keys, F.col(frame).alias("f")).distinct()
    rows = rows.withColumn(CHUNK, by_span("f", span))
    chunk_field = T.StructField(CHUNK, T.LongType())
    longs = T.ArrayType(T.LongType())

    def steps(f: np.ndarray) -> np.ndarray:
        return np.searchsorted(f, f + gap)

    def enter(group: pd.DataFrame) -> pd.DataFrame:
        f = np.sort(group["f"].to_numpy())
        after = steps(f)
        leave = np.arange(len(f))
        for i in range(len(f) - 1, -1, -1):
            if after[i] < len(f):
                leave[i] = leave[after[i]]
        start = int(group[CHUNK].iloc[0]) * span
        entries = min(len(f), int(np.searchsorted(f, start + gap)) + 1)
        out = group.iloc[:1][[*keys, CHUNK]].copy()
        out["entry"] = [f[:entries].tolist()]
        out["leave"] = [f[leave[:entries]].tolist()]
        return out

    summaries = python_groups(rows, *keys, CHUNK).groupBy(*keys, CHUNK).applyInPandas(
        enter, _schema(df, keys, chunk_field, T.StructField("entry", longs), T.StructField("leave", longs))
    )

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values(CHUNK)
        last, chosen = None, []
        for entry, leave in zip(ordered["entry"], ordered["leave"]):
            at = 0 if last is None else int(np.searchsorted(entry, last + gap))
            if at < len(entry):
                chosen.append(int(entry[at]))
                last = int(leave[at])
            else:
                chosen.append(None)
        out = ordered[[*keys, CHUNK]].copy()
        out["first"] = pd.array(chosen, dtype="Int64")
        return out[out["first"].notna()]

    firsts = python_groups(summaries, *keys).groupBy(*keys).applyInPandas(
        walk, _schema(df, keys, chunk_field, T.StructField("first", T.LongType()))
    )

    def mark(group: pd.DataFrame) -> pd.DataFrame:
        f = np.sort(group["f"].to_numpy())
        after = steps(f)
        at, chosen = int(np.searchsorted(f, group["first"].iloc[0])), []
        while at < len(f):
            chosen.append(at)
            at = after[at]
        out = pd.DataFrame({k: group[k].iloc[0] for k in keys}, index=range(len(chosen)))
        out[frame] = f[chosen]
        return out

    return python_groups(rows.join(firsts, [*keys, CHUNK]), *keys, CHUNK).groupBy(*keys, CHUNK).applyInPandas(
        mark, _schema(df, keys, T.StructField(frame, T.LongType()))
    )


def throttle_by_bucket(df: DataFrame, keys: Sequence[str], frame: str, gap: int) -> DataFrame:
    """Cheap variant: the first frame of every ``gap``-wide bucket. Not the greedy rule."""
    return df.groupBy(*keys, F.floor(F.col(frame) / gap).alias("bucket")).agg(F.min(frame).alias(frame))


def admit(
    requests: DataFrame, keys: Sequence[str], at: str, cost: str, min_gap: int, max_accepted: int,
    budget: float, span: int = 100_000,
) -> DataFrame:
    """Accepted requests: far enough from the last accepted, below the count, budget left.

    Once the count or the budget is used up nothing is accepted any more, so both
    can be applied to the throttled sequence. Times must be unique per key.
    """
    keys = list(keys)
    if span < min_gap:
        raise ValueError("span must be at least min_gap")
    timed = requests.withColumn("_at", F.col(at).cast("long")).where("_at IS NOT NULL")
    small, large = _by_size(timed, keys, span)
    before = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce("_spent", F.lit(0))
    first = _apart(small, keys, "_at", min_gap, max_accepted).withColumn("_spent", F.sum(cost).over(before))
    accepted = first.where(spent < budget).select(*requests.columns)
    if large is None:
        return accepted
    kept = large.join(_throttle_chunks(large, keys, "_at", min_gap, span), [*keys, "_at"], "left_semi")
    ranked = running(
        kept, keys, ["_at"], by_span("_at", span),
        {"_before": ("count", F.col("_at")), "_spent": ("sum", F.col(cost))},
    )
    ranked = ranked.where((F.col("_before") < max_accepted) & (spent < budget))
    return accepted.unionByName(ranked.select(*requests.columns))


def rotate_sessions(
    turns: DataFrame, keys: Sequence[str], order: str, seconds: str, audio: str,
    max_seconds: float, max_turns: int, max_audio: float, span: int = 100_000,
) -> DataFrame:
    """Add ``session_no``: a turn opens a new session when the open one is used up.

    Used up means: older than ``max_seconds``, ``max_turns`` turns, or
    ``max_audio`` of audio, added turn by turn wherever the order is cut. ``order``
    is a whole number unique per key.
    """
    keys = list(keys)
    small, large = _by_size(turns, keys, span)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_keys(batches, keys):
            new = _new_key(table, keys)
            s, a = (table[c].to_numpy() for c in ("_s", "_a"))
            numbers, groups = np.zeros(len(s), dtype="int64"), int(new.sum())
            start, heard = np.zeros(groups), np.zeros(groups)
            count, no = np.zeros(groups, dtype="int64"), np.zeros(groups, dtype="int64")
            for here in _in_step(new):
                m = len(here)
                full = (no[:m] == 0) | (s[here] - start[:m] >= max_seconds) | (count[:m] >= max_turns) | (heard[:m] >= max_audio)
                no[:m] += full
                start[:m] = np.where(full, s[here], start[:m])
                count[:m] = np.where(full, 0, count[:m]) + 1
                heard[:m] = np.where(full, 0.0, heard[:m]) + a[here]
                numbers[here] = no[:m]
            yield from table.drop_columns(["_s", "_a"]).append_column("session_no", pa.array(numbers)).to_batches()

    schema = T.StructType([*turns.schema.fields, T.StructField("session_no", T.LongType())])
    numeric = small.withColumn("_s", F.col(seconds).cast("double")).withColumn("_a", F.col(audio).cast("double"))
    numbered = python_groups(numeric, *keys).sortWithinPartitions(*keys, order).mapInArrow(number, schema)
    if large is None:
        return numbered
    limits = max_seconds, max_turns, max_audio
    return numbered.unionByName(_rotate_chunks(large, keys, order, seconds, audio, limits, span).select(*schema.names))


def _rotate_chunks(
    turns: DataFrame, keys: list[str], order: str, seconds: str, audio: str, limits: tuple[float, int, float], span: int
) -> DataFrame:
    max_seconds, max_turns, max_audio = limits
    rows = turns.withColumn(CHUNK, by_span(order, span))
    doubles, longs = T.ArrayType(T.DoubleType()), T.ArrayType(T.LongType())
    slim = rows.select(*keys, CHUNK, F.col(order).cast("long").alias("o"),
                       F.col(seconds).cast("double").alias("s"), F.col(audio).cast("double").alias("a"))

    def prepare(group: pd.DataFrame):
        """Of a session that opens at each row: the row that finds it used up, and its audio by then, added turn by turn."""
        ordered = group.sort_values("o")
        s, a = ordered["s"].to_numpy(), ordered["a"].to_numpy()
        n, k = len(s), 1
        after, heard, live = np.full(n, n), a.copy(), np.arange(n - 1)
        while len(live):
            full = (s[live + k] - s[live] >= max_seconds) | (heard[live] >= max_audio) | (k >= max_turns)
            after[live[full]] = live[full] + k
            live = live[~full]
            heard[live] += a[live + k]
            k += 1
            live = live[live + k < n]
        return ordered["o"].to_numpy(), s, a, after, heard

    def enter(group: pd.DataFrame) -> pd.DataFrame:
        o, s, a, after, heard = prepare(group)
        n = len(o)
        last = np.arange(n)
        for i in range(n - 1, -1, -1):
            if after[i] < n:
                last[i] = last[after[i]]
        heads = min(n, max_turns)
        at = last[:heads]
        out = group.iloc[:1][[*keys, CHUNK]].copy()
        out["o"] = [o[:heads].tolist()]
        out["s"] = [s[:heads].tolist()]
        out["a"] = [a[:heads].tolist()]
        out["open_s"] = [s[at].tolist()]
        out["open_turns"] = [(n - at).tolist()]
        out["open_audio"] = [heard[at].tolist()]
        out["n"] = n
        return out

    fields = [
        T.StructField(CHUNK, T.LongType()), T.StructField("o", longs), T.StructField("s", doubles),
        T.StructField("a", doubles), T.StructField("open_s", doubles), T.StructField("open_turns", longs),
        T.StructField("open_audio", doubles), T.StructField("n", T.LongType()),
    ]
    summaries = python_groups(slim, *keys, CHUNK).groupBy(*keys, CHUNK).applyInPandas(enter, _schema(turns, keys, *fields))

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values(CHUNK)
        state, chosen = None, []
        columns = [ordered[f.name] for f in fields[1:]]
        for o, s, a, open_s, open_turns, open_audio, n in zip(*columns):
            at = 0
            if state is not None:
                start, count, heard = state
                places, heard = np.arange(len(o)), np.cumsum(np.append(heard, a))
                full = (s - start >= max_seconds) | (count + places >= max_turns) | (heard[:-1] >= max_audio)
                at = int(np.argmax(full)) if full.any() else None
            if at is None:
                state = (start, count + n, heard[-1])
                chosen.append(None)
            else:
                state = (open_s[at], open_turns[at], open_audio[at])
                chosen.append(int(o[at]))
        out = ordered[[*keys, CHUNK]].copy()
        out["first"] = pd.array(chosen, dtype="Int64")
        return out[out["first"].notna()]

    firsts = python_groups(summaries, *keys).groupBy(*keys).applyInPandas(
        walk, _schema(turns, keys, T.StructField(CHUNK, T.LongType()), T.StructField("first", T.LongType()))
    )

    def mark(group: pd.DataFrame) -> pd.DataFrame:
        o, _, _, after, _ = prepare(group)
        at, chosen = int(np.searchsorted(o, group["first"].iloc[0])), []
        while at < len(o):
            chosen.append(at)
            at = after[at]
        out = pd.DataFrame({k: group[k].iloc[0] for k in keys}, index=range(len(chosen)))
        out[order] = o[chosen]
        return out

    starts = python_groups(slim.join(firsts, [*keys, CHUNK]), *keys, CHUNK).groupBy(*keys, CHUNK).applyInPandas(
        mark, _schema(turns, keys, T.StructField(order, T.LongType()))
    ).withColumn("_opens", F.lit(1))
    joined = turns.join(starts, [*keys, order], "left")
    return running(
        joined, keys, [order], by_span(order, span), {"session_no": ("sum", F.coalesce("_opens", F.lit(0)))},
        inclusive=True,
    ).drop("_opens")
