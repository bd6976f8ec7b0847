"""Keyed streams over several micro-batches: any cut gives the batch result, and state is given up."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loreloom.operators import chains
from loreloom.operators.scan import by_span
from loreloom.streaming import events as se
from loreloom.streaming import sessions as ss

START = datetime(2024, 1, 1)
EVENTS = "run string, seq long, ts timestamp, type string"


def fed(spark, rows, schema, cuts, build, root):
    """Rows of the stream's batches; the query is started anew for every slice of the rows."""
    source, out = f"{root}/source", None
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        spark.createDataFrame(rows[a:b], schema).write.mode("append").parquet(source)
        out = se.run_to_table(build(spark.readStream.schema(schema).parquet(source)), "t", root)
    return out


def state_keys(spark, root, name):
    found = spark.read.format("statestore").option("stateVarName", name).load(f"{root}/progress")
    return sorted(r[0] for r in found.select("key.*").collect() if r[0] is not None)


def plain_sessions(rows, idle):
    out, open_ = [], {}
    for run, _, ts, kind in rows:
        if run in open_ and (ts - open_[run][1]).total_seconds() > idle:
            out.append((run, *open_.pop(run), "idle"))
        first, _, n = open_.get(run, (ts, ts, 0))
        open_[run] = (first, ts, n + 1)
        if kind == "run_ended":
            out.append((run, *open_.pop(run), "ended"))
    return sorted(out + [(run, *held, "idle") for run, held in open_.items()])


@pytest.mark.parametrize("cuts", [[], [100, 200], [1, 2, 3, 150, 299]])
def test_sessions(spark, tmp_path, cuts):
    rng, rows, at = random.Random(4), [], START
    for i in range(300):
        at += timedelta(seconds=rng.choice([1, 5, 20]))
        rows.append((f"r{rng.randrange(4)}", i, at, rng.choice(["view"] * 7 + ["run_ended"])))
    want = plain_sessions(rows, 45)
    micros = lambda t: (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    late = [("late", 10_000, at + timedelta(days=3), "view")]
    build = lambda s: ss.sessions_stream(s, "run", ["seq"], "ts", "type", "run_ended", 45)
    got = fed(spark, rows + late, EVENTS, [*cuts, 300], build, str(tmp_path))
    assert sorted(tuple(r)[:5] for r in got.collect()) == sorted((r, micros(a), micros(b), n, why) for r, a, b, n, why in want)
    batch = ss.sessions_by_idle(spark.createDataFrame(rows, EVENTS), "run", ["seq"], "ts", "type", "run_ended", 45, by_span("seq", 16))
    assert sorted(map(tuple, batch.collect())) == sorted((r, micros(a), micros(b), n, why) for r, a, b, n, why in want)
    assert state_keys(spark, tmp_path, "open") == ["late"]


def test_state_of_an_ended_run_is_gone(spark, tmp_path):
    rows = [("a", 1, START, "view"), ("b", 2, START, "view"), ("a", 3, START + timedelta(seconds=2), "run_ended"), ("c", 4, START + timedelta(seconds=3), "view")]
    build = lambda s: ss.sessions_stream(s, "run", ["seq"], "ts", "type", "run_ended", 3600)
    got = fed(spark, rows[:2], EVENTS, [], build, str(tmp_path))
    assert got.count() == 0 and state_keys(spark, tmp_path, "open") == ["a", "b"]
    spark.createDataFrame(rows[2:], EVENTS).write.mode("append").parquet(f"{tmp_path}/source")
    got = se.run_to_table(build(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/source")), "t", str(tmp_path))
    assert [(r.run, r.events, r.end_reason) for r in got.collect()] == [("a", 2, "ended")]
    assert state_keys(spark, tmp_path, "open") == ["b", "c"] == state_keys(spark, tmp_path, "due")


@pytest.mark.parametrize("cuts", [[], [40], [10, 11, 70]])
def test_throttle_admission_and_rotation_equal_the_batch(spark, tmp_path, cuts):
    rng, rows, at = random.Random(6), [], 0
    for _ in range(120):
        at += rng.randrange(1, 6)
        rows.append((rng.choice("xxy"), at, float(rng.randrange(4)), rng.randrange(300)))
    schema = "k string, at long, audio double, cents long"
    table = spark.createDataFrame(rows, schema).withColumn("cost", (F.col("cents") / 100).cast("decimal(18,2)"))
    with_cost = lambda s: s.withColumn("cost", (F.col("cents") / 100).cast("decimal(18,2)"))

    got = fed(spark, rows, schema, cuts, lambda s: ss.throttle_stream(s, "k", "at", 9), f"{tmp_path}/t")
    assert sorted((r.k, r.at) for r in got.collect()) == sorted((r.k, r.at) for r in chains.throttle(table, ["k"], "at", 9, 20).collect())

    build = lambda s: ss.admission_stream(with_cost(s), "k", "at", "cost", 7, 6, 8)
    got = fed(spark, rows, schema, cuts, build, f"{tmp_path}/a")
    want = chains.admit(table, ["k"], "at", "cost", 7, 6, 8, 20)
    assert sorted((r.k, r.at) for r in got.collect()) == sorted((r.k, r.at) for r in want.collect())

    timed = lambda s: s.withColumn("s", F.col("at").cast("double"))
    build = lambda s: ss.rotation_stream(timed(s), "k", "at", "s", "audio", 60, 9, 12)
    got = fed(spark, rows, schema, cuts, build, f"{tmp_path}/r")
    want = chains.rotate_sessions(timed(table), ["k"], "at", "s", "audio", 60, 9, 12, 25)
    assert sorted((r.k, r.at, r.session_no) for r in got.collect()) == sorted((r.k, r.at, r.session_no) for r in want.collect())


def test_throttle_state_expires_with_the_watermark(spark, tmp_path):
    rows = [("a", 0, START, "v"), ("b", 1, START + timedelta(seconds=1), "v"), ("b", 30, START + timedelta(seconds=30), "v")]
    frames = lambda s: s.select("run", F.unix_seconds("ts").alias("frame"), "ts")
    build = lambda s: ss.throttle_stream(frames(s), "run", "frame", 10, "ts", 1)
    got = fed(spark, rows, EVENTS, [2], build, str(tmp_path))
    assert got.count() == 3
    assert state_keys(spark, tmp_path, "last") == ["b"]


def test_open_and_long_pauses(spark, tmp_path):
    times = spark.range(0, 400).select("id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 3600).alias("ts"))
    times.coalesce(1).write.parquet(str(tmp_path / "times"))
    hour = lambda h: None if h is None else START.fromtimestamp(1_700_000_000 + h * 3600)
    spans = [(3, 5), (20, 21), (40, 190), (100, 130), (300, None), (350, None), (250, 250)]
    pauses = spark.createDataFrame([(1_700_000_000 + a * 3600, None if b is None else 1_700_000_000 + b * 3600) for a, b in spans], "a long, b long").select(
        F.timestamp_seconds("a").alias("paused_at"), F.timestamp_seconds("b").alias("resumed_at")
    )
    want = [i for i in range(400) if not any(a <= i and (b is None or i < b) for a, b in spans)]
    live = spark.readStream.schema(times.schema).parquet(str(tmp_path / "times"))
    for coarse in (4, 1024):
        kept = se.run_to_table(se.drop_paused_stream(live, pauses, "ts", coarse=coarse), "paused")
        assert sorted(r["id"] for r in kept.collect()) == want


def test_listening_writes_every_batch_once_and_counts(spark, tmp_path):
    from loreloom.plans import jobs

    line = lambda run, seq: '[EVENT]{"schema_version":1,"seq":%d,"run_id":"%s","type":"heartbeat","game_frame":1,"context":{},"payload":{}}' % (seq, run)
    steps = [[line("a", 1), line("a", 2), "noise", "[EVENT] {bad"], [line("a", 5), line("b", 1), line("a", 5)], [line("a", 4), line("a", 6), "more noise"]]
    metrics = jobs.ListenMetrics()
    spark.streams.addListener(metrics)
    try:
        source, out, n = str(tmp_path / "source"), str(tmp_path / "out"), 0
        for rows in steps:
            spark.createDataFrame([(v, n + i) for i, v in enumerate(rows)], "value string, at long").coalesce(1).write.mode("append").parquet(source)
            n += len(rows)
            stream = spark.readStream.schema("value string, at long").parquet(source)
            jobs.listen(stream, out, ["at"], availableNow=True).awaitTermination()
    finally:
        spark.streams.removeListener(metrics)
    found = jobs.listened(spark, out)
    want = {("a", 4, 2, 2), ("b", 1, 0, 0)}
    assert {tuple(r) for r in found.diagnostics.collect()} == want
    assert sorted((r.run_id, r.seq) for r in found.recorded.collect()) == [("a", 1), ("a", 2), ("a", 5), ("a", 6), ("b", 1)]
    assert [r.value for r in found.invalid.collect()] == ["[EVENT] {bad"]
    # the same batch again replaces itself
    again = spark.createDataFrame([("x", 9, "b", "{}", "valid", True, 0, None)], "run_id string, seq long, value string, json string, status string, accepted boolean, gap long, broken_rules array<string>")
    for _ in range(2):
        jobs.write_batch(out)(again, 99)
    assert found.diagnostics.count() == 2 and jobs.listened(spark, out).recorded.where("run_id = 'x'").count() == 1
    assert metrics.total() == {"lines": 10, "valid": 7, "invalid": 1, "ignored": 2}


def test_state_maps_hold_what_the_run_has(spark, tmp_path):
    """Items of a room that was left, and nothing else, leave the state."""
    from loreloom.operators import events as ev

    def line(seq, room, kind, payload):
        return '[EVENT]{"schema_version":1,"seq":%d,"run_id":"r","type":"%s","game_frame":%d,"context":{"room_index":%d},"payload":%s}' % (seq, kind, seq, room, payload)

    lines = [line(1, 1, "collectible_spawned", '{"collectible_id":7,"init_seed":1}'), line(2, 1, "collectible_spawned", '{"collectible_id":8,"init_seed":2}'),
             line(3, 1, "player_state_changed", '{"player":{"controller_index":0,"coins":3}}'), line(4, 1, "collectible_taken", '{"collectible_id":8}'),
             line(5, 2, "collectible_spawned", '{"collectible_id":9,"init_seed":2}'), line(6, 2, "player_state_changed", '{"player":{"controller_index":0,"keys":1}}')]
    build = lambda s: se.state_stream(ev.valid_events(ev.parse_events(s)))
    got = fed(spark, [(v,) for v in lines], "value string", [1, 4], build, str(tmp_path))
    by_batch = {r.last_seq: (r.room_items, r.taken_items) for r in got.collect()}
    assert by_batch == {1: (1, 0), 4: (2, 1), 6: (1, 0)}
    read = lambda name: spark.read.format("statestore").option("stateVarName", name).load(f"{tmp_path}/progress")
    assert [r[0] for r in read("items").selectExpr("user_map_key.item_no").collect()] == [5]
    assert sorted(tuple(r) for r in read("players").selectExpr("user_map_key.field", "user_map_value.value").collect()) == [
        ("coins", "3"), ("controller_index", "0"), ("keys", "1")
    ]


@pytest.mark.parametrize("cuts", [[], [10, 11, 70]])
def test_rotation_stream_adds_audio_turn_by_turn(spark, tmp_path, cuts):
    rng = random.Random(3)
    rows = [("k", i, float(rng.randrange(200)), rng.choice([0.1, 0.2, 0.3, 0.7])) for i in range(150)]
    want, no, start, turns, heard = {}, 0, 0.0, 0, 0.0
    for _, i, s, a in rows:
        if not no or s - start >= 150 or turns >= 9 or heard >= 1.5:
            no, start, turns, heard = no + 1, s, 0, 0.0
        turns, heard = turns + 1, heard + a
        want[i] = no
    build = lambda s: ss.rotation_stream(s, "k", "at", "s", "audio", 150, 9, 1.5)
    got = fed(spark, rows, "k string, at long, s double, audio double", cuts, build, str(tmp_path))
    assert {r.at: r.session_no for r in got.collect()} == want
