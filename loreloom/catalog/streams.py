"""Stateful streams over ``events``, fed in steps: each step adds files and starts the query anew from its checkpoint."""

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.catalog import events as tables
from loreloom.catalog import registry, table
from loreloom.operators import events as ev
from loreloom.operators.scan import by_span
from loreloom.session import python_groups
from loreloom.sources import tail
from loreloom.streaming import events as se
from loreloom.streaming import sessions as ss

STEPS = 3
BUCKETS = 2_048  # of users that are handled together


def _step(spark, sf_dir):
    """The step of an event: ids in thirds."""
    top = table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0
    return F.least(F.floor(F.col("event_id") * STEPS / F.lit(top + 1)), F.lit(STEPS - 1)).cast("int")


def in_steps(spark, rows: DataFrame, step, build, label: str, flush: DataFrame | None = None) -> DataFrame:
    """What the stream ``build`` puts out over all steps of ``rows``; ``flush`` is one more step."""
    root = se.stream_folder(spark, label)
    source = os.path.join(root, "source")
    parts = [rows.where(step == k) for k in range(STEPS)] + ([flush] if flush is not None else [])
    out = None
    for part in parts:
        part.select(*rows.columns).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        out = se.run_to_table(build(stream), label, root)
    return out


@registry.add(
    """
    WITH o AS (
      SELECT *, CASE WHEN before IS NULL OR epoch_us(ts) - epoch_us(before) > 432000000000 OR kind = 'signup' THEN 1 ELSE 0 END AS opens
      FROM (SELECT *, lag(ts) OVER w AS before, lag(event_type) OVER w AS kind FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM o)
    SELECT user_id, min(epoch_us(ts)) AS opened_us, max(epoch_us(ts)) AS last_us, count(*) AS events,
           CASE WHEN bool_or(event_type = 'signup') THEN 'ended' ELSE 'idle' END AS end_reason
    FROM s GROUP BY user_id, n
    """
)
def stream_sessions(spark, sf_dir):
    """Sessions end with a signup or after five silent days; the last step's late event moves the watermark past all others."""
    e = tables._events(spark, sf_dir).select("user_id", "event_id", "ts", "event_type")
    late = e.agg((F.max("ts") + F.expr("INTERVAL 100 DAYS")).alias("ts")).select(
        F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("long").alias("event_id"), "ts", F.lit("view").alias("event_type")
    )
    build = lambda s: ss.sessions_stream(s, "user_id", ["event_id"], "ts", "event_type", "signup", 432_000, buckets=BUCKETS)
    out = in_steps(spark, e, _step(spark, sf_dir), build, "stream-sessions", late)
    return out.select("user_id", "opened_us", "last_us", "events", "end_reason")


@registry.add(registry.sql["throttle"])
def stream_throttle(spark, sf_dir):
    """At most once per 60 hours and user; a user's state goes when the watermark is 60 hours past the last emission."""
    e = tables._events(spark, sf_dir).select("user_id", "event_id", "ts", F.floor(F.unix_micros("ts") / 3_600_000_000).alias("frame"))
    build = lambda s: ss.throttle_stream(s, "user_id", "frame", 60, "ts", 3600)
    return in_steps(spark, e, _step(spark, sf_dir), build, "stream-throttle").select("user_id", "frame")


@registry.add(registry.sql["admission"])
def stream_admission(spark, sf_dir):
    e = tables._events(spark, sf_dir).select("user_id", "event_id", F.col("value").cast("decimal(18,2)").alias("cost"))
    build = lambda s: ss.admission_stream(s, "user_id", "event_id", "cost", 50, 20, 500, BUCKETS)
    return in_steps(spark, e, _step(spark, sf_dir), build, "stream-admission").select("user_id", "event_id")


@registry.add(registry.sql["session_rotation"])
def stream_rotation(spark, sf_dir):
    e = tables._events(spark, sf_dir).select(
        "user_id", "event_id", (F.unix_micros("ts") / 1e6).alias("s"), F.col("value").alias("a")
    )
    build = lambda s: ss.rotation_stream(s, "user_id", "event_id", "s", "a", 432000, 8, 150)
    return in_steps(spark, e, _step(spark, sf_dir), build, "stream-rotation").select("event_id", "session_no")


@registry.add(registry.sql["stream_sessions"])
def idle_sessions(spark, sf_dir):
    """The sessions of the stream over the whole table at once."""
    e = tables._events(spark, sf_dir).select("user_id", "event_id", "ts", "event_type")
    return ss.sessions_by_idle(e, "user_id", ["event_id"], "ts", "event_type", "signup", 432_000, by_span("event_id", tables.SPAN))


def append_lines(lines: DataFrame, folder: str, step: int, last: bool, replace: int) -> None:
    """Write a step's lines (file, ord, value) to the end of growing files; all but the last step stop in the middle of a line.

    File number ``replace`` is taken away and begun anew. A task that runs twice for one step leaves the same file.
    """
    place = folder.removeprefix("file://") if folder.startswith("file:///") else folder.removeprefix("file:")

    def write(frame):
        import pandas as pd

        number = int(frame["file"].iloc[0])
        path, notes = os.path.join(place, f"{number}.log"), os.path.join(place, f"{number}.notes")
        known = json.load(open(notes)) if os.path.exists(notes) else {}
        size, held, shown = known.get(str(step - 1), [0, "", 0])
        text = held + "".join(v + "\n" for v in frame.sort_values("ord")["value"])
        data = text.encode()
        tail_size = 0 if last else len(data) - data.rfind(b"\n", 0, len(data) - 1) - 1
        cut = len(data) - tail_size + min(tail_size, 5)  # a few bytes of the last line
        if number == replace and size:
            os.replace(path, path + ".old")
            size, shown = 0, 0
        with open(path, "r+b" if os.path.exists(path) else "w+b") as f:
            f.truncate(size)
            f.seek(size)
            f.write(data[shown:cut])
        known[str(step)] = [size + cut - shown, data[len(data) - tail_size :].decode(), min(tail_size, 5)]
        with open(notes + ".new", "w") as f:
            json.dump(known, f)
        os.replace(notes + ".new", notes)
        return pd.DataFrame({"file": [number]})

    python_groups(lines, "file").groupBy("file").applyInPandas(write, "file int").write.format("noop").mode("overwrite").save()


@registry.add(registry.sql["event_parse"])
def log_tail(spark, sf_dir):
    """Log files that grow in three steps, cut in the middle of lines, one of them replaced on the way, followed and parsed."""
    lines = tables.log_lines(spark, sf_dir)
    files = -(-max(lines.count(), 1) // 50_000) + 3
    placed = lines.select("event_id", F.col("event_id").alias("ord"), F.pmod("event_id", F.lit(files)).cast("int").alias("file"), "value")
    root = se.stream_folder(spark, "log-tail")
    folder = os.path.join(root, "logs")
    os.makedirs(folder.removeprefix("file://"), exist_ok=True)
    out, step = None, _step(spark, sf_dir)
    for k in range(STEPS):
        append_lines(placed.where(step == k), folder, k, k == STEPS - 1, 0 if k == 2 else -1)
        parsed = ev.parse_events(tail.tail_lines(spark, folder, pattern="*.log", splitBytes=str(1 << 20)))
        out = se.run_to_table(parsed, "log-tail", root)
    known = F.regexp_extract("value", r'(?:noise |broken |"game_frame":)(\d+)', 1).cast("long")
    return out.select(known.alias("event_id"), "status", F.array_join("broken_rules", ",").alias("broken"))


@registry.add(registry.sql["state_rebuild"])
def stream_state(spark, sf_dir):
    """Game state of every run after three steps of a stream, kept as typed fields and maps."""
    lines = tables.log_lines(spark, sf_dir)
    build = lambda s: se.state_stream(ev.valid_events(ev.parse_events(s)))
    out = in_steps(spark, lines, _step(spark, sf_dir), build, "stream-state")
    fields = [c for c in out.columns if c not in ("run_id", "state", "batch")]
    return out.groupBy("run_id").agg(F.max_by(F.struct(*fields), "batch").alias("s")).select("run_id", "s.*")


PAUSES_SQL = """
    p AS (SELECT ts AS a, CASE k % 4 WHEN 0 THEN ts + INTERVAL 30 MINUTE WHEN 1 THEN ts + INTERVAL 50 HOUR ELSE ts + INTERVAL 1 MINUTE END AS b
          FROM (SELECT *, (props->>'k')::INT AS k FROM events) WHERE event_type = 'signup' AND event_id % 97 = 0
          UNION ALL SELECT min(ts), NULL FROM events WHERE event_id >= (SELECT max(event_id) * 9 // 10 FROM events))"""


@registry.add(
    f"""WITH {PAUSES_SQL} SELECT event_id FROM events e
        WHERE NOT EXISTS (SELECT 1 FROM p WHERE e.ts >= a AND (b IS NULL OR e.ts < b))"""
)
def stream_unpaused(spark, sf_dir):
    """Streamed events outside short and long pauses, and before one that is still open."""
    e = tables._events(spark, sf_dir)
    k = F.col("k") % 4
    length = F.when(k == 0, F.expr("INTERVAL 30 MINUTES")).when(k == 1, F.expr("INTERVAL 50 HOURS")).otherwise(F.expr("INTERVAL 1 MINUTE"))
    closed = e.where("event_type = 'signup' AND event_id % 97 = 0").select(F.col("ts").alias("paused_at"), (F.col("ts") + length).alias("resumed_at"))
    top = e.agg(F.max("event_id")).first()[0] or 0
    open_ = e.where(F.col("event_id") >= top * 9 // 10).agg(F.min("ts").alias("paused_at")).withColumn("resumed_at", F.lit(None).cast("timestamp"))
    build = lambda s: se.drop_paused_stream(s, closed.unionByName(open_), "ts", coarse=8)
    return in_steps(spark, e.select("event_id", "ts"), _step(spark, sf_dir), build, "stream-unpaused").select("event_id")


@registry.add(
    f"""
    WITH {tables.SEQ_SQL.replace(tables.ARRIVAL, "event_id").replace("FROM events)", "FROM events WHERE event_type <> 'error')")}
    SELECT 'u' || user_id AS run_id, count(*) FILTER (accepted) AS parsed_events,
           count(*) FILTER (NOT accepted) AS out_of_order_events, sum(gap)::BIGINT AS sequence_gaps FROM checked GROUP BY user_id
    """
)
def listen_diagnostics(spark, sf_dir):
    """The listening job over three steps of log lines: diagnostics of all its batches."""
    from loreloom.plans import jobs

    lines, step = tables.log_lines(spark, sf_dir), _step(spark, sf_dir)
    root = se.stream_folder(spark, "listen")
    for k in range(STEPS):
        lines.where(step == k).write.mode("append").parquet(os.path.join(root, "source"))
        stream = spark.readStream.schema(lines.schema).parquet(os.path.join(root, "source"))
        jobs.listen(stream, root, ["event_id"], availableNow=True).awaitTermination()
    return jobs.listened(spark, root).diagnostics
