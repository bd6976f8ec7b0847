"""Event-stream operators over ``events``: user as run, event id as sequence."""

from pyspark.sql import functions as F

from loreloom.catalog import registry, table
from loreloom.operators import chains, events as ev, state as st
from loreloom.operators.scan import by_hours, by_span
from loreloom.session import spread
from loreloom.streaming import events as se

K = "(props->>'k')::BIGINT"
ARRIVAL = "event_id + (event_id * 7919) % 400"
SPAN = 100_000


def _events(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return (
        rows.withColumn("ts", F.col("ts").cast("timestamp"))
        .withColumn("k", F.get_json_object("props", "$.k").cast("long"))
        .withColumn("seq", F.col("event_id") + 1)
        .withColumn("arrival", F.col("event_id") + (F.col("event_id") * 7919) % 400)
    )


def log_lines(spark, sf_dir):
    """Log lines written from the table, with noise, broken JSON and mistyped fields."""
    e = spread(_events(spark, sf_dir))
    room = F.floor(F.col("event_id") / 500)
    kinds = {
        "view": "collectible_spawned", "click": "collectible_taken",
        "signup": "player_state_changed", "purchase": "run_started",
    }
    type_ = F.lit("heartbeat")
    for name, mapped in kinds.items():
        type_ = F.when(F.col("event_type") == name, F.lit(mapped)).otherwise(type_)
    payload = (
        F.when(F.col("event_type") == "view", F.format_string('{"collectible_id":%d,"init_seed":%d}', F.col("k") + 1, F.col("k") % 10))
        .when(F.col("event_type") == "click", F.format_string('{"collectible_id":%d}', F.col("k") + 1))
        .when(
            F.col("event_type") == "signup",
            F.format_string('{"player":{"controller_index":%d,"coins":%d,"f%d":%d}}', F.col("k") % 2, F.col("k"), F.col("k") % 3, F.col("event_id")),
        )
        .otherwise(F.lit("{}"))
    )
    seq = F.when((F.col("event_type") == "error") & (F.col("k") % 3 == 2), F.lit("true")).otherwise(F.col("seq").cast("string"))
    good = F.format_string(
        '[x] [EVENT]{"schema_version":1,"seq":%s,"run_id":"u%d","type":"%s","game_frame":%d,'
        '"context":{"room_index":%d,"room_spawn_seed":%d,"room_type":%d},"payload":%s}',
        seq, F.col("user_id"), type_, F.col("event_id"), room, room * 7, F.when(room % 2 == 0, 4).otherwise(1), payload,
    )
    broken = F.when(F.col("k") % 3 == 0, F.format_string("noise %d", F.col("event_id"))).when(
        F.col("k") % 3 == 1, F.format_string("[EVENT] {broken %d", F.col("event_id"))
    ).otherwise(good)
    return e.select("event_id", F.when(F.col("event_type") == "error", broken).otherwise(good).alias("value"))


def accepted(spark, sf_dir):
    return ev.valid_events(ev.parse_events(log_lines(spark, sf_dir)))


@registry.add(
    f"""
    SELECT event_id, CASE WHEN event_type = 'error' AND {K} % 3 = 0 THEN 'ignored'
           WHEN event_type = 'error' THEN 'invalid' ELSE 'valid' END AS status,
           CASE WHEN event_type = 'error' AND {K} % 3 = 1
                THEN 'json,schema_version,seq,run_id,type,game_frame'
                WHEN event_type = 'error' AND {K} % 3 = 2 THEN 'seq'
                WHEN event_type = 'error' THEN NULL ELSE '' END AS broken
    FROM events
    """
)
def event_parse(spark, sf_dir):
    """Every line is valid, invalid with the broken rules, or ignored."""
    return ev.parse_events(log_lines(spark, sf_dir)).select(
        "event_id", "status", F.array_join("broken_rules", ",").alias("broken")
    )


SEQ_SQL = f"""
    seen AS (
      SELECT event_id, user_id, event_id + 1 AS seq, coalesce(max(event_id + 1) OVER (
             PARTITION BY user_id ORDER BY {ARRIVAL}, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top
      FROM events),
    checked AS (
      SELECT event_id, user_id, seq > top AS accepted,
             CASE WHEN seq > top AND top > 0 THEN seq - top - 1 ELSE 0 END AS gap FROM seen)
"""


@registry.add(f"WITH {SEQ_SQL} SELECT event_id, accepted, gap FROM checked")
def seq_check(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", "user_id", "seq", "arrival")
    checked = ev.seq_check(e, "user_id", "seq", ["arrival", "event_id"], by_span("arrival", SPAN))
    return checked.select("event_id", "accepted", "gap")


@registry.add(
    f"""WITH {SEQ_SQL} SELECT user_id, count(*) FILTER (accepted) AS parsed_events,
        count(*) FILTER (NOT accepted) AS out_of_order_events, sum(gap)::BIGINT AS sequence_gaps
        FROM checked GROUP BY user_id"""
)
def stream_diagnostics(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", "user_id", "seq", "arrival")
    checked = ev.seq_check(e, "user_id", "seq", ["arrival", "event_id"], by_span("arrival", SPAN))
    return ev.diagnostics(checked, "user_id")


@registry.add(
    """
    WITH f AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id)
                         THEN 1 ELSE 0 END AS new FROM events)
    SELECT event_id, (sum(new) OVER (PARTITION BY user_id ORDER BY event_id))::BIGINT AS visit FROM f
    """
)
def room_visits(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", "user_id", "seq", "event_type")
    return ev.visits(e, "user_id", "seq", ["event_type"]).select("event_id", "visit")


@registry.add(
    """
    SELECT user_id, epoch_us(min(ts)) AS opened_us, epoch_us(max(ts)) AS last_us, count(*) AS events,
           CASE WHEN count(*) FILTER (event_type = 'signup') > 0 THEN 'ended' ELSE 'run_change' END AS end_reason
    FROM events GROUP BY user_id
    """
)
def run_sessions(spark, sf_dir):
    rows = ev.sessions(_events(spark, sf_dir), "user_id", "seq", "ts", "event_type", "signup")
    return rows.select(
        "user_id", F.unix_micros("opened_at").alias("opened_us"), F.unix_micros("last_at").alias("last_us"),
        "events", "end_reason",
    )


@registry.add(
    """
    WITH g AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
    SELECT user_id, epoch_us(before) AS from_us, epoch_us(ts) AS to_us,
           round((epoch_us(ts) - epoch_us(before)) / 1000000.0, 3) AS seconds
    FROM g WHERE epoch_us(ts) - epoch_us(before) > 86400000000
    """
)
def liveness_gaps(spark, sf_dir):
    rows = ev.liveness_gaps(
        _events(spark, sf_dir).select("user_id", "ts", "event_id"), "user_id", "ts", ["ts", "event_id"], 86400, by_hours("ts", 1)
    )
    return rows.select(
        "user_id", F.unix_micros("silent_from").alias("from_us"), F.unix_micros("silent_to").alias("to_us"),
        F.round("seconds", 3).alias("seconds"),
    )


@registry.add(
    f"""
    WITH g AS (SELECT event_id, event_type || '/' || ({K} // 50) AS s,
                      lag(event_type || '/' || ({K} // 50)) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
    SELECT event_id FROM g WHERE s IS DISTINCT FROM before
    """
)
def change_events(spark, sf_dir):
    """Snapshots that differ from the user's snapshot before."""
    e = _events(spark, sf_dir).withColumn("half", F.floor(F.col("k") / 50))
    changed = ev.change_events(
        e.select("event_id", "user_id", "event_type", "half"), ["user_id"], ["event_id"], ["event_type", "half"],
        by_span("event_id", SPAN),
    )
    return changed.select("event_id")


@registry.add(
    f"""
    WITH s AS (SELECT event_id, user_id, {K} AS k, lag({K}) OVER (PARTITION BY user_id ORDER BY event_id) AS p
               FROM events WHERE event_type = 'purchase'),
    items AS (
      SELECT event_id, user_id, 0 AS item, k AS n, coalesce(p, 0) AS had FROM s
      UNION ALL SELECT event_id, user_id, 1 + k % 5, k + 1, CASE WHEN p % 5 = k % 5 THEN p + 1 ELSE 0 END FROM s)
    SELECT event_id, item::BIGINT AS item, n - had AS count_added, n AS total_count FROM items WHERE n > had
    """
)
def inventory_gains(spark, sf_dir):
    """Two-item inventories from purchases; only growing counts are events."""
    bought = _events(spark, sf_dir).where("event_type = 'purchase'").select(
        "event_id", "user_id",
        F.create_map(F.lit(0).cast("long"), F.col("k"), 1 + F.col("k") % 5, F.col("k") + 1).alias("counts"),
    )
    gains = ev.inventory_gains(bought, ["user_id"], ["event_id"], "counts", by_span("event_id", SPAN))
    return gains.select("event_id", "item", "count_added", "total_count")


HOURS = "floor(epoch_us(ts) / 3600000000)::BIGINT"


@registry.add(
    f"""
    WITH RECURSIVE f AS (SELECT DISTINCT user_id, {HOURS} AS frame FROM events),
    chain AS (
      SELECT user_id, min(frame) AS frame FROM f GROUP BY user_id
      UNION ALL
      SELECT c.user_id, min(f.frame) FROM chain c JOIN f ON f.user_id = c.user_id AND f.frame >= c.frame + 60
      GROUP BY c.user_id, c.frame)
    SELECT user_id, frame FROM chain
    """
)
def throttle(spark, sf_dir):
    """Emit at most once per 60 hours and user, counted from the last emission."""
    e = _events(spark, sf_dir).select("user_id", F.floor(F.unix_micros("ts") / 3_600_000_000).alias("frame"))
    return chains.throttle(e, ["user_id"], "frame", 60)


@registry.add(
    """
    WITH RECURSIVE chain AS (
      SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id
      UNION ALL
      SELECT c.user_id, min(e.event_id) FROM chain c JOIN events e ON e.user_id = c.user_id AND e.event_id >= c.event_id + 50
      GROUP BY c.user_id, c.event_id),
    ranked AS (
      SELECT user_id, event_id, row_number() OVER w AS n,
             coalesce(sum(value::DECIMAL(18, 2)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent
      FROM chain JOIN events USING (user_id, event_id) WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, event_id FROM ranked WHERE n <= 20 AND spent < 500
    """
)
def admission(spark, sf_dir):
    """Accepted requests: 50 ids apart, at most 20 per user, budget 500."""
    e = _events(spark, sf_dir).select("user_id", "event_id", F.col("value").cast("decimal(18,2)").alias("cost"))
    return chains.admit(e, ["user_id"], "event_id", "cost", 50, 20, 500).select("user_id", "event_id")


@registry.add(
    """
    WITH RECURSIVE r AS (
      SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s, value AS a,
             row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    walk AS (
      SELECT user_id, event_id, i, s AS start, 1 AS turns, a AS audio, 1 AS session_no FROM r WHERE i = 1
      UNION ALL
      SELECT r.user_id, r.event_id, r.i,
             CASE WHEN r.s - w.start >= 432000 OR w.turns >= 8 OR w.audio >= 150 THEN r.s ELSE w.start END,
             CASE WHEN r.s - w.start >= 432000 OR w.turns >= 8 OR w.audio >= 150 THEN 1 ELSE w.turns + 1 END,
             CASE WHEN r.s - w.start >= 432000 OR w.turns >= 8 OR w.audio >= 150 THEN r.a ELSE w.audio + r.a END,
             w.session_no + CASE WHEN r.s - w.start >= 432000 OR w.turns >= 8 OR w.audio >= 150 THEN 1 ELSE 0 END
      FROM walk w JOIN r ON r.user_id = w.user_id AND r.i = w.i + 1)
    SELECT event_id, session_no FROM walk
    """
)
def session_rotation(spark, sf_dir):
    """New session after five days, eight turns or 150 units of audio."""
    e = _events(spark, sf_dir).select(
        "user_id", "event_id", (F.unix_micros("ts") / 1e6).alias("s"), F.col("value").alias("a")
    )
    rotated = chains.rotate_sessions(e, ["user_id"], "event_id", "s", "a", 432000, 8, 150)
    return rotated.select("event_id", "session_no")


@registry.add(
    f"""
    WITH req AS (
      SELECT event_id AS result_id, user_id, ts + to_hours(({K})::INT) AS done, event_id + 1 AS token_seq,
             CASE WHEN {K} % 2 = 0 THEN 'click' ELSE 'view' END AS token_type
      FROM events WHERE event_type = 'error'),
    live AS (SELECT user_id, ts, event_id + 1 AS seq, event_type FROM events WHERE event_type <> 'error')
    SELECT result_id, l.seq AS state_seq,
           coalesce(l.seq >= token_seq AND l.event_type = token_type, FALSE) AS current
    FROM req ASOF LEFT JOIN live l ON req.user_id = l.user_id AND req.done >= l.ts
    """
)
def stale_results(spark, sf_dir):
    """Each error row asks for something that completes k hours later; is its room still current?"""
    e = _events(spark, sf_dir)
    asked = e.where("event_type = 'error'").select(
        F.col("event_id").alias("result_id"), "user_id",
        F.timestamp_micros(F.unix_micros("ts") + F.col("k") * 3_600_000_000).alias("ts"),
        F.col("seq").alias("token_seq"),
        F.when(F.col("k") % 2 == 0, "click").otherwise("view").alias("token_event_type"),
    )
    live = e.where("event_type <> 'error'").select("user_id", "ts", "seq", "event_type")
    marked = ev.mark_stale(asked, live, "user_id", "ts", "seq", ["event_type"], by_hours("ts", 1))
    return marked.select("result_id", "state_seq", "current")


@registry.add(
    f"""
    SELECT event_id FROM events e WHERE NOT EXISTS (
      SELECT 1 FROM events p WHERE p.event_type = 'signup' AND (p.props->>'k')::INT < 5
      AND e.ts >= p.ts AND e.ts < p.ts + INTERVAL 30 MINUTE)
    """
)
def unpaused_events(spark, sf_dir):
    """Events outside the half hours that follow some signups."""
    e = _events(spark, sf_dir)
    pauses = e.where("event_type = 'signup' AND k < 5").select(
        F.col("ts").alias("paused_at"), (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("resumed_at")
    )
    return ev.drop_paused(e.select("event_id", "ts"), pauses, "ts").select("event_id")


@registry.add(
    """
    WITH r AS (SELECT user_id, event_id, '#' || (event_id + 1) || '  ' || event_type AS t,
                      row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS i FROM events QUALIFY i <= 8)
    SELECT user_id, string_agg(t, chr(10) ORDER BY i) AS recent FROM r GROUP BY user_id
    """
)
def recent_events(spark, sf_dir):
    return ev.recent_events(_events(spark, sf_dir).select("user_id", "seq", "event_type"), "user_id", "seq", "event_type", 8)


# Room state in SQL: rooms are 500 ids wide, so a user's visits are the rooms in order.
ITEMS_SQL = f"""
live AS (SELECT 'u' || user_id AS run_id, event_id + 1 AS seq, event_type, {K} AS k, event_id // 500 AS room
         FROM events WHERE event_type <> 'error'),
spawns AS (
  SELECT run_id, room, seq, k + 1 AS item, k % 10 AS seed,
         lead(seq) OVER (PARTITION BY run_id, room, k % 10 ORDER BY seq) AS until FROM live WHERE event_type = 'view'),
takes AS (SELECT run_id, room, seq, k + 1 AS item FROM live WHERE event_type = 'click'),
touched AS (
  SELECT DISTINCT s.run_id, s.room, s.seed FROM spawns s JOIN takes t ON s.run_id = t.run_id AND s.room = t.room
  AND s.item = t.item AND t.seq > s.seq AND (s.until IS NULL OR t.seq < s.until)),
items AS (
  SELECT s.run_id, s.room, s.seed, min(seq) AS item_no, arg_max(item, seq) AS collectible_id,
         max(t.seed) IS NOT NULL AS taken
  FROM spawns s LEFT JOIN touched t ON s.run_id = t.run_id AND s.room = t.room AND s.seed = t.seed GROUP BY ALL),
visit AS (SELECT run_id, room, dense_rank() OVER (PARTITION BY run_id ORDER BY room) AS visit
          FROM (SELECT DISTINCT run_id, room FROM live)),
latest AS (SELECT run_id, max(room) AS room FROM live GROUP BY run_id)
"""


@registry.add(
    f"""WITH {ITEMS_SQL} SELECT run_id, visit, item_no, collectible_id, seed::VARCHAR AS init_seed, taken
        FROM items JOIN visit USING (run_id, room)"""
)
def room_items(spark, sf_dir):
    """Items of every room visit, rerolled in place and marked when taken."""
    return st.room_items(accepted(spark, sf_dir))


@registry.add(
    f"""
    WITH {ITEMS_SQL},
    heads AS (
      SELECT run_id, max(seq) AS last_seq, max(seq) - 1 AS game_frame, arg_max(event_type, seq) AS t,
             count(*) FILTER (event_type = 'purchase') > 0 AS active FROM live GROUP BY run_id),
    here AS (SELECT run_id, count(*) AS room_items, count(*) FILTER (taken) AS taken_items
             FROM items JOIN latest USING (run_id, room) GROUP BY run_id)
    SELECT run_id, last_seq, game_frame, room AS room_index, active,
           CASE t WHEN 'view' THEN 'collectible_spawned' WHEN 'click' THEN 'collectible_taken'
                  WHEN 'signup' THEN 'player_state_changed' ELSE 'run_started' END AS last_event_type,
           coalesce(room_items, 0) AS room_items, coalesce(taken_items, 0) AS taken_items
    FROM heads JOIN latest USING (run_id) LEFT JOIN here USING (run_id)
    """
)
def state_rebuild(spark, sf_dir):
    rows = st.rebuild_state(accepted(spark, sf_dir))
    return rows.select(
        "run_id", "last_seq", "game_frame", F.col("context.room_index").alias("room_index"), "active",
        "last_event_type", "room_items", "taken_items",
    )


@registry.add(
    f"""
    WITH s AS (SELECT 'u' || user_id AS run_id, event_id, {K} AS k FROM events WHERE event_type = 'signup'),
    f AS (
      SELECT run_id, k % 2 AS controller, event_id, 'coins' AS field, k::VARCHAR AS value FROM s
      UNION ALL SELECT run_id, k % 2, event_id, 'controller_index', (k % 2)::VARCHAR FROM s
      UNION ALL SELECT run_id, k % 2, event_id, 'f' || (k % 3), event_id::VARCHAR FROM s)
    SELECT run_id, controller, field, arg_max(value, event_id) AS value FROM f GROUP BY ALL
    """
)
def player_fields(spark, sf_dir):
    """Latest value of every player field; a record only updates the keys it carries."""
    return st.player_fields(accepted(spark, sf_dir))


@registry.add(
    f"""WITH {ITEMS_SQL} SELECT run_id, arg_max(collectible_id, item_no) AS collectible_id
        FROM items JOIN latest USING (run_id, room) WHERE NOT taken GROUP BY run_id"""
)
def latest_untaken(spark, sf_dir):
    return st.latest_untaken(st.current_items(accepted(spark, sf_dir)))


def _event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@registry.add(f"WITH {SEQ_SQL} SELECT event_id, accepted, gap FROM checked")
def stream_seq_check(spark, sf_dir):
    """The sequence check as a stateful stream over the same table."""
    e = _event_stream(spark, sf_dir).select(
        "event_id", "user_id", (F.col("event_id") + 1).alias("seq"),
        (F.col("event_id") + (F.col("event_id") * 7919) % 400).alias("arrival"),
    )
    checked = se.order_guard(e, "user_id", "seq", ["arrival", "event_id"])
    return se.run_to_table(checked, "stream-seq").select("event_id", "accepted", "gap")


@registry.add(registry.sql["change_events"])
def stream_change_events(spark, sf_dir):
    """Change detection as a stateful stream."""
    e = _event_stream(spark, sf_dir).select(
        "event_id", "user_id", "event_type",
        F.floor(F.get_json_object("props", "$.k").cast("long") / 50).alias("half"),
    )
    changed = se.change_stream(e, "user_id", ["event_id"], ["event_type", "half"])
    return se.run_to_table(changed, "stream-change").select("event_id")
