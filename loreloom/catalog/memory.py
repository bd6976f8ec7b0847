"""Memory operators over ``events`` and ``conversations``."""

from pyspark.sql import functions as F

from loreloom.catalog import registry, table
from loreloom.operators import memory as me
from loreloom.operators.scan import by_span

K = "(props->>'k')::BIGINT"


@registry.add(
    f"""
    WITH c AS (
      SELECT user_id, event_id, event_type AS content, {K} % 10 / 10.0 AS confidence,
             ['manual', 'explicit', 'confirmed', 'inferred'][1 + {K} % 4] AS level FROM events),
    f AS (SELECT *, CASE WHEN content IS DISTINCT FROM lag(content) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS new FROM c),
    v AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM f),
    g AS (
      SELECT user_id, version::BIGINT AS version, any_value(content) AS content, max(confidence)::DOUBLE AS confidence,
             arg_max(CASE WHEN level = 'inferred' OR confidence < 0.8 THEN 'pending' ELSE 'active' END, event_id) AS s,
             arg_max(level, event_id) AS confirmation_level, min(event_id) AS created_at, max(event_id) AS updated_at,
             count(*) AS evidence_count FROM v GROUP BY ALL)
    SELECT user_id, version, content, confidence, confirmation_level, created_at, updated_at, evidence_count,
           CASE WHEN version = max(version) OVER (PARTITION BY user_id) THEN s ELSE 'conflicted' END AS status,
           CASE WHEN version > 1 THEN version - 1 END AS supersedes_version
    FROM g
    """
)
def memory_versions(spark, sf_dir):
    """Each user's preferred event type over time as superseding memories."""
    k = F.get_json_object("props", "$.k").cast("long")
    levels = F.array(*[F.lit(x) for x in me.LEVELS])
    candidates = table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.col("event_type").alias("content"), (k % 10 / 10.0).alias("confidence"),
        F.get(levels, (k % 4).cast("int")).alias("confirmation_level"), F.lit("events").alias("source"),
        F.col("event_id").alias("at"),
    )
    rows = me.memory_versions(candidates, ["user_id"], ["event_id"], by_span("event_id", 100_000))
    return rows.drop("source_summary")


KEY = r"regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^0-9a-z\x{{4e00}}-\x{{9fff}}]+', '', 'g')"
PAIRS = "list_distinct([substr({0}, i, 2) FOR i IN range(1, greatest(2, length({0})))])"


@registry.add(
    f"""
    WITH RECURSIVE m AS (
      SELECT conv_id, turn AS id, text AS content, ['profile', 'stable_preference', 'milestone'][1 + turn % 3] AS kind,
             {KEY.format('text')} AS k FROM conversations WHERE role <> 'assistant'),
    q AS (SELECT conv_id, conv_id * 1000 + turn AS query_id, {KEY.format('text')} AS k FROM conversations WHERE role = 'assistant'),
    scored AS (
      SELECT q.query_id, m.id, m.kind, m.content, length(m.content) AS n,
             CASE WHEN kind = 'profile' THEN 4 ELSE 0 END
             + CASE WHEN q.k = '' OR m.k = '' THEN 0
                    ELSE len(list_intersect({PAIRS.format('q.k')}, {PAIRS.format('m.k')})) END AS score
      FROM q JOIN m USING (conv_id)),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) AS r FROM scored WHERE score > 0),
    walk AS (
      SELECT query_id, 0::BIGINT AS r, 0::BIGINT AS used, 0 AS taken, FALSE AS hit FROM (SELECT DISTINCT query_id FROM ranked)
      UNION ALL
      SELECT w.query_id, x.r, CASE WHEN w.taken < 3 AND x.n <= 360 - w.used THEN w.used + x.n ELSE w.used END,
             CASE WHEN w.taken < 3 AND x.n <= 360 - w.used THEN w.taken + 1 ELSE w.taken END,
             w.taken < 3 AND x.n <= 360 - w.used
      FROM walk w JOIN ranked x ON x.query_id = w.query_id AND x.r = w.r + 1)
    SELECT w.query_id, taken AS item_no, id, kind, score FROM walk w JOIN ranked x ON x.query_id = w.query_id AND x.r = w.r WHERE hit
    """
)
def memory_recall(spark, sf_dir):
    """For every assistant turn: the conversation's other turns that fit the recall budget."""
    turns = table(spark, sf_dir, "conversations")
    kinds = F.array(F.lit("profile"), F.lit("stable_preference"), F.lit("milestone"))
    memories = turns.where("role <> 'assistant'").select(
        "conv_id", F.col("turn").alias("id"), F.get(kinds, (F.col("turn") % 3).cast("int")).alias("kind"),
        F.col("text").alias("content"), F.lit("active").alias("status"), F.lit("t").alias("updated_at"),
    )
    queries = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query")
    )
    return me.recall(queries, memories, "conv_id").select("query_id", "item_no", "id", "kind", "score")


@registry.add(
    f"""
    WITH RECURSIVE e AS (SELECT event_id, event_type, {K} AS k FROM events),
    m AS (SELECT event_id AS id, 'text ' || k AS content, ['active', 'disabled', 'pending', 'conflicted'][1 + k % 4] AS status,
                 (k % 10) / 10.0 AS confidence, 'explicit' AS level, event_id AS updated_at FROM e WHERE event_type = 'view'),
    a AS (SELECT event_id - k AS id, event_id AS moment, k,
                 CASE event_type WHEN 'click' THEN 'enable' WHEN 'purchase' THEN 'disable' WHEN 'signup' THEN 'correct' ELSE 'delete' END AS action
          FROM e WHERE event_type <> 'view' AND (event_type <> 'error' OR k < 50)),
    o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY moment) AS i FROM a),
    walk AS (
      SELECT id, content, status, confidence, level, updated_at, FALSE AS gone, 0::BIGINT AS i FROM m
      UNION ALL
      SELECT w.id,
        CASE WHEN NOT gone AND action = 'correct' THEN 'fixed ' || o.k ELSE content END,
        CASE WHEN gone THEN status WHEN action = 'correct' THEN 'active'
             WHEN action IN ('enable', 'disable') AND status <> 'conflicted' THEN CASE action WHEN 'enable' THEN 'active' ELSE 'disabled' END
             ELSE status END,
        CASE WHEN gone THEN confidence WHEN action = 'correct' THEN 1.0
             WHEN action = 'enable' AND status <> 'conflicted' THEN greatest(confidence, 0.8) ELSE confidence END,
        CASE WHEN gone THEN level WHEN action = 'correct' THEN 'manual'
             WHEN action = 'enable' AND status <> 'conflicted' THEN 'confirmed' ELSE level END,
        CASE WHEN gone THEN updated_at WHEN action = 'correct' OR (action IN ('enable', 'disable') AND status <> 'conflicted') THEN o.moment
             ELSE updated_at END,
        gone OR action = 'delete', o.i
      FROM walk w JOIN o ON o.id = w.id AND o.i = w.i + 1),
    last AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY id ORDER BY i DESC) = 1)
    SELECT id, content, status, confidence::DOUBLE AS confidence, level AS confirmation_level, updated_at FROM last WHERE NOT gone
    """
)
def memory_actions(spark, sf_dir):
    """Memories from views after a log of enable, disable, correct and delete events."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    statuses = F.array(*[F.lit(s) for s in ("active", "disabled", "pending", "conflicted")])
    memories = e.where("event_type = 'view'").select(
        F.col("event_id").alias("id"), F.lit("profile").alias("kind"), F.concat(F.lit("text "), "k").alias("content"),
        F.get(statuses, (F.col("k") % 4).cast("int")).alias("status"), (F.col("k") % 10 / 10.0).alias("confidence"),
        F.lit("explicit").alias("confirmation_level"), F.lit("events").alias("source_summary"),
        F.col("event_id").alias("created_at"), F.col("event_id").alias("updated_at"),
    )
    names = F.create_map(*[F.lit(x) for x in ("click", "enable", "purchase", "disable", "signup", "correct", "error", "delete")])
    actions = e.where("event_type <> 'view' AND (event_type <> 'error' OR k < 50)").select(
        (F.col("event_id") - F.col("k")).alias("id"), F.col("event_id").alias("at"),
        F.try_element_at(names, F.col("event_type")).alias("action"), F.concat(F.lit("fixed "), "k").alias("content"),
        F.lit(None).cast("string").alias("kind"),
    )
    return me.apply_actions(memories, actions).select(
        "id", "content", "status", "confidence", "confirmation_level", "updated_at"
    )
