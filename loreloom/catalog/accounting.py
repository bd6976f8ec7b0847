"""Cost operators over ``conversations`` and ``events``."""

from pyspark.sql import functions as F

from loreloom.catalog import registry, table
from loreloom.operators import cost as co
from loreloom.operators.scan import by_span

LIMIT = 0.0005
USAGE_SQL = """
usage AS (
  SELECT conv_id AS run_id, turn, CASE WHEN conv_id % 5 = 4 THEN 'local' WHEN conv_id % 2 = 0 THEN 'small' ELSE 'vision' END AS model,
         CASE WHEN role = 'assistant' THEN 0 ELSE length(text) // 3 END AS input_tokens,
         CASE WHEN role = 'assistant' THEN length(text) // 3 ELSE 0 END AS output_tokens FROM conversations),
costs AS (
  SELECT *, (input_tokens * CASE model WHEN 'small' THEN 0.2 WHEN 'vision' THEN 0.15 ELSE 0 END
           + output_tokens * CASE model WHEN 'small' THEN 0.8 WHEN 'vision' THEN 1.5 ELSE 0 END)::DECIMAL(18, 4)
           * 0.000001::DECIMAL(18, 9) AS cost FROM usage)
"""


def _usage(spark, sf_dir):
    run = F.col("conv_id")
    tokens = F.floor(F.length("text") / 3)
    spoken = F.col("role") == "assistant"
    return table(spark, sf_dir, "conversations").select(
        run.alias("run_id"), "turn",
        F.when(run % 5 == 4, "local").when(run % 2 == 0, "small").otherwise("vision").alias("model"),
        F.when(spoken, 0).otherwise(tokens).alias("input_tokens"), F.when(spoken, tokens).otherwise(0).alias("output_tokens"),
    )


def _prices(spark):
    return spark.createDataFrame([("small", 0.2, 0.8), ("vision", 0.15, 1.5)], "model string, input_price double, output_price double")


@registry.add(
    f"""
    WITH {USAGE_SQL}
    SELECT run_id, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
           round(sum(cost)::DOUBLE, 9) AS total_cost, sum(cost) < {LIMIT} AS may_call
    FROM costs GROUP BY run_id
    """
)
def run_costs(spark, sf_dir):
    return co.run_costs(_usage(spark, sf_dir), _prices(spark), LIMIT).withColumn(
        "total_cost", F.round(F.col("total_cost").cast("double"), 9)
    )


@registry.add(
    f"""
    WITH {USAGE_SQL}
    SELECT run_id, turn, round(sum(cost) OVER w::DOUBLE, 9) AS run_total, (sum(cost) OVER w) - cost < {LIMIT} AS allowed
    FROM costs WINDOW w AS (PARTITION BY run_id ORDER BY turn)
    """
)
def running_budget(spark, sf_dir):
    costs = co.call_costs(_usage(spark, sf_dir), _prices(spark))
    return co.running_cost(costs, "run_id", ["turn"], by_span("turn", 100_000), LIMIT).select(
        "run_id", "turn", F.round(F.col("run_total").cast("double"), 9).alias("run_total"), "allowed"
    )


# Views carry measured counts; all other events are estimated from characters and seconds.
ESTIMATE_SQL = """
raw AS (SELECT event_id, user_id, event_type, value, (props->>'k')::BIGINT AS k FROM events),
est AS (
  SELECT event_id, user_id, event_type <> 'view' AS estimated,
         CASE WHEN event_type = 'view' THEN k ELSE round_even(k * 7 / 1.5, 0)::BIGINT END AS text_in,
         CASE WHEN event_type = 'view' THEN k % 3 ELSE round_even(value * 50.0, 0)::BIGINT END AS audio_in,
         CASE WHEN event_type = 'view' THEN k + 1 ELSE round_even(k / 1.5, 0)::BIGINT END AS text_out,
         CASE WHEN event_type = 'view' THEN 0 ELSE CASE WHEN k % 2 = 0 THEN 0 ELSE round_even(k * 100.0, 0)::BIGINT END END AS audio_out
  FROM raw)
"""


def _estimated(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    viewed = F.col("event_type") == "view"
    rows = table(spark, sf_dir, "events").select(
        "event_id", "user_id",
        F.when(viewed, k).alias("text_in"), F.when(viewed, k % 3).alias("audio_in"),
        F.when(viewed, k + 1).alias("text_out"), F.when(viewed, F.lit(0).cast("long")).alias("audio_out"),
        (k * 7).alias("chars_in"), F.col("value").alias("seconds_in"), k.alias("chars_out"),
        F.when(k % 2 == 0, 0.0).otherwise(k.cast("double")).alias("seconds_out"),
    )
    return co.estimate_usage(rows)


@registry.add(f"WITH {ESTIMATE_SQL} SELECT * FROM est")
def usage_estimate(spark, sf_dir):
    return _estimated(spark, sf_dir).select(
        "event_id", "user_id", "estimated", "text_in", "audio_in", "text_out", "audio_out"
    )


PRICES = {"text_in": 3.3, "audio_in": 27.0, "text_out": 20.0, "audio_out": 107.0}
COST_SQL = f"""
{ESTIMATE_SQL},
priced AS (
  SELECT *, (text_in * 3.3::DECIMAL(10, 4) + audio_in * 27.0::DECIMAL(10, 4)
          + CASE WHEN audio_out > 0 THEN audio_out * 107.0::DECIMAL(10, 4) ELSE text_out * 20.0::DECIMAL(10, 4) END)::DECIMAL(18, 4)
          * 0.000001::DECIMAL(18, 9) AS cost FROM est)
"""


@registry.add(
    f"""
    WITH {COST_SQL}
    SELECT user_id, sum(text_in)::BIGINT AS text_in, sum(audio_out)::BIGINT AS audio_out, round(sum(cost)::DOUBLE, 8) AS session_cost,
           sum(cost) >= 12 OR sum(cost) >= 16 AS warning, sum(cost) >= 20 AS exhausted
    FROM priced GROUP BY user_id
    """
)
def session_costs(spark, sf_dir):
    rows = co.session_costs(_estimated(spark, sf_dir), "user_id", PRICES, 12, 20)
    return rows.select(
        "user_id", "text_in", "audio_out", F.round(F.col("session_cost").cast("double"), 8).alias("session_cost"),
        "warning", "exhausted",
    )


@registry.add(
    f"""
    WITH {COST_SQL}
    SELECT event_id, round((sum(cost) OVER w)::DOUBLE, 8) AS session_cost, (sum(cost) OVER w) >= 12 AS warning,
           (sum(cost) OVER w) >= 20 AS exhausted
    FROM priced WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
    """
)
def running_session_cost(spark, sf_dir):
    rows = co.running_session_cost(
        _estimated(spark, sf_dir), "user_id", ["event_id"], by_span("event_id", 100_000), PRICES, 12, 20
    )
    return rows.select("event_id", F.round(F.col("session_cost").cast("double"), 8).alias("session_cost"), "warning", "exhausted")
