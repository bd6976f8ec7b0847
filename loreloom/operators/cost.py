"""Token cost, budgets and usage estimates. Money is decimal so sums do not drift."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.operators.scan import running

MONEY = "decimal(28,9)"

# Estimation rates and the share of the hard budget that warns.
CHARS_PER_TOKEN = 1.5
INPUT_AUDIO_TOKENS_PER_SECOND = 50.0
OUTPUT_AUDIO_TOKENS_PER_SECOND = 100.0
HARD_BUDGET_WARNING = 0.8
# End of fixed values.


def price(tokens: Column, per_million: Column) -> Column:
    return (tokens.cast("decimal(18,0)") * per_million.cast("decimal(10,4)") / F.lit(1_000_000)).cast(MONEY)


def call_costs(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Add ``cost``; a model without a price is free. ``prices``: model, input_price, output_price."""
    priced = usage.join(prices, "model", "left")
    zero = F.lit(0)
    cost = price(F.col("input_tokens"), F.coalesce("input_price", zero)) + price(
        F.col("output_tokens"), F.coalesce("output_price", zero)
    )
    return priced.withColumn("cost", cost.cast(MONEY)).drop("input_price", "output_price")


def run_costs(usage: DataFrame, prices: DataFrame, limit: float) -> DataFrame:
    """Total per run and whether another online call is allowed."""
    return call_costs(usage, prices).groupBy("run_id").agg(
        F.count("*").alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("cost").cast(MONEY).alias("total_cost"),
    ).withColumn("may_call", F.col("total_cost") < F.lit(str(limit)).cast(MONEY))


def running_cost(
    costs: DataFrame, run: str, order: Sequence[str], chunk: Column, limit: float
) -> DataFrame:
    """Total so far including the call, and whether the call was still allowed before it."""
    total = running(costs, [run], order, chunk, {"run_total": ("sum", F.col("cost"))}, inclusive=True)
    before = (F.col("run_total") - F.col("cost")).cast(MONEY)
    return total.withColumn("run_total", F.col("run_total").cast(MONEY)).withColumn(
        "allowed", before < F.lit(str(limit)).cast(MONEY)
    )


def estimate_usage(df: DataFrame) -> DataFrame:
    """Fill missing token counts from characters and audio seconds, rounding half to even.

    A row counts as measured only when all four counts are present.
    """
    parts = {
        "text_in": F.col("chars_in") / CHARS_PER_TOKEN,
        "audio_in": F.col("seconds_in") * INPUT_AUDIO_TOKENS_PER_SECOND,
        "text_out": F.col("chars_out") / CHARS_PER_TOKEN,
        "audio_out": F.col("seconds_out") * OUTPUT_AUDIO_TOKENS_PER_SECOND,
    }
    measured = F.lit(True)
    for name in parts:
        measured = measured & F.col(name).isNotNull() & (F.col(name) >= 0)
    rows = df.withColumn("_measured", F.coalesce(measured, F.lit(False)))
    for name, guess in parts.items():
        estimate = F.greatest(F.lit(0), F.bround(F.coalesce(guess, F.lit(0.0)), 0)).cast("long")
        rows = rows.withColumn(name, F.when(F.col("_measured"), F.col(name)).otherwise(estimate))
    return rows.withColumn("estimated", ~F.col("_measured")).drop("_measured")


def four_way_cost(prices: Mapping[str, float]) -> Column:
    """Cost of a row with text/audio in/out tokens; audio output replaces text output."""
    def rate(name):
        return F.lit(str(prices[name]))
    out = F.when(F.col("audio_out") > 0, price(F.col("audio_out"), rate("audio_out"))).otherwise(
        price(F.col("text_out"), rate("text_out"))
    )
    return (
        price(F.col("text_in"), rate("text_in")) + price(F.col("audio_in"), rate("audio_in")) + out
    ).cast(MONEY)


def budget_flags(total: Column, soft: float, hard: float) -> dict[str, Column]:
    def money(x):
        return F.lit(str(x)).cast(MONEY)
    warn = (total >= money(soft)) | (total >= money(round(hard * HARD_BUDGET_WARNING, 9)))
    return {"warning": warn, "exhausted": total >= money(hard)}


def session_costs(usage: DataFrame, session: str, prices: Mapping[str, float], soft: float, hard: float) -> DataFrame:
    rows = usage.withColumn("cost", four_way_cost(prices))
    totals = rows.groupBy(session).agg(
        *[F.sum(c).alias(c) for c in ("text_in", "audio_in", "text_out", "audio_out")],
        F.sum("cost").cast(MONEY).alias("session_cost"),
        F.max("estimated").alias("estimated"),
    )
    return totals.withColumns(budget_flags(F.col("session_cost"), soft, hard))


def running_session_cost(
    usage: DataFrame, session: str, order: Sequence[str], chunk: Column, prices: Mapping[str, float],
    soft: float, hard: float,
) -> DataFrame:
    rows = usage.withColumn("cost", four_way_cost(prices))
    total = running(rows, [session], order, chunk, {"session_cost": ("sum", F.col("cost"))}, inclusive=True)
    return total.withColumns(budget_flags(F.col("session_cost"), soft, hard))
