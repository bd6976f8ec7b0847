"""Retrieval quality and latency summaries."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.operators.scan import running


def ceil_rank(n: Column, q: float) -> Column:
    """1-based position ceil(q * n), kept inside 1..n."""
    return F.greatest(F.lit(1), F.least(n, F.ceil(F.lit(float(q)) * n)))


def floor_rank(n: Column, q: float) -> Column:
    """1-based position int(q * n), kept inside 1..n."""
    return F.greatest(F.lit(1), F.least(n, F.floor(n * F.lit(float(q)))))


def order_statistics(
    df: DataFrame, keys: Sequence[str], value: str, ranks: Mapping[str, tuple], total: str = "n"
) -> DataFrame:
    """Values at chosen positions of the sorted group, without sorting a group in one task.

    ``ranks`` maps an output name to (rule, q), for example ``(ceil_rank, 0.95)``.
    Equal values are counted first, counts are scanned in value order by chunks,
    and the first value whose running count reaches the position is taken.
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(
        F.count("*").alias("c")
    )
    chunk = F.floor(F.signum("v") * F.log1p(F.abs("v")) * 4096).cast("long")
    scanned = running(counts, keys, ["v"], chunk, {"upto": ("sum", F.col("c"))}, inclusive=True)
    sizes = counts.groupBy(*keys).agg(F.sum("c").alias(total))
    joined = scanned.join(sizes, keys) if keys else scanned.withColumn(total, sizes.scalar())
    n = F.col(total)
    picks = [
        F.min(F.when(F.col("upto") >= rule(n, q), F.col("v"))).alias(name)
        for name, (rule, q) in ranks.items()
    ]
    return joined.groupBy(*keys, total).agg(*picks)


def summarize(metrics: DataFrame, columns: Sequence[str]) -> DataFrame:
    """p50, p95 and max of each metric column by nearest rank."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])
    )
    long = metrics.select(pairs.alias("m")).select("m.*")
    ranks = {"p50": (ceil_rank, 0.5), "p95": (ceil_rank, 0.95), "max": (ceil_rank, 1.0)}
    return order_statistics(long, ["metric"], "value", ranks).select(
        "metric", "n", *[F.round(c, 3).alias(c) for c in ranks]
    )


def score_cases(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """Recall and reciprocal rank per case; a no-answer case scores 1 when nothing came back.

    ``cases``: query_id, expected_entities, expected_sources, expect_no_answer.
    ``hits``: query_id, rank, entity_id, source_id (at most top-k rows per query).
    """
    found = hits.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "entity_id", "source_id"))).alias("got")
    )
    empty = F.array().cast("array<string>")
    rows = cases.join(found, "query_id", "left").select(
        "query_id",
        F.coalesce("expect_no_answer", F.lit(False)).alias("expect_no_answer"),
        "expected_entities",
        "expected_sources",
        F.coalesce(F.transform("got", lambda h: h["entity_id"]), empty).alias("entities"),
        F.coalesce(F.transform("got", lambda h: h["source_id"]), empty).alias("sources"),
    )

    def share(expected: str, actual: str) -> Column:
        matched = F.size(F.array_intersect(expected, actual))
        return matched / F.greatest(F.lit(1), F.size(expected))

    nothing = (F.size("entities") == 0).cast("double")
    places = F.transform("expected_entities", lambda e: F.array_position("entities", e))
    best = F.array_min(F.filter(places, lambda p: p > 0))
    recall = F.when(F.col("expect_no_answer"), nothing).otherwise(
        F.least(share("expected_entities", "entities"), share("expected_sources", "sources"))
    )
    rr = F.when(F.col("expect_no_answer"), nothing).otherwise(F.coalesce(1.0 / best, F.lit(0.0)))
    return rows.withColumn("recall", recall).withColumn("rr", rr).withColumn(
        "passed", F.col("recall") == 1.0
    )


def evaluate(
    scored: DataFrame, thresholds: Mapping[str, float], mode: str, latency: str | None = None
) -> DataFrame:
    """One row: recall, MRR, no-answer accuracy, latency mean and p95, and the verdict."""
    no_answer = F.avg(F.when(F.col("expect_no_answer"), (F.size("entities") == 0).cast("double")))
    report = scored.agg(
        F.count("*").alias("case_count"),
        F.avg("recall").alias("recall_at_k"),
        F.avg("rr").alias("mrr"),
        F.coalesce(no_answer, F.lit(1.0)).alias("no_answer_accuracy"),
        *([F.avg(latency).alias("mean_latency_ms")] if latency else []),
    )
    within = F.lit(True)
    if latency:
        p95 = order_statistics(scored, [], latency, {"p95_latency_ms": (floor_rank, 0.95)})
        report = report.withColumn("p95_latency_ms", p95.select("p95_latency_ms").scalar())
        within = F.col("p95_latency_ms") <= thresholds.get(f"{mode}_p95_latency_ms", math.inf)
    wanted = {
        name: thresholds.get(f"{mode}_{name}", thresholds.get(name, 1.0))
        for name in ("recall_at_k", "mrr")
    }
    passed = (
        (F.col("recall_at_k") >= wanted["recall_at_k"])
        & (F.col("mrr") >= wanted["mrr"])
        & (F.col("no_answer_accuracy") >= thresholds["no_answer_accuracy"])
        & within
    )
    return report.withColumn("mode", F.lit(mode)).withColumn("passed", passed)
