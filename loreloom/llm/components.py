"""Connected components of a link table, kept in Spark throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.llm.tables import drop, stage


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (node, component): the smallest node reachable. Nodes without links are absent.

    Alternates two star steps: every node first links its larger neighbours, then its smaller ones,
    to the smallest it knows. A group of any size is only ever summed, never gathered, and the
    number of rounds grows with the logarithm of the longest path. Each round is a written table.
    """
    edges = links.where("a is not null and b is not null and a <> b")
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, path = stage(edges, "links")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        small = small.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            low.select("a", F.col("low").alias("b"))
        ).distinct()
        following, new = stage(small, "links")
        drop(links.sparkSession, path)
        edges, path, before = following, new, state
        state = _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def _state(edges: DataFrame) -> tuple:
    """Count and an order-free checksum of the links."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftrightunsigned(h, 20))).first())
