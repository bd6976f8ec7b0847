"""Postings made where the texts are, next to the grouped form."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreloom.operators import index as ix

BODIES = [
    (1, "a b a|c  a | ä a"), (2, None), (3, ""), (4, " | "), (5, "b"), (5, "b c b"), (5, "b c b"), (None, "x a x"), (None, "a"), (6, "z " * 3000 + "|q"),
]


def fields_of(spark):
    return ix.with_length(spark.createDataFrame(BODIES, "chunk_id long, body string").repartition(3))


def grouped(fields):
    return ix.tokens(fields).groupBy("term", "chunk_id", "dl").agg(
        F.count("*").alias("tf"), F.sort_array(F.collect_list("position")).alias("positions")
    )


def test_postings_equal_grouped_tokens(spark, monkeypatch):
    fields = fields_of(spark)
    rows = lambda df: sorted((str(r[0]), str(r[1]), r[2], r[3], r[4]) for r in df.collect())
    wanted = rows(grouped(fields))
    for size in (1, ix.LISTED_BYTES):
        monkeypatch.setattr(ix, "LISTED_BYTES", size)
        found = ix.postings(fields)
        assert rows(found) == wanted
    assert found.schema["tf"].dataType == grouped(fields).schema["tf"].dataType
    assert found.schema["positions"].dataType.elementType == grouped(fields).schema["positions"].dataType.elementType


def test_tokens_of_single_chunks_are_not_dealt(spark):
    fields = ix.with_length(spark.createDataFrame([(k, f"w{k} w w") for k in range(200)], "chunk_id long, body string"))
    graph = ix.postings(fields)._jdf.queryExecution().optimizedPlan().toString()
    single = graph.split("Aggregate")[0]
    assert "MapInArrow" in single and "Generate" not in single
