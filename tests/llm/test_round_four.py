"""Findings on near duplicates: work per group of a task, and deals by band key."""

from __future__ import annotations

import gc

from loreloom.llm import hyperminhash, memory


class Task:
    def __init__(self, number):
        self.number = number

    def taskAttemptId(self):  # noqa: N802
        return self.number


def test_memory_is_given_back_once_a_task_and_not_once_a_group(monkeypatch):
    found = []
    monkeypatch.setattr(gc, "collect", lambda *a: found.append(1))
    for number in (901, 901, 901, 902, 902, None, None):
        monkeypatch.setattr("pyspark.TaskContext.get", lambda n=number: None if n is None else Task(n))
        memory.frugal()
    assert len(found) == 4  # one for each task, one for each call outside a task


def test_bucket_entries_are_dealt_once(spark):
    rows = spark.createDataFrame([(k, n) for k in range(5) for n in range(k)], "key long, node long")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shared = hyperminhash._shared(rows)
        plan = shared._jdf.queryExecution().executedPlan().toString()
        found = sorted(map(tuple, shared.select("key", "node", "hub").collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == [(k, n, 0) for k in range(2, 5) for n in range(k)]
    assert "ReusedExchange" in plan
