"""Findings F20 and F23: Python is called once for a bucket of keys, not once for each key."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loreloom.operators import chains
from loreloom.streaming import sessions as ss
from tests.test_streams import EVENTS, START, fed, plain_sessions, state_keys


def test_sessions_of_many_runs_are_kept_by_bucket(spark, tmp_path):
    rng, rows, at = random.Random(5), [], START
    for i in range(400):
        at += timedelta(seconds=rng.choice([1, 5, 20]))
        rows.append((rng.choice([None, *(f"r{k}" for k in range(60))]), i, at, rng.choice(["view"] * 7 + ["run_ended"])))
    late = [("late", 10_000, at + timedelta(days=3), "view")]
    build = lambda s: ss.sessions_stream(s, "run", ["seq"], "ts", "type", "run_ended", 300, buckets=5)
    got = fed(spark, rows + late, EVENTS, [150, 400], build, str(tmp_path))
    want = plain_sessions([(r or "none", *others) for r, *others in rows], 300)
    micros = lambda t: (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    assert sorted((r.run or "none", *r[1:5]) for r in got.collect()) == sorted((r, micros(a), micros(b), n, why) for r, a, b, n, why in want)
    assert len(state_keys(spark, tmp_path, "open")) == 1 == len(state_keys(spark, tmp_path, "due"))


@pytest.mark.parametrize("cuts", [[], [40, 41, 200]])
def test_admission_of_many_keys_is_kept_by_bucket(spark, tmp_path, cuts):
    rng, rows, at = random.Random(7), [], 0
    for _ in range(400):
        at += rng.randrange(1, 6)
        rows.append((rng.randrange(50), at, rng.choice([None, *range(300)])))
    schema = "k long, at long, cents long"
    costed = lambda s: s.withColumn("cost", (F.col("cents") / 100).cast("decimal(18,2)"))
    build = lambda s: ss.admission_stream(costed(s), "k", "at", "cost", 60, 4, 5, buckets=4)
    got = fed(spark, rows, schema, cuts, build, str(tmp_path))
    want = chains.admit(costed(spark.createDataFrame(rows, schema)), ["k"], "at", "cost", 60, 4, 5, 100)
    assert sorted((r.k, r.at, r.cents) for r in got.collect()) == sorted((r.k, r.at, r.cents) for r in want.collect())
    assert len(state_keys(spark, tmp_path, "granted")) == 4
