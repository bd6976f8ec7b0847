import random
import tracemalloc
from hashlib import sha256
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loreloom.operators import dedup


def model_simhash(text):
    votes = [0] * 64
    for token in re.findall(r"[0-9a-z]+|[㐀-鿿]", text.casefold()):
        value = int(sha256(token.encode()).hexdigest()[:16], 16)
        for bit in range(64):
            votes[bit] += 1 if value >> bit & 1 else -1
    return sum(1 << b for b in range(64) if votes[b] >= 0)


def model_greedy(rows):
    """Walk in order and compare with every kept row."""
    kept, result = [], {}
    for node, checksum, sim, length in rows:
        if any(c == checksum for c, _, _ in kept):
            result[node] = "exact"
        elif any(
            bin(sim ^ s).count("1") <= 3 and min(length, n) / max(length, n) >= 0.92 for _, s, n in kept
        ):
            result[node] = "near"
        else:
            kept.append((checksum, sim, length))
            result[node] = "kept"
    return result


def signed(value):
    return value - (1 << 64) if value >= 1 << 63 else value


def random_rows(seed, count, cluster_bits):
    rng = random.Random(seed)
    centers = [rng.getrandbits(64) for _ in range(4)]
    rows = []
    for node in range(count):
        sim = rng.choice(centers)
        for _ in range(rng.randint(0, cluster_bits)):
            sim ^= 1 << rng.randrange(64)
        rows.append((node, f"c{rng.randrange(count)}", sim, rng.choice([90, 95, 100, 104, 110, 300])))
    return rows


@pytest.mark.parametrize("seed,window", [(1, 512), (2, 512), (3, 3), (4, 2)])
def test_greedy_matches_model(spark, seed, window):
    rows = random_rows(seed, 120, 6)
    df = spark.createDataFrame(
        [(n, c, signed(s), length) for n, c, s, length in rows],
        "node_id long, checksum string, simhash long, text_length int",
    )
    got = dedup.greedy_dedup(df.repartition(3), "node_id", ["node_id"], window=window)
    assert {r["node_id"]: r["status"] for r in got.collect()} == model_greedy(rows)


def test_all_rows_in_one_bucket(spark):
    """A third of the rows are copies, the rest share their lower bands but are not near."""
    rng = random.Random(7)
    rows = [(i, "same", 5, 100) for i in range(40)]
    rows += [(40 + i, f"u{i}", (rng.getrandbits(32) << 32) | 0xABCD1234, 100) for i in range(80)]
    df = spark.createDataFrame(
        [(n, c, signed(s), length) for n, c, s, length in rows],
        "node_id long, checksum string, simhash long, text_length int",
    )
    got = dedup.greedy_dedup(df, "node_id", ["node_id"], window=16)
    assert {r["node_id"]: r["status"] for r in got.collect()} == model_greedy(rows)


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_same_result_for_any_partitioning(spark, partitions):
    rows = random_rows(11, 60, 5)
    df = spark.createDataFrame(
        [(n, c, signed(s), length) for n, c, s, length in rows],
        "node_id long, checksum string, simhash long, text_length int",
    ).repartition(partitions)
    got = dedup.greedy_dedup(df, "node_id", ["node_id"])
    assert {r["node_id"]: r["status"] for r in got.collect()} == model_greedy(rows)


def test_simhash_and_bands(spark):
    texts = ["", "The quick brown fox", "妈妈的菜刀 attack up", "straße 12 12 12", "!!!"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = dedup.signatures(df).select(
        "text", "simhash", *[dedup.band(F.col("simhash"), i).alias(f"b{i}") for i in range(4)]
    ).collect()
    for row in rows:
        want = model_simhash(row["text"])
        assert row["simhash"] == signed(want)
        assert [row[f"b{i}"] for i in range(4)] == [want >> 16 * i & 0xFFFF for i in range(4)]


@pytest.mark.parametrize("blocks", [4, 5, 6])
def test_blocking_keys_never_miss_a_near_pair(spark, blocks):
    rng = random.Random(blocks)
    pairs = []
    for i in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            b ^= 1 << bit
        la = rng.randint(12, 5000)
        lb = max(1, int(la * rng.uniform(0.92, 1.0)) + 1)
        if min(la, lb) / max(la, lb) >= 0.92:
            pairs.append((i, signed(a), signed(b), la, lb))
    df = spark.createDataFrame(pairs, "i int, a long, b long, la int, lb int")
    shared = F.size(
        F.array_intersect(
            dedup.blocking_keys(F.col("a"), F.col("la"), blocks), dedup.blocking_keys(F.col("b"), F.col("lb"), blocks)
        )
    )
    assert df.where(shared == 0).count() == 0


def test_near_pairs_fold_copies(spark):
    df = spark.createDataFrame(
        [(1, "a", 7, 100), (2, "b", 7, 100), (3, "c", 6, 100), (4, "d", -1, 100)],
        "doc_id long, checksum string, simhash long, text_length int",
    )
    rows = dedup.near_pairs(df, "doc_id").collect()
    assert [(r["left_id"], r["right_id"], r["left_copies"], r["hamming"]) for r in rows] == [(1, 3, 2, 1)]


def test_exact_only_and_conflicts(spark):
    df = spark.createDataFrame([(2, "x"), (1, "x"), (3, "y")], "node_id long, checksum string")
    kept = dedup.drop_exact(df, ["node_id"], "node_id")
    assert sorted(r[0] for r in kept.collect()) == [1, 3]
    flagged = {r["node_id"]: r["source_conflict"] for r in dedup.flag_conflicts(df, ["checksum"]).collect()}
    assert flagged == {1: True, 2: True, 3: False}


def test_signature_memory_does_not_grow_with_the_words():
    """A batch remembers the hashes of some words only; the signatures are the same."""
    texts = pd.Series([" ".join(f"w{i}x{k}" for k in range(500)) for i in range(200)])
    one_by_one = [dedup._simhash64.func(texts[i : i + 1]).iloc[0] for i in (0, 150, 199)]
    tracemalloc.start()
    found = dedup._simhash64.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [found.iloc[i] for i in (0, 150, 199)] == one_by_one
    assert peak < 8 << 20
