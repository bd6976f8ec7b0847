"""Findings of round 4: runs dealt as lists, features hashed once for many words."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from loreloom.llm import backoff, segments
from loreloom.llm.tables import CLEANUP, stage
from loreloom.llm.words import WordHashes, Windows


def word_salad(n: int) -> list[tuple]:
    draw = random.Random(5)
    texts = [" ".join(draw.choice("a b c d e f g h rare%d" % k if k % 7 == 0 else "a b c d").lower().replace(" ", "x") for _ in range(k)) for k in range(n)]
    return [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, texts[5]), (n, None), (n + 1, "")]


@pytest.mark.parametrize("order", [1, 3])
def test_blocks_and_parts_do_not_change_scores(spark, monkeypatch, order):
    docs = spark.createDataFrame(word_salad(40), "doc_id long, text string").repartition(3)
    rows = lambda: sorted(map(str, backoff.scores(docs, order=order).collect()))
    whole = rows()
    monkeypatch.setattr(backoff, "BLOCK_BYTES", 50)
    monkeypatch.setattr(backoff, "PART_WORDS", 37)
    assert rows() == whole and len(whole) == 44


def test_runs_are_dealt_as_lists_of_a_block(spark):
    docs = spark.createDataFrame([(k, "the same five words here " * 4) for k in range(50)], "doc_id long, text string").coalesce(1)
    placed, _ = stage(backoff.blocks(docs, "doc_id", "text"), "blocks")
    dealt = backoff.own_counts(placed, 2, 3)
    found = dealt.collect()
    assert len({r.block for r in found}) == 1 and len(found) <= 3
    assert sum(len(r.hashes) for r in found) == 5 and sum(sum(r.own) for r in found) == 50 * 19
    counted = backoff.summed(dealt)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(part" in plan and "hashpartitioning(hash" not in plan
    assert sorted(c for r in counted.collect() for c in r.counts) == [150, 200, 200, 200, 200]


def test_shuffle_files_go_with_the_written_table(spark):
    seen = []
    write = lambda d: (seen.append(spark.conf.get(CLEANUP)), d)[1]
    table, _ = stage(spark.range(100).repartition(5, "id").transform(write), "tidy")
    assert table.count() == 100
    spark.conf.set(CLEANUP, "false")
    stage(spark.range(3), "tidy")
    assert spark.conf.get(CLEANUP) == "false"
    spark.conf.unset(CLEANUP)


def test_words_are_split_like_bytes():
    draw = random.Random(7)
    texts = ["".join(draw.choice(" \t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0 aé字\0") for _ in range(draw.randrange(30))) for _ in range(2000)]
    texts += [None, "", " ", "  a", "a  "]
    owner, words = backoff.split(pa.array(texts))
    wanted = [(k, w) for k, t in enumerate(texts) for w in (t or "").encode().split()]
    assert list(zip(owner.tolist(), words.cast(pa.binary()).to_pylist(), strict=True)) == wanted
    hashes = backoff.Words(pa.array(texts), Windows()).hash.tolist()
    assert hashes == WordHashes().of([w for _, w in wanted]).tolist()


def test_each_different_feature_is_hashed_once(monkeypatch):
    words = ["straße", "a", "ab", "abc", "toxictoxic", "toxicologist", "日本語日本語", "x" * 40]
    plain = {w: [f"^{w}$", *(f"^{w}$"[i : i + 5] for i in range(len(w) - 2))] for w in words}
    weights = np.zeros(segments.BUCKETS, dtype=np.float32)
    for gain, feature in ((1.5, "^toxi"), (2.5, "olog"), (0.5, "ologi"), (3.0, "^日本語日"), (1.0, "^ab$")):
        weights[segments.bucket_of(feature)] = gain
    wanted = {w: float(max(weights[segments.bucket_of(f)] for f in own)) for w, own in plain.items()}
    asked = []
    hashed = segments.bucket_of
    monkeypatch.setattr(segments, "bucket_of", lambda feature: (asked.append(feature), hashed(feature))[1])
    model = segments.Model(weights)
    texts = [words, [], words[::-1], ["abc", "toxicologist", "abc"]]
    for said, (at, gain) in zip(texts, model.scoring_words(texts), strict=True):
        assert dict(zip(at, gain)) == {i: wanted[w] for i, w in enumerate(said) if wanted[w]}
    known = segments.Buckets()
    known.learn(texts)
    assert {w: sorted(known[w]) for w in words} == {w: sorted(map(hashed, own)) for w, own in plain.items()}
    assert len(asked) <= 2 * len({f for own in plain.values() for f in own}) + 2 * len(words)
