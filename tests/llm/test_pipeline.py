"""The pipeline's stages one after another against plain versions, and the registered queries on the smallest tables."""

from __future__ import annotations

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from loreloom.llm import queries, segments
from tests import oracle
from tests.llm import brute
from tests.llm.test_operators import corpus, vocabulary

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, vocab = random.Random(11), vocabulary(500, 7)
    docs = dict(corpus(5, 120))
    item = " ".join(rng.choice(vocab) for _ in range(30))
    for k in range(6):
        docs[1000 + k] = " ".join([*(rng.choice(vocab) for _ in range(40)), item.upper() if k % 2 else item, *(rng.choice(vocab) for _ in range(15))])
    labels = []
    for k in range(400):
        bad = k % 5 == 0
        words = [rng.choice(vocab) for _ in range(60)]
        if bad:
            words[10:10] = ["scumword", "vilething"] * 3
        docs[2000 + k] = " ".join(words)
        labels.append((2000 + k, 0, int(bad)))
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, item


def test_stages_against_plain_versions(spark, tables, tmp_path):
    folder, docs, item = tables
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    model = segments.fit(frame, spark.read.parquet(f"{folder}/labels.parquet"))
    toxic = {
        i for i, t in docs.items()
        if model.probability(math.fsum(p[0] for p in model.passages((t or "").encode())[1])) >= 0.5
    }
    assert {2000 + k for k in range(0, 400, 5)} <= toxic and len(toxic) <= 82
    left = {i: t for i, t in docs.items() if i not in toxic}
    want = [dict(left)]
    first: dict = {}
    for i in sorted(left):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", left[i] or ""), i)
    left = {i: t for i, t in left.items() if i in set(first.values())}
    want.append(dict(left))
    near = brute.near(list(left.items()), 5)
    left = {i: left[i] for i, _, _, kept in near if kept}
    want.append(dict(left))
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    left = {i: t for i, t in left.items() if plain(item) not in plain(t)}
    want.append(dict(left))

    read = frame
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = str(tmp_path / name)
        stage(spark, read, folder).write.parquet(out)
        read = spark.read.parquet(out)
        assert read.columns == frame.columns
        assert {r.doc_id: r.text for r in read.collect()} == want[number], name
    packed = corpus_pipeline.STAGES[-1][1](spark, read, folder).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = Counter()
    for i, t in left.items():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            pieces[(i, piece, zlib.crc32(np.array(ids[start : start + 4096], dtype="<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in packed) == pieces
    assert len({r.sequence_id for r in packed}) <= brute.bins_needed([r.length for r in packed], 4096) + 1
    assert corpus_pipeline.run(spark, folder).count() == len(packed)


@pytest.fixture(scope="module")
def db():
    return oracle.connect(SF_DIR)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.registry.sql))
def test_query_against_sql(spark, db, name):
    verdict, _, rows = oracle.compare(spark, SF_DIR, queries.registry.queries[name], queries.registry.sql[name], db)
    assert verdict == "ok" and rows > 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the test tables")
def test_queries_against_plain_versions(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    q = queries.registry.queries
    assert sorted(map(tuple, q["op2_hyperminhash"](spark, SF_DIR).collect())) == brute.near(docs, 4)
    assert sorted(map(tuple, q["op4_debruijn_substrings"](spark, SF_DIR).collect()), key=repr) == brute.repeats(docs, 50)
    secrets = {r.doc_id: tuple(r)[1:5] for r in q["op3_secret_ownership"](spark, SF_DIR).collect()}
    assert secrets == {i: brute.secrets(t) for i, t in docs}
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    plain = lambda t: f" {' '.join(re.findall(r'[^\W_]+', t.lower()))} "
    want = {(i, k) for i, t in docs for k, u in items if plain(u) in plain(t)}
    assert {(r.doc_id, r.item_id) for r in q["op6_spaced_seeds"](spark, SF_DIR).collect()} == want
    scored = q["op7_toxic_segments"](spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in scored) == sorted(i for i, _ in docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in scored)
    packed = q["op8_best_fit"](spark, SF_DIR).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in docs} and max(r.offset + r.length for r in packed) <= 4096
