"""Findings on disk and CPU: shingles counted by slices of the hash range, and what the encoder remembers."""

from __future__ import annotations

from collections import Counter

import numpy as np
import public_tokenizers

from loreloom.llm import hyperminhash, packing
from loreloom.llm.words import Windows, signed


def test_slices_hold_every_shingle_once():
    elements = np.random.default_rng(3).integers(0, 1 << 63, 1000).astype(np.uint64)
    nodes = np.repeat(np.arange(10), 100)
    batch = hyperminhash._sliced(nodes, elements, 7).to_pydict()
    found = [(n, e) for ns, es in zip(batch["nodes"], batch["shingles"]) for n, e in zip(ns, es, strict=True)]
    assert batch["slice"] == sorted(set(batch["slice"])) and Counter(found) == Counter(zip(nodes.tolist(), signed(elements).tolist()))
    assert hyperminhash._sliced(nodes[:0], elements[:0], 7).num_rows == 0


def test_shingles_are_not_dealt_as_rows(spark):
    texts = [(k, " ".join(f"w{(7 * k * j) % 23}" for j in range(30 + k))) for k in range(40)] + [(90, None), (91, "one")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    nodes = docs.where("doc_id <> 3").select(docs.doc_id.alias("node"))
    counted = hyperminhash._alone_counts(nodes, docs, "doc_id", "text", 4)
    cache, windows = hyperminhash.Hashes(), Windows()
    sets = {k: set(hyperminhash.shingles((t or "").encode().split(), 4, cache, windows).tolist()) for k, t in texts if k != 3}
    owners = Counter(e for s in sets.values() for e in s)
    assert {r.node: r.alone for r in counted.collect()} == {k: sum(owners[e] == 1 for e in s) for k, s in sets.items()}
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(slice" in plan and "hashpartitioning(shingle" not in plan


def test_what_the_encoder_remembers_is_a_matter_of_time_only():
    path = public_tokenizers.path("word_bpe_49k.json")
    parts = "word Word WORD, straße Éa. a1b don't x, , ,, .. Z; naïve: 日本語 zebra! zebra!? ΑΣ é, I'm l'été Qwrtx".split()
    for remembered in (2, 1000):
        encoder = packing.encoder_of(path, remembered)
        assert encoder.limit == remembered
        for part in parts * 2:
            assert encoder.encode(part.encode()).tolist() == encoder.tokenizer.encode(part, add_special_tokens=False).ids, part
        assert len(encoder) <= remembered
    packing._ENCODERS.clear()
