import math
import random
import re
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from loreloom.functions import text as tx
from loreloom.operators import evaluate as ev
from loreloom.operators import index as ix
from loreloom.operators import retrieve as rt

WORDS = ["bomb", "heart", "the", "angel", "devil", "room", "café", "key", "妈妈的菜刀", "12"]


def chunks(spark, rows):
    names = "chunk_id, entity_type, entity_id, name_zh, name_en, title, text, stale"
    data = [
        {
            "chunk_id": c, "document_id": c.split("#")[0], "entity_type": t, "entity_id": e, "name_zh": zh, "name_en": en,
            "aliases": aliases, "title": title, "text": text, "game_version": "1", "content_version": "1", "stale": stale,
            "source": {"id": "s-" + c, "title": "t", "url": "https://x", "canonical_url": None, "type": kind},
        }
        for c, t, e, zh, en, aliases, title, text, kind, stale in rows
    ]
    schema = (
        "chunk_id string, document_id string, entity_type string, entity_id string, name_zh string, name_en string, "
        "aliases array<string>, title string, text string, game_version string, content_version string, stale boolean, "
        "source struct<id:string,title:string,url:string,canonical_url:string,type:string>"
    )
    assert names
    return spark.createDataFrame(data, schema)


def small_corpus(spark):
    return chunks(
        spark,
        [
            ("i118#1", "item", "collectible:118", "硫磺火", "Brimstone", ["blood laser"], "硫磺火", "Charge a blood laser beam", "wiki", False),
            ("i118#2", "item", "collectible:118", "硫磺火", "Brimstone", ["blood laser"], "notes", "Synergy with soy milk and laser", "wiki", False),
            ("i118#3", "item", "collectible:118", "硫磺火", "Brimstone", ["blood laser"], "more", "laser laser laser", "wiki", False),
            ("t1#1", "trinket", "trinket:1", "饰品一", "Swallowed Penny", [], "penny", "Drops a coin when hurt", "wiki", False),
            ("r1#1", "room", "wiki-room:9", "恶魔房", "Devil Room", [], "devil", "Trade hearts for items", "curated", False),
            ("old#1", "item", "collectible:7", "旧道具", "Old Thing", [], "old", "laser from an old version", "wiki", True),
        ],
    )


def queries(spark, rows):
    return spark.createDataFrame(rows, "query_id string, query string")


def search(spark, rows, **options):
    index = ix.build_keyword_index(small_corpus(spark))
    hits = rt.hybrid_search(queries(spark, rows), index, **options)
    found = {}
    for r in sorted(hits.collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r)
    return found


def test_exact_id_alias_and_no_answer(spark):
    found = search(
        spark,
        [
            ("number", "118"), ("typed", "collectible:118"), ("alias", "Blood-Laser"), ("zh", "硫磺火"), ("missing id", "collectible:999"),
            ("scope", "fiend folio items"), ("contained", "how strong is Brimstone today"), ("lexical", "drops coin"), ("blank", "  "),
            ("stale", "old thing"),
        ],
    )
    for name in ("number", "typed", "alias", "zh"):
        assert [r["entity_id"] for r in found[name]] == ["collectible:118"] * 2, name
        assert found[name][0]["score"] == 1.0 and found[name][0]["methods"] == ["exact"]
    for name in ("missing id", "scope", "blank"):
        assert name not in found
    assert found["contained"][0]["exact"] == min(0.99, 0.80 + 0.19 * 9 / len("howstrongisbrimstonetoday"))
    assert found["lexical"][0]["chunk_id"] == "t1#1" and found["lexical"][0]["score"] == 0.65
    assert all(not r["stale"] for rows in found.values() for r in rows)


def test_filters(spark):
    index = ix.build_keyword_index(small_corpus(spark))
    asked = spark.createDataFrame(
        [("a", "laser", ["trinket"], None), ("b", "hearts", None, ["curated"]), ("c", "hearts", None, ["wiki"])],
        "query_id string, query string, entity_types array<string>, source_types array<string>",
    )
    got = {r["query_id"]: r["chunk_id"] for r in rt.hybrid_search(asked, index).collect()}
    assert got == {"b": "r1#1"}


def model_tokens(text):
    text = unicodedata.normalize("NFD", text.lower())
    text = "".join(ch for ch in text if not unicodedata.combining(ch))
    return re.findall(r"[^\W_]+", text)


def model_bm25(docs, query):
    bodies = {k: model_tokens(v) for k, v in docs.items()}
    n, avgdl = len(bodies), sum(map(len, bodies.values())) / len(bodies)
    cleaned = re.sub(r"[\"'():*^]", " ", query.casefold()).strip()
    terms = []
    for t in [cleaned, *re.findall(r"[0-9a-z]+|[㐀-鿿]{2,}", cleaned)]:
        if t.strip() and t.strip() not in terms:
            terms.append(t.strip())
    scores = {}
    for term in terms[:8]:
        phrase = model_tokens(term)
        if not phrase:
            continue
        tf = {
            k: sum(b[i : i + len(phrase)] == phrase for i in range(len(b) - len(phrase) + 1)) for k, b in bodies.items()
        }
        df = sum(v > 0 for v in tf.values())
        idf = math.log((n - df + 0.5) / (df + 0.5)) if df else 0
        idf = idf if idf > 0 else 1e-6
        for k, f in tf.items():
            if f:
                dl = len(bodies[k])
                scores[k] = scores.get(k, 0) + idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))
    return {k: round(v, 6) for k, v in scores.items()}


def test_bm25_matches_model(spark):
    rng = random.Random(5)
    docs = {i: " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 25))) for i in range(40)}
    docs[40] = "key key key key"
    asked = {100 + i: " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4))) for i in range(12)}
    asked[200] = "key key"
    asked[201] = "Café, the: \"devil\" room!"
    fields = ix.with_length(
        spark.createDataFrame(list(docs.items()), "chunk_id long, text string").select(
            "chunk_id", tx.search_text(F.col("text")).alias("body")
        )
    )
    q = spark.createDataFrame(list(asked.items()), "query_id long, query string")
    for posts in (None, ix.postings(fields)):
        got = {}
        for r in rt.bm25_scores(q, fields, posts).collect():
            got.setdefault(r["query_id"], {})[r["chunk_id"]] = round(r["score"], 6)
        want = {k: s for k, s in ((k, model_bm25(docs, v)) for k, v in asked.items()) if s}
        assert got == want


def test_vector_search_matches_numpy_in_blocks(spark):
    rng = np.random.default_rng(3)
    data, asked = rng.normal(size=(200, 8)), rng.normal(size=(11, 8))
    schema = "chunk_id long, embedding array<float>"
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], schema).repartition(5)
    q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(asked)], "query_id long, embedding array<float>")
    data32 = data.astype(np.float32).astype(float)
    asked32 = asked.astype(np.float32).astype(float)
    sims = (data32 / np.linalg.norm(data32, axis=1, keepdims=True)) @ (asked32 / np.linalg.norm(asked32, axis=1, keepdims=True)).T
    for block in (4096, 4):
        got = {}
        for r in rt.vector_candidates(q, vectors, 7, pack_rows=block).collect():
            got.setdefault(r["query_id"], set()).add(r["chunk_id"])
        for j in range(len(asked)):
            assert got[j] == set(np.argsort(-sims[:, j])[:7].tolist())


def test_fusion_bonus_and_floors(spark):
    rows = [
        ("q", "a", "exact", 0.99), ("q", "a", "bm25", 1.0), ("q", "b", "vector", 0.5), ("q", "c", "vector", 0.9),
        ("q", "d", "bm25", 0.1), ("q", "e", "bm25", 0.5), ("q", "e", "vector", 0.4), ("q", "e", "vector", 0.3),
    ]
    df = spark.createDataFrame(rows, "query_id string, chunk_id string, method string, value double")
    got = {r["chunk_id"]: (r["score"], r["methods"]) for r in rt.fuse(df).collect()}
    assert got == {"a": (1.0, ["exact", "bm25"]), "c": (0.54, ["vector"]), "e": (0.375, ["bm25", "vector"])}


def test_vectors_join_the_search(spark):
    index = ix.build_keyword_index(small_corpus(spark))

    def encode(texts):
        return np.array([[t.lower().count("coin") + t.lower().count("money"), 1.0, "laser" in t.lower()] for t in texts])

    vectors = ix.build_vectors(index.chunks, encode)
    assert ix.id_mismatch(index.chunks, vectors).count() == 0
    asked = queries(spark, [("q", "money when hurt")])
    embedded = ix.embed(asked, encode, "query_id", F.col("query"))
    found = rt.hybrid_search(asked, index, vectors=vectors, query_vectors=embedded)
    hits = found.orderBy("rank").collect()
    assert hits[0]["chunk_id"] == "t1#1" and hits[0]["methods"] == ["bm25", "vector"]
    flags = rt.answer_flags(asked, found, True).first()
    assert not flags["no_answer"] and not flags["degraded"]


def test_vector_table_checks(spark):
    df = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [1.0])], "chunk_id string, embedding array<float>")
    assert [r["chunk_id"] for r in ix.check_vectors(df, 2).collect()] == ["b"]
    assert ix.check_vectors(df, 2, 3).count() == 2
    good = ix.convert_vectors(df.where("chunk_id = 'a'"), 2, 1).first()
    assert [round(x, 3) for x in good["embedding"]] == [0.6, 0.8]


def test_order_statistics(spark):
    rng = random.Random(1)
    for n in (1, 2, 19, 20, 21, 200):
        values = [round(rng.uniform(-50, 900), 2) for _ in range(n)] + ([7.0] * n)
        df = spark.createDataFrame([("k", v) for v in values], "k string, v double")
        got = ev.order_statistics(
            df, ["k"], "v", {"a": (ev.ceil_rank, 0.5), "b": (ev.ceil_rank, 0.95), "c": (ev.floor_rank, 0.95)}
        ).first()
        ordered = sorted(values)
        m = len(ordered)
        assert got["a"] == ordered[max(0, min(m - 1, math.ceil(0.5 * m) - 1))]
        assert got["b"] == ordered[max(0, min(m - 1, math.ceil(0.95 * m) - 1))]
        assert got["c"] == ordered[max(0, min(m - 1, int(m * 0.95) - 1))]


def test_evaluation_report(spark):
    cases = spark.createDataFrame(
        [("a", ["x"], ["s1"], False), ("b", ["y"], ["s2"], False), ("n", [], [], True)],
        "query_id string, expected_entities array<string>, expected_sources array<string>, expect_no_answer boolean",
    )
    hits = spark.createDataFrame(
        [("a", 1, "x", "s1"), ("b", 1, "z", "s2"), ("b", 2, "y", "s9")], "query_id string, rank int, entity_id string, source_id string"
    )
    scored = ev.score_cases(cases, hits)
    assert {r["query_id"]: (r["recall"], r["rr"]) for r in scored.collect()} == {"a": (1.0, 1.0), "b": (1.0, 0.5), "n": (1.0, 1.0)}
    report = ev.evaluate(scored, {"recall_at_k": 0.9, "mrr": 0.8, "no_answer_accuracy": 1.0}, "keyword").first()
    assert report["passed"] and round(report["mrr"], 4) == 0.8333
