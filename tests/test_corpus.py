"""End-to-end corpus build on a small snapshot, and its single steps."""

import dataclasses
import json
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from loreloom.functions import text as tx
from loreloom.operators import audit as au, index as ix, publish as pb, redirects as rd, retrieve as rt, sections as sc
from loreloom.operators import structured as sd, validate as va
from loreloom.plans import corpus as co
from loreloom.sources import files as fl


def page(page_id, title, text, namespace=0, redirect=False, **changes):
    record = {
        "schema_version": 1, "document_id": f"w:page:{page_id}:rev:{page_id + 100}", "namespace": namespace, "page_id": page_id,
        "revision_id": page_id + 100, "parent_revision_id": None, "revision_sha1": "a", "revision_timestamp": "2026-01-01T00:00:00Z",
        "retrieved_at": "2026-02-03T00:00:00Z", "title": title, "redirect": redirect, "stale": False, "content_model": "wikitext",
        "wikitext": text, "content_checksum": "sha256:" + sha256(text.encode()).hexdigest(), "source_url": f"https://w/{page_id}",
        "revision_url": f"https://w/{page_id}?oldid=1", "source_title": "W " + title, "source_type": "wiki", "license_note": "l",
        "authorization_ref": "a",
    }
    return {**record, **changes}


def tabular(fields, data):
    return json.dumps({"schema": {"fields": [{"name": f} for f in fields]}, "data": data}, ensure_ascii=False)


ROOM = {
    "_type": "ROOM_STB", "_file": "01.basement.stb", "_i": "7", "variant": 3, "name": "", "type": 1, "subtype": 0, "shape": 1,
    "width": 13, "height": 7, "difficulty": 5, "weight": 1.0, "doors": [{"x": 0, "y": 4, "exists": True}, {"x": 1, "y": 1, "exists": False}],
    "spawns": [{"x": 1, "y": 1, "entity": [{"type": 5, "variant": 100, "subtype": 0, "weight": 1.0}]}],
}


def snapshot():
    item = (
        "{{Infobox item|名称=硫磺火|id=118}}\n'''硫磺火'''是一个主动发射激光的道具。{{en|Brimstone}}\n"
        "== 效果 ==\n* 蓄力后发射一道[[血激光|血色激光]]，造成大量伤害。<ref>note</ref>\n== 画廊 ==\n[[File:a.png]] 图片说明文字很长很长很长\n"
    )
    return [
        page(1, "C118", item),
        page(2, "硫磺火", "#REDIRECT [[C118]]", redirect=True),
        page(3, "Brim", "#重定向 [[硫磺火]]", redirect=True),
        page(4, "Lost", "#redirect [[Nowhere]]", redirect=True),
        page(5, "LoopA", "#redirect [[LoopB]]", redirect=True),
        page(6, "LoopB", "#redirect [[LoopA]]", redirect=True),
        page(7, "怪物", "这个敌人会掉落硫磺火，出现在第二层之后的房间里面。"),
        page(8, "模板:Infobox item", "{{#invoke:EntityQuery|main}} Data:Item.tabx\nData:Missing.tabx", 10),
        page(9, "模板:ItemSummary", "text {{nav}}", 10),
        page(10, "模块:EntityQuery", "-- c\nlocal t = { ['a'] = 'x', [\"b\"] = 3, ['c'] = true } -- ['d'] = 'no'", 828),
        page(11, "Data:Item.tabx", tabular(
            ["page", "namezh", "nameen", "desczh", "descen", "namelist", "id", "type", "effect", "source"],
            [["C118", "硫磺火", "Brimstone", "血激光", "Blood laser", "妈妈的激光;brim", 118, "active", None, "Rebirth"]]), 3500),
        page(12, "Data:ItemKeywords.tabx", tabular(["page", "name_alias", "PinyinIndex", "colors"], [["C118", "old", "x", ""], ["C118", "大硫磺", "lhh", "red"]]), 3500),
        page(13, "Data:Entity.tabx", tabular(
            ["page", "namezh", "nameen", "type", "variant", "subtype", "tag", "tips", "hp", "stagehp", "shieldstrength", "collisionDamage", "source"],
            [["P", "苍蝇", "Fly", 13, 0, 0, "", "", 3, -1, None, 1, "R"], ["P", "红苍蝇", "Red Fly", 13, 0, 0, "", "", 5, -1, None, 1, "R"]]), 3500),
        page(14, "Data:Rooms/basement/7", json.dumps(ROOM), 3500, content_model="json"),
        page(15, "Data:Rooms/noise", json.dumps({"_type": "OTHER"}), 3500, content_model="json"),
    ]


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("snapshot") / "pages.jsonl"
    path.write_text("\n\n".join(json.dumps(r, ensure_ascii=False) for r in snapshot()) + "\n", encoding="utf-8")
    return fl.read_pages(spark, str(path))


@pytest.fixture(scope="module")
def built(raw):
    return co.build_corpus(raw)


def test_build_counts(built):
    totals = co.manifest_totals(built)
    expected = {
        "raw_records": 15, "redirects": 5, "redirect_resolved": 2, "redirect_broken": 1, "redirect_cycles": 2,
        "data_chunk_count": 4, "room_layout_count": 1, "fact_count": 3, "skipped_data_pages": 1, "skipped_data_pages_published": 2,
    }
    assert {k: totals[k] for k in expected} == expected


def test_chunks(built):
    rows = {r["chunk_id"]: r for r in built.chunks.collect()}
    prose = [r for r in rows.values() if r["page_id"] == 1]
    assert {r["entity_id"] for r in prose} == {"collectible:118"}
    assert all("图片" not in r["text"] and "note" not in r["text"] for r in prose)
    effect = [r for r in prose if r["section_path"] == ["效果"]][0]
    assert effect["text"] == "蓄力后发射一道血色激光，造成大量伤害。"
    assert effect["chunk_id"].startswith("wiki:page:1#sec:") and effect["chunk_id"].endswith(":01")
    assert {s["title"] for s in effect["redirect_sources"]} == {"硫磺火", "Brim"}
    assert "硫磺火" in effect["aliases"] and effect["acquired_on"] == "2026-02-03"
    enemy = [r for r in rows.values() if r["page_id"] == 7][0]
    assert enemy["entity_id"] == "wiki-page:7"
    item = rows["wiki:data:11:row:C118#structured:01"]
    assert item["entity_id"] == "collectible:118" and "大硫磺" in item["aliases"] and "old" not in item["aliases"]
    assert item["text"] == "名称：硫磺火；英文名：Brimstone；实体类型：收藏品；稳定 ID：collectible:118；中文短描述：血激光；英文短描述：Blood laser；游戏来源版本：Rebirth。"
    flies = [r for r in rows.values() if r["entity_id"] == "game-entity:13.0.0"]
    assert len(flies) == 2 and all(r["source_conflict"] and r["conflict_key"] == "13.0.0" for r in flies)
    room = [r for r in rows.values() if r["entity_type"] == "room_layout"][0]
    assert "(0,4)" in room["text"] and "5.100.0×1" in room["text"] and "(1,1)" not in room["text"]
    assert room["entity_id"] == "room-layout:" + sha256(b"01.basement.stb/1/3/0/7").hexdigest()[:20]


def test_entities(built):
    merged = {r["entity_id"]: r for r in built.entities.collect()}
    assert merged["collectible:118"]["name_en"] == "Brimstone" and merged["collectible:118"]["entity_type"] == "item"
    documents = {r["document_id"] for r in built.entity_documents.collect() if r["entity_id"] == "collectible:118"}
    assert documents == {"wiki:page:1", "wiki:data:11:row:C118"}


def test_dependencies_and_audit(built):
    uses = {(r["kind"], r["name"]): r["uses"] for r in sc.dependency_counts(built.dependencies).collect()}
    assert uses[("module", "EntityQuery")] == 1 and uses[("data", "Data:Missing.tabx")] == 1
    assert uses[("template", "Infobox item")] == 1
    assert [r["name"] for r in au.missing_data_pages(built.dependencies, built.pages).collect()] == ["Data:Missing.tabx"]
    assert au.unresolved_modules(built.dependencies, built.pages).count() == 0
    absent = {r["title"] for r in au.missing_required_pages(built.pages.sparkSession, built.pages).collect()}
    assert absent == {"模块:Rooms", "模块:AchievementQuery", "模块:CostumeQuery"}


def test_publish_twice_gives_equal_checksum(spark, raw, built, tmp_path):
    first = co.publish(built, str(tmp_path / "out"), source_checksum="s1")
    second = co.publish(co.build_corpus(raw.repartition(5)), str(tmp_path / "out"), source_checksum="s1")
    assert first["corpus_checksum"] == second["corpus_checksum"]
    assert pb.read_published(spark, str(tmp_path / "out"), "chunks").count() == first["chunk_count"]
    assert not pb.needs_build(spark, str(tmp_path / "out"), "s1") and pb.needs_build(spark, str(tmp_path / "out"), "s2")
    assert pb.needs_build(spark, str(tmp_path / "none"), "s1")


def test_publish_leaves_open_readers_alone(spark, built, tmp_path):
    """Equal chunks with another side table give a new version; who opened the old one still reads it."""
    out = str(tmp_path / "out")
    first = co.publish(built, out)
    reader = pb.read_published(spark, out, "entities")
    before = reader.count()
    changed = dataclasses.replace(built, entities=built.entities.limit(1))
    second = co.publish(changed, out)
    assert second["corpus_checksum"] == first["corpus_checksum"] and second["content_checksum"] != first["content_checksum"]
    assert second["version"] != first["version"] and pb.current_version(spark, out) == second["version"]
    assert reader.count() == before and pb.read_published(spark, out, "entities").count() == 1

    def refuse(folder):
        raise ValueError(folder)

    with pytest.raises(ValueError):
        pb.publish_corpus({"chunks": built.chunks}, out, {}, check=refuse)
    assert pb.current_version(spark, out) == second["version"]


def test_nothing_is_lost_silently(spark, tmp_path):
    item = ["page", "namezh", "nameen"]
    rows = [
        page(1, "A", "some text that is long enough"), page(2, "B", "x", schema_version=2),
        page(3, "C", "first long enough text here"), page(4, "c", "second long enough text here"),
        page(5, "Data:Item.tabx", tabular(item, [["C118", "a", "b"], ["X1", "a", "b"], ["C7", "a"]]), namespace=3500),
        page(6, "Data:Entity.tabx", tabular(["type", "variant", "subtype", "namezh"], [["1", "2", "x", "n"], ["1", "2", "3", "n"]]), namespace=3500),
        page(7, "Data:Rooms/a.json", "{broken", namespace=3500), page(8, "Data:Rooms/b.json", '{"_type":"ROOM_STB","type":"1"}', namespace=3500),
        page(9, "Data:ItemKeywords.tabx", "{}", namespace=3500),
    ]
    path = tmp_path / "pages.jsonl"
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    raw = fl.read_pages(spark, str(path))
    found = {tuple(r) for r in co.build_corpus(raw, strict=False).violations.select("rule", "title", "row_no").collect()}
    assert found == {
        ("schema_version", "B", None), ("title_key", "C", None), ("item code", "Data:Item.tabx", 2), ("arity", "Data:Item.tabx", 3),
        ("entity identity", "Data:Entity.tabx", 1), ("room json", "Data:Rooms/a.json", None), ("room identity", "Data:Rooms/b.json", None),
        ("table", "Data:ItemKeywords.tabx", None),
    }
    with pytest.raises(va.RuleError):
        co.build_corpus(raw, strict=True)


def test_search_the_built_corpus(spark, built):
    index = ix.build_keyword_index(built.chunks)
    asked = spark.createDataFrame([("a", "C118"), ("b", "C118 为什么"), ("c", "Brim")], "query_id string, query string")
    hits = rt.hybrid_search(asked, index).collect()
    best = {r["query_id"]: r["entity_id"] for r in hits if r["rank"] == 1}
    assert best["a"] == best["c"] == "collectible:118"


def test_bad_records_are_reported(spark, tmp_path):
    good = page(1, "A", "text")
    bad = [
        page(2, "B", "text", namespace=7), page(3, "C", "text", content_checksum="sha256:0"), page(4, "D", "text", source_url="http://x"),
        page(5, "E", "no target", redirect=True), {**page(6, "F", "text"), "page_id": True}, page(7, "G", "text", schema_version=2),
        page(8, "H", "text", content_model=""), page(9, "I", "text", stale="no"),
    ]
    path = tmp_path / "p.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in [good, *bad]) + "\n{broken\n")
    kept, rejected = va.validate_pages(fl.read_pages(spark, str(path)))
    assert [r["title"] for r in kept.collect()] == ["A"]
    rules = {r["title"]: set(r["violations"]) for r in rejected.collect()}
    assert rules["B"] == {"namespace"} and rules["C"] == {"checksum"} and rules["D"] == {"https"} and rules["E"] == {"redirect_target"}
    assert "ids" in rules["F"] and rules["G"] == {"schema_version"} and rules["H"] == {"content_model"} and "booleans" in rules["I"]
    assert len(rules) == 9
    with pytest.raises(va.RuleError):
        va.validate_pages(fl.read_pages(spark, str(path)), strict=True)
    twice = kept.unionByName(kept)
    assert {r["rule"] for r in va.page_key_violations(twice).collect()} == {"page_revision", "title_key"}


def test_title_keys_and_redirect_targets(spark):
    cases = {" foo__bar ": "Foo bar", "data:item": "data:Item", "": "", "模板:x": "模板:X", "Boss": "Boss", "straße": "Straße"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", tx.title_key(F.col("t")).alias("k"))
    assert {r["t"]: r["k"] for r in df.collect()} == cases
    texts = {"#REDIRECT [[A|b]]": "A", "  #重定向：[[ B #x]]": None, "#重定向:‎[[B#x]]": "B", "text [[A]]": None, "#redirect [[C D]]": "C D"}
    df = spark.createDataFrame([(k,) for k in texts], "t string").select("t", tx.redirect_target(F.col("t")).alias("k"))
    assert {r["t"]: r["k"] for r in df.collect()} == texts


def test_long_redirect_chain_and_tail_into_cycle(spark):
    edges = [(f"k{i}", f"k{i + 1}") for i in range(21)] + [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("self", "self"), ("x", "gone"), ("y", "x")]
    edges += [(f"t{i}", f"t{i + 1}") for i in range(9)] + [("t9", "self"), ("u", "t4")]
    mapping = spark.createDataFrame(edges, "source_key string, target_key string")
    closed = rd.close_redirects(mapping, spark.createDataFrame([("k21",), ("y",)], "title_key string"))
    rows = {r["source_key"]: r for r in closed.collect()}
    target = dict(edges)
    assert set(rows) == set(target)
    chains = {}
    for r in rd.redirect_chains(mapping, closed).collect():
        chains.setdefault(r["source_key"], {})[r["step"]] = r["key"]
    for source in target:
        walk = [source]
        while walk[-1] in target and walk[-1] not in walk[:-1]:
            walk.append(target[walk[-1]])
        status = "resolved" if walk[-1] == "k21" else "cycle" if walk[-1] in walk[:-1] else "broken"
        assert (rows[source]["status"], rows[source]["steps"]) == (status, len(walk) - 1)
        assert rows[source]["final_key"] == ("k21" if status == "resolved" else None)
        assert chains[source] == dict(enumerate(walk))


def test_closure_of_a_path_of_100000_and_a_cycle_of_10000(spark):
    """No row grows with the chain: rounds go with the chain's number of bits."""
    path = spark.range(100_000).selectExpr("concat('p', id) AS source_key", "concat('p', id + 1) AS target_key")
    ring = spark.range(10_000).selectExpr("concat('c', id) AS source_key", "concat('c', (id + 1) % 10000) AS target_key")
    mapping = path.unionByName(ring)
    closed = rd.close_redirects(mapping, spark.createDataFrame([("p100000",)], "title_key string"))
    assert "chain" not in closed.columns
    found = {r["status"]: (r["n"], r["low"], r["high"], r["total"]) for r in closed.groupBy("status").agg(
        F.count("*").alias("n"), F.min("steps").alias("low"), F.max("steps").alias("high"), F.sum("steps").alias("total")
    ).collect()}
    assert found == {"resolved": (100_000, 1, 100_000, 5_000_050_000), "cycle": (10_000, 10_000, 10_000, 100_000_000)}
    chain = rd.redirect_chains(mapping, closed.where("source_key IN ('p0', 'c7')")).groupBy("source_key").agg(
        F.count("*").alias("n"), F.countDistinct("key").alias("keys"), F.max_by("key", "step").alias("last")
    )
    assert {tuple(r) for r in chain.collect()} == {("p0", 100_001, 100_001, "p100000"), ("c7", 10_001, 10_000, "c7")}


def test_snapshot_audit(raw):
    needs = {
        "required_exact_titles": ["Data:Item.tabx", "Data:Gone.tabx"], "expected_dependency_titles": ["Data:Later.json"],
        "required_tabular_tables": {"Data:Item.tabx": {"minimum_rows": 2, "required_fields": ["page", "quality"]}},
        "room_title_prefix": "Data:Rooms/", "minimum_room_pages": 2, "minimum_room_stb_pages": 1, "minimum_distinct_room_files": 1,
        "required_room_fields": ["doors", "grid"],
    }
    data = raw.where("namespace = 3500")
    report = au.audit_snapshot(data, needs)
    assert report["status"] == "incomplete" and report["room_pages"] == 2 and report["room_layout_pages"] == 1
    assert report["missing_required_titles"] == ["Data:Gone.tabx"] and report["room_records_missing_fields"] == {"grid": 1}
    assert len(report["coverage_failures"]) == 3
    ready = {**needs, "required_exact_titles": ["Data:Item.tabx"], "required_tabular_tables": {}, "required_room_fields": ["doors"]}
    assert au.audit_snapshot(data, ready)["status"] == "ready"
    good, bad = va.validate_snapshot(raw, 3500)
    assert good.count() == 5 and bad.count() == 10


def test_markup_rendering(spark):
    def tree_of(text, title="T"):
        page = spark.createDataFrame([(text, title)], "markup string, title string")
        return sc.sections(page, F.col("markup"), F.col("title")).orderBy("section_no", "block_no").collect()

    def blocks(text, title="T"):
        return [r["block"] for r in tree_of(text, title)]

    assert blocks("{{n}} is {{item|Bomb|2}} and {{unknown|short}} {{quote|a}} {{dif|a|dlc=late|x}}") == ["T is Bomb and short late"]
    assert blocks("[[A|b]] [[C#d]] [https://x.y label] '''bold''' <span>s</span>&amp;") == ["b C label bold s &"]
    assert blocks("{{a|{{item|In}} side}}") == ["In side"]
    assert blocks("{{#invoke:Mod|f|x|k=v}}") == ["mod：x；k=v"]
    assert blocks("{{Infobox room|名称=房|other=1|id=5}}") == ["名称：房；id：5"]
    many = "".join("{{item|w%d}} " % i for i in range(45))
    assert blocks(many)[0].split() == [f"w{i}" for i in range(40)]
    tree = tree_of("lead text\n== A ==\none\n=== B ===\ntwo\n== Trivia ==\n=== C ===\nthree", "T")
    assert [s["section_path"] for s in tree] == [[], ["A"], ["A", "B"]]
    assert blocks("a\n\n" + "b" * 1000 + "\n\n" + "c" * 1000) == ["a\n" + "b" * 1000, "c" * 1000]
    long = "。".join("字" * 500 for _ in range(9)) + "。"
    assert [len(b) for b in blocks(long)] == [1503, 1503, 1503]


def test_tabular_and_bad_tables(spark):
    pages = spark.createDataFrame(
        [(1, tabular(["a", "b"], [["x", 1.50], [None, {"n": 1}], ["short"]])), (2, "{}"), (3, "no json")], "page_id int, wikitext string"
    )
    rows = sd.explode_tabular(pages).orderBy("row_no").collect()
    assert [(r["row_no"], r["arity_ok"]) for r in rows] == [(1, True), (2, True), (3, False)]
    assert rows[0]["fields"] == {"a": "x", "b": "1.5"} and rows[1]["fields"] == {"a": None, "b": None}
    assert sorted(r["page_id"] for r in sd.bad_tables(pages).collect()) == [2, 3]


def test_overrides_by_title_and_redirect(spark, raw, tmp_path):
    path = tmp_path / "o.json"
    entry = {"page_title": "none", "match_aliases": ["brim!"], "entity_type": "item", "entity_id": "collectible:9", "name_zh": "零", "name_en": "Zero", "aliases": ["zz"]}
    later = {**entry, "page_title": "C118", "entity_id": "collectible:10"}
    path.write_text(json.dumps({"schema_version": 1, "entities": [entry, later]}, ensure_ascii=False))
    corpus = co.build_corpus(raw, fl.read_overrides(spark, str(path)))
    ids = {r["entity_id"] for r in corpus.chunks.where("page_id = 1").collect()}
    assert ids == {"collectible:9"}


def test_curated_items_eval_and_responses(spark, tmp_path):
    doc = {"document_id": "d1", "entity_type": "item", "entity_id": "collectible:1", "name_zh": "一", "name_en": "One", "aliases": ["b", "A", "b"],
           "title": "T", "text": " two  words ", "source": {"id": "s", "title": "S", "url": "https://s", "type": "wiki"}}
    defaults = {"acquired_on": "2026-01-01", "game_version": "1", "license_note": "l", "content_version": "c", "stale": False}
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"schema_version": 1, "documents": [doc, {**doc, "document_id": "d2", "text": "other", "game_version": "2"}], "defaults": defaults}, ensure_ascii=False))
    chunks, _ = va.validate_curated(fl.read_curated(spark, str(path)))
    rows = {r["chunk_id"]: r for r in chunks.collect()}
    assert rows["d1#0001"]["text"] == "two words" and rows["d1#0001"]["aliases"] == ["A", "b"] and rows["d2#0001"]["game_version"] == "2"
    path.write_text(json.dumps({"schema_version": 1, "documents": [doc, doc], "defaults": defaults}, ensure_ascii=False))
    with pytest.raises(va.RuleError):
        va.validate_curated(fl.read_curated(spark, str(path)))
    cases = tmp_path / "e.json"
    cases.write_text(json.dumps({"eval_id": "e", "top_k": 5, "thresholds": {"mrr": 0.5}, "cases": [
        {"id": "x", "query": "q", "filters": {"entity_types": ["item"]}, "expected_entities": ["a"], "expected_sources": []},
        {"id": "y", "query": "z", "expected_entities": [], "expected_sources": [], "expect_no_answer": True}]}))
    rows, header = fl.read_eval(spark, str(cases))
    assert header["top_k"] == 5 and {r["query_id"]: r["expect_no_answer"] for r in rows.collect()} == {"x": False, "y": True}
    body = {"query": {"pages": [
        {"pageid": 2, "ns": 0, "title": "B", "redirect": "", "revisions": [{"revid": 5, "slots": {"main": {"content": "t"}}}]},
        {"pageid": 1, "ns": 0, "title": "A", "canonicalurl": "https://w/A", "revisions": [{"revid": 4, "slots": {"main": {"content": "u"}}}]},
        {"pageid": 3, "ns": 0, "title": "C"}]}}
    source = {"title_prefix": "W:", "source_type": "x", "license_note": "l", "authorization_ref": "a"}
    flat = fl.flatten_responses(spark.createDataFrame([(json.dumps(body),)], "value string"), "2026-01-01T00:00:00Z", source).collect()
    assert [(r["page_id"], r["redirect"], r["revision_id"]) for r in flat] == [(1, False, 4), (2, True, 5)]


def test_pack_manifest(spark, tmp_path):
    folder = tmp_path / "pack"
    folder.mkdir()
    (folder / "a.bin").write_bytes(b"abc")
    (folder / "b.bin").write_bytes(b"abd")
    digest = sha256(b"abc").hexdigest()
    rows = [("a.bin", 3, digest, True, "keyword"), ("b.bin", 3, digest, True, "vector"), ("c.bin", 1, digest, True, "x"),
            ("../d", 1, digest, False, "x"), ("e.bin", 1, "nothex", False, " ")]
    manifest = spark.createDataFrame(rows, "path string, size bigint, sha256 string, required boolean, role string")
    found = {(r["path"], r["rule"]) for r in au.audit_manifest(fl.read_pack(spark, str(folder)), manifest).collect()}
    assert found == {("b.bin", "content differs"), ("c.bin", "missing file"), ("../d", "unsafe path"), ("e.bin", "invalid sha256"), ("e.bin", "invalid role")}
    assert au.has_capability(manifest) and not au.has_capability(manifest, "audio")


def test_pcm(spark, tmp_path):
    import numpy as np

    (tmp_path / "x.pcm").write_bytes(np.array([1000, -1000] * 400, dtype="<i2").tobytes())
    files = spark.read.format("binaryFile").load(str(tmp_path / "x.pcm"))
    chunks = fl.pcm_chunks(files, 16000)
    rows = chunks.orderBy("sequence").collect()
    assert [(r["sequence"], r["duration_ms"], r["rms"]) for r in rows] == [(0, 20.0, 1000), (1, 20.0, 1000), (2, 10.0, 1000)]
    assert fl.recording_gate(chunks, 20, 10, 100, 500).first()["verdict"] == "ok"
    assert fl.recording_gate(chunks, 60, 10, 100, 500).first()["verdict"] == "too short"


def test_overrides_of_one_name_are_reduced_before_the_join(spark):
    from loreloom.operators import entities as en

    pages = spark.createDataFrame([(str(i), "Same", []) for i in range(30)], "title_key string, title string, aliases array<string>")
    overrides = spark.range(1, 200).selectExpr(
        "id as position", "'same' as page_title", "array('x') as match_aliases", "'t' as entity_type", "string(id) as entity_id", "'z' as name_zh",
        "'e' as name_en", "array('a') as aliases",
    )
    found = en.match_overrides(pages, overrides)
    joins = found._jdf.queryExecution().optimizedPlan().toString().split("Join Inner, (key")[1]
    assert "min(position" in joins
    assert {(r.title_key, r.o_id) for r in found.collect()} == {(str(i), "1") for i in range(30)}
