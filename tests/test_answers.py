"""Guards, evidence, memory and cost rules on literal cases."""

import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F

from loreloom.operators import answers as an, cost as co, memory as me
from loreloom.operators.scan import by_span


def draft(**changes):
    return json.dumps({"advice": "ok", "reason": "why", "confidence": 0.5, "sources": ["s1"], "state_seq": 3, **changes})


def test_answer_guard(spark):
    cases = {
        draft(): [], draft(sources=[]): [], draft(sources=["forged"]): ["source_allowed"], draft(state_seq=4): ["state_seq"],
        draft(confidence=True): ["confidence"], draft(confidence=1): [], draft(confidence="1"): ["confidence"], draft(advice=" "): ["advice"],
        draft(advice="x" * 241): ["advice"], draft(extra=1): ["keys"], draft(sources=["s1"] * 6): ["source_count"], draft(state_seq=True): ["state_seq"],
        draft(sources=[1]): ["source_count", "source_allowed"], draft(advice=5): ["advice"],
    }
    df = spark.createDataFrame([(c, ["s1", "s2"], 3) for c in [*cases, "no json"]], "content string, allowed_sources array<string>, expected_seq long")
    rows = {r["content"]: r for r in an.guard_answers(df).collect()}
    for content, broken in cases.items():
        assert rows[content]["broken_rules"] == broken, content
    assert not rows["no json"]["valid"]
    strict = {r["content"]: r["broken_rules"] for r in an.guard_answers(df, an.ADVICE_LIMITS).collect()}
    assert strict[draft(sources=[])] == ["source_count"]
    repeated = an.guard_answers(spark.createDataFrame([(draft(sources=["s2", "s1", "s2"]), ["s1", "s2"], 3)], df.schema)).first()
    assert repeated["sources"] == ["s2", "s1"]


def test_claims_and_visual(spark):
    rows = [("当前角色是以撒，很好", "以撒", None), ("当前角色为 该隐。", "以撒", None), ("持有主动道具是硫磺火。", "以撒", "D6"), ("没有声明", "以撒", "D6"), ("当前角色是谁", None, None)]
    df = spark.createDataFrame(rows, "advice string, role_name string, active_item_name string")
    assert [r["claims_ok"] for r in an.guard_claims(df).collect()] == [True, False, False, True, True]
    base = {"identification": "a", "explanation": "b", "confidence": 0.9, "state_seq": 1, "evidence_type": "visual_supplement", "scene": "shop"}
    contents = [base, {**base, "confidence": 0.1}, {**base, "scene": "x"}, {**base, "evidence_type": "y"}, {**base, "more": 1}]
    df = spark.createDataFrame([(json.dumps(c), 1, "shop") for c in contents], "content string, expected_seq long, expected_scene string")
    got = [(r["valid"], r["reliable"], r["identification"]) for r in an.guard_visual(df, 0.6).collect()]
    assert got[0] == (True, True, "a") and got[1] == (True, False, an.UNRELIABLE) and [g[0] for g in got[2:]] == [False] * 3


def test_answer_batch_replaces_bad_drafts(spark):
    questions = spark.createDataFrame(
        [("good", "q?", 3, None, None), ("forged", "q?", 3, None, None), ("none", "q?", 3, None, None), ("long", "x" * 301, 3, None, None)],
        "query_id string, question string, state_seq long, role_name string, active_item_name string",
    )
    hits = spark.createDataFrame(
        [("good", 1, "best text", ("s1",)), ("good", 2, "other", ("s2",)), ("forged", 1, "fallback  text", ("s1",))],
        "query_id string, rank int, text string, source struct<id:string>",
    )

    def answer(frame):
        picks = {"good": ["s2"], "forged": ["zz"], "none": []}
        return pd.Series([draft(advice=q, sources=picks[q]) for q in frame["query_id"]], index=frame.index)

    got = {r["query_id"]: r for r in an.answer_batch(questions, hits, answer).collect()}
    assert set(got) == {"good", "forged", "none", "long"}
    assert got["long"]["answer"] is None and got["long"]["replaced_because"] == "question too long"
    assert got["good"]["answer"] == "good" and got["good"]["sources"] == ["s2"] and got["good"]["replaced_because"] is None
    assert got["forged"]["answer"] == "fallback text" and got["forged"]["replaced_because"] == "format or source"
    assert got["none"]["answer"] == "none" and got["none"]["sources"] == []


def test_text_helpers(spark):
    df = spark.createDataFrame([("BRIM and 妈刀 r KEY",)], "t string")
    fixed = an.correct_terms(df, "t", {**an.BASE_CORRECTIONS, "brim": "硫磺火", "brimstone": "x"})
    assert fixed.first()[0] == "硫磺火 and 妈妈的菜刀 R键"
    entities = spark.createDataFrame(
        [("item", "c:1", "硫磺火", "Brimstone", ["brim", "硫磺火", "b"]), ("wiki_page", "w", "x", "x", ["yy"])],
        "entity_type string, entity_id string, name_zh string, name_en string, aliases array<string>",
    )
    table = an.correction_table(entities)
    assert table["brim"] == "硫磺火" and "yy" not in table and "b" not in table
    said = spark.createDataFrame([("看 https://x.y/z 这里。" + "甲" * 8 + "，" + "乙" * 8 + "。chunk_id 12，好",)], "t string")
    pieces = [r["segment"] for r in an.segment_text(said, "t", 12).orderBy("segment_no").collect()]
    assert pieces == ["看 这里。", "甲" * 8 + "，", "乙" * 8 + "。", "，好"]
    calls = spark.createDataFrame(
        [("1", "get_current_game_state", "{}"), ("2", "get_current_game_state", '{"a":1}'), ("3", "retrieve_local_rag", '{"query":"x","top_k":3}'),
         ("4", "retrieve_local_rag", '{"query":"x","top_k":4}'), ("5", "recall_confirmed_preferences", '{"query":"x","top_k":1}'), ("6", "other", "{}"),
         ("7", "retrieve_local_rag", "nope"), ("8", "retrieve_local_rag", '{"query":" "}')], "call_id string, name string, arguments string")
    errors = [r["error"] for r in an.valid_tool_calls(calls).collect()]
    assert errors == [None, "invalid_arguments", None, "invalid_arguments", "invalid_arguments", "unknown_tool", "invalid_arguments", "invalid_arguments"]


def test_names_and_item_evidence(spark):
    chunks = spark.createDataFrame(
        [("c2", "item", "collectible:1", "后", "Later", False), ("c1", "item", "collectible:1", "先", "First", False),
         ("c0", "item", "collectible:1", "旧", "Old", True), ("p", "character", "player:0", "以撒", "Isaac", False)],
        "chunk_id string, entity_type string, entity_id string, name_zh string, name_en string, stale boolean",
    )
    players = spark.createDataFrame([("r", 0, 1), ("s", 5, None)], "run string, player_type long, active_item long")
    got = {r["run"]: (r["role_name"], r["active_item_name"]) for r in an.resolve_identities(players, chunks).collect()}
    assert got == {"r": ("以撒", "先"), "s": (None, None)}
    items = spark.createDataFrame([(2, "词典", "Dict", "hint")], "collectible_id long, name_zh string, name_en string, advice_hint string")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "collectible_id long")
    assert {r["collectible_id"]: r["name_zh"] for r in an.item_descriptor(ids, items, chunks).collect()} == {1: "先", 2: "词典"}
    hits = spark.createDataFrame(
        [(1, 1, "collectible:1", "先", "First", "t1", ("a",)), (1, 2, "collectible:1", "后", "Later", "t2", ("a",)), (1, 3, "collectible:9", "x", "x", "t3", ("z",))],
        "query_id long, rank int, entity_id string, name_zh string, name_en string, text string, source struct<id:string>",
    )
    row = an.item_evidence(ids, hits, items).first()
    assert (row["collectible_id"], row["name_zh"], row["source_ids"], row["hint"]) == (1, "先", ["a"], an.DEFAULT_HINT)


def test_preferences_and_validation(spark):
    turns = spark.createDataFrame([("以后请叫我“小明”",), ("请不要提醒我换房",), ("讲得详细一点",), ("我很喜欢硫磺火。",), ("我的密码是 1",), ("你好",)], "text string")
    got = {(r["kind"], r["content"]) for r in me.extract_candidates(turns).collect()}
    assert got == {("profile", "称呼偏好：小明"), ("guidance_preference", "提示偏好：少提醒换房"), ("guidance_preference", "解释深度偏好：详细"), ("stable_preference", "喜欢硫磺火")}
    rows = [("ok", "src", "profile", 1.0, "explicit", None), ("x" * 241, "src", "profile", 1.0, "explicit", None), ("ok", "", "profile", 1.0, "explicit", None),
            ("ok", "src", "other", 1.0, "explicit", None), ("ok", "src", "profile", 1.5, "explicit", None), ("bearer abc", "src", "profile", 1.0, "explicit", None),
            ("ok", "src", "profile", 1.0, "never", "e" * 200)]
    df = spark.createDataFrame(rows, "content string, source string, kind string, confidence double, confirmation_level string, evidence string")
    checked = me.validate_candidates(df).collect()
    assert [r["violations"] for r in checked] == [[], ["content"], ["source"], ["kind"], ["confidence"], ["unsafe"], ["confirmation_level"]]
    assert len(checked[-1]["evidence"]) == 160


def test_memory_versions_and_actions(spark):
    rows = [(1, "喜欢A", 1.0, "explicit"), (2, "喜欢 a", 0.9, "explicit"), (3, "喜欢B", 0.6, "inferred")]
    df = spark.createDataFrame([("p", "t", n, c, x, lv, "s", n) for n, c, x, lv in rows],
                               "kind string, topic_key string, n long, content string, confidence double, confirmation_level string, source string, at long")
    for span in (1, 100):
        got = {r["version"]: (r["content"], r["status"], r["confidence"], r["evidence_count"]) for r in
               me.memory_versions(df, ["kind", "topic_key"], ["n"], by_span("n", span)).collect()}
        assert got == {1: ("喜欢A", "conflicted", 1.0, 2), 2: ("喜欢B", "pending", 0.6, 1)}
    memories = spark.createDataFrame([(i, "profile", "c", s, 0.5, "explicit", "s", 1, 1) for i, s in enumerate(["active", "conflicted", "active", "pending"])],
                                     "id long, kind string, content string, status string, confidence double, confirmation_level string, source_summary string, created_at long, updated_at long")
    log = [(5, "disable", 0, None), (6, "enable", 0, None), (5, "enable", 1, None), (5, "delete", 2, None), (5, "correct", 3, "new"), (7, "disable", 3, None)]
    actions = spark.createDataFrame([(a, x, i, c, None) for a, x, i, c in log], "at long, action string, id long, content string, kind string")
    got = {r["id"]: (r["status"], r["confidence"], r["confirmation_level"], r["content"], r["updated_at"]) for r in me.apply_actions(memories, actions).collect()}
    assert got == {0: ("active", 0.8, "confirmed", "c", 6), 1: ("conflicted", 0.5, "explicit", "c", 1), 3: ("disabled", 1.0, "manual", "new", 7)}
    cleared = actions.unionByName(spark.createDataFrame([(9, "clear", None, None, None)], actions.schema))
    assert me.apply_actions(memories, cleared).count() == 0
    evidence = spark.createDataFrame([(1, 0, "s", "x", 1), (2, 0, "s", "y", 2), (3, 9, "s", "z", 3)], "id long, memory_id long, source string, excerpt string, created_at long")
    assert me.surviving_evidence(evidence, memories).count() == 2
    joined = me.memories_with_evidence(memories, evidence).where("id = 0").orderBy("evidence_no").collect()
    assert [(r["evidence_no"], r["excerpt"]) for r in joined] == [(1, "x"), (2, "y")]
    picks = spark.createDataFrame([(0,)], "id long")
    stamped = me.stamp_used(memories.withColumn("last_used_at", F.lit(None).cast("long")), picks, F.lit(77))
    assert {r["id"]: r["last_used_at"] for r in stamped.collect()} == {0: 77, 1: None, 2: None, 3: None}


def test_recall_budget(spark):
    memories = spark.createDataFrame(
        [("a", "profile", "称呼偏好：小明", "active", "1"), ("b", "stable_preference", "喜欢硫磺火", "active", "2"), ("c", "stable_preference", "喜欢炸弹", "active", "3"),
         ("d", "profile", "x" * 50, "active", "4"), ("e", "profile", "隐藏", "disabled", "5")], "id string, kind string, content string, status string, updated_at string"
    ).withColumn("owner", F.lit("o"))
    q = spark.createDataFrame([("q", "o", "硫磺火怎么样")], "query_id string, owner string, query string")
    got = [(r["id"], r["score"]) for r in me.recall(q, memories, "owner", 3, 20).orderBy("item_no").collect()]
    assert got == [("a", 4), ("b", 2)]


def test_costs(spark):
    usage = spark.createDataFrame([("r", "m", 1_000_000, 0), ("r", "m", 0, 1_000_000), ("s", "free", 5, 5)], "run_id string, model string, input_tokens long, output_tokens long")
    prices = spark.createDataFrame([("m", 0.2, 0.8)], "model string, input_price double, output_price double")
    got = {r["run_id"]: (r["total_cost"], r["may_call"]) for r in co.run_costs(usage, prices, 1.0).collect()}
    assert got == {"r": (Decimal("1.000000000"), False), "s": (Decimal("0E-9"), True)}
    rows = spark.createDataFrame([(None, None, None, None, 4, 1.0, 3, 0.25), (1, 2, 3, 0, 9, 9.0, 9, 9.0)],
                                 "text_in long, audio_in long, text_out long, audio_out long, chars_in long, seconds_in double, chars_out long, seconds_out double")
    got = [(r["text_in"], r["audio_in"], r["text_out"], r["audio_out"], r["estimated"]) for r in co.estimate_usage(rows).collect()]
    assert got == [(3, 50, 2, 25, True), (1, 2, 3, 0, False)]


def test_a_correction_leaves_evidence(spark):
    from loreloom.operators import memory as me

    memories = spark.createDataFrame([("m1", 1), ("m2", 2), ("m3", 20), ("m4", 3)], "id string, created_at long")
    actions = [
        (5, "correct", "m1", "new text", None), (6, "correct", "m1", "newer", "profile"), (7, "correct", "m2", "", None), (8, "correct", "m2", "x", "no kind"),
        (9, "delete", "m4", None, None), (10, "correct", "m4", "late", None), (11, "correct", "gone", "text", None), (15, "clear", None, None, None),
        (16, "correct", "m1", "after the clear", None), (25, "correct", "m3", "fine", None), (15, "correct", "m2", "at the clear", None),
    ]
    log = spark.createDataFrame(actions, "at long, action string, id string, content string, kind string")
    got = me.correction_evidence(memories, log, span=4)
    assert sorted((r.memory_id, r.created_at) for r in got.collect()) == [("m1", 5), ("m1", 6), ("m2", 15), ("m3", 25)]
    assert {(r.source, r.excerpt) for r in got.collect()} == {(me.SOURCE_CORRECTED, me.EVIDENCE_CORRECTED)}
