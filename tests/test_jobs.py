"""The jobs end to end, and the streams that need a clock or a second input."""

import json
import time

from pyspark.sql import functions as F

from loreloom.operators import audit as au, events as ev, sections as sc
from loreloom.plans import jobs
from loreloom.streaming import events as se
from tests.test_corpus import snapshot
from tests.test_events import event, line


def test_import_index_evaluate_advise(spark, tmp_path):
    path = tmp_path / "pages.jsonl"
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in snapshot()))
    out = str(tmp_path / "out")
    manifest = jobs.import_corpus(spark, [str(path)], out)
    assert manifest["chunk_count"] > 5 and manifest["pages_without_chunks"] == 0
    index, _ = jobs.build_index(spark, out)
    suite = tmp_path / "suite.json"
    cases = [
        {"id": "1", "query": "硫磺火", "expected_entities": ["collectible:118"], "expected_sources": ["w:page:1:rev:101"]},
        {"id": "2", "query": "collectible:118", "expected_entities": ["collectible:118"], "expected_sources": ["w:page:1:rev:101"]},
        {"id": "3", "query": "collectible:999", "expected_entities": [], "expected_sources": [], "expect_no_answer": True},
    ]
    limits = {"keyword_recall_at_k": 0.9, "keyword_mrr": 0.85, "no_answer_accuracy": 1.0}
    suite.write_text(json.dumps({"eval_id": "s", "top_k": 5, "thresholds": limits, "cases": cases}, ensure_ascii=False))
    report, scored = jobs.evaluate_suite(spark, str(suite), index)
    assert report.first()["passed"], scored.collect()
    lines = [line(event(1, "run_started")), line(event(2, "collectible_spawned", payload={"collectible_id": 118, "init_seed": 5})),
             line(event(2, "heartbeat")), "noise", line(event(5, "collectible_spawned", payload={"collectible_id": 999}))]
    rows = spark.createDataFrame([(t, i) for i, t in enumerate(lines)], "value string, arrival long")
    played = jobs.replay(rows, "arrival")
    assert {r["status"]: r["lines"] for r in played.line_counts.collect()} == {"valid": 4, "ignored": 1}
    report = played.diagnostics.first()
    assert (report["parsed_events"], report["out_of_order_events"], report["sequence_gaps"]) == (3, 1, 2)
    assert played.states.first()["room_items"] == 2
    advice = jobs.advise(played.accepted, index).collect()
    assert [(r["seq"], r["name_zh"]) for r in advice] == [(2, "硫磺火")]


def test_stale_and_pause_streams(spark, tmp_path):
    schema = "run string, t long, is_result boolean, result_id string, seq long, room int"
    rows = [("r", 10, False, None, 1, 5), ("r", 12, True, "exact", 1, 5), ("r", 20, False, None, 2, 5), ("r", 25, True, "ok", 1, 5),
            ("r", 30, False, None, 3, 6), ("r", 35, True, "moved", 1, 5), ("s", 5, True, "early", 1, 5)]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "mixed"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "mixed"))
    for strict, want in ((False, {"exact", "ok"}), (True, {"exact"})):
        passed = se.run_to_table(se.suppress_stale_stream(stream, "run", ["t"], ["room"], strict), "stale")
        assert {r["result_id"] for r in passed.collect()} == want
    times = spark.createDataFrame([(i, 1_700_000_000 + i * 600) for i in range(20)], "id int, s long").select("id", F.timestamp_seconds("s").alias("ts"))
    times.coalesce(1).write.parquet(str(tmp_path / "times"))
    pauses = spark.createDataFrame([(1_700_001_800, 1_700_006_000)], "a long, b long").select(
        F.timestamp_seconds("a").alias("paused_at"), F.timestamp_seconds("b").alias("resumed_at"))
    want = [i for i in range(20) if not 3 <= i < 10]
    live = spark.readStream.schema(times.schema).parquet(str(tmp_path / "times"))
    kept = se.run_to_table(se.drop_paused_stream(live, pauses, "ts"), "paused")
    assert sorted(r["id"] for r in kept.collect()) == want
    assert sorted(r["id"] for r in ev.drop_paused(times, pauses, "ts").collect()) == want
    once = se.run_to_table(se.dedupe_calls_stream(live.select(F.lit("a").alias("call_id"), "ts"), "ts"), "calls")
    assert once.count() == 1


def test_liveness_reports_live_then_waiting(spark, tmp_path):
    spark.createDataFrame([("r",), ("r",), ("s",)], "run string").coalesce(1).write.json(str(tmp_path / "live"))
    stream = spark.readStream.schema("run string").json(str(tmp_path / "live"))
    query = se.liveness_stream(stream, "run", 1.0).writeStream.format("memory").queryName("liveness").outputMode(
        "update"
    ).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        seen = set()
        for _ in range(60):
            time.sleep(1)
            seen = {tuple(r) for r in spark.sql("SELECT run_id, status, events FROM liveness").collect()}
            if len(seen) == 4:
                break
    finally:
        query.stop()
    assert seen == {("r", "live", 2), ("s", "live", 1), ("r", "waiting", 0), ("s", "waiting", 0)}


def test_manifest_header_and_references(spark):
    good = {"schema_version": 1, "pack_id": "p-1", "display_name": "P", "game": "g", "game_version": "1", "content_version": "c",
            "created_at": "2026-01-01T00:00:00Z", "files": [{}], "vector_dimension": 4, "embedding_model_id": "m", "minimum_version": "0.1.0"}
    def rules(**changes):
        df = spark.createDataFrame([(json.dumps({**good, **changes}),)], "value string")
        return {r["rule"] for r in au.header_violations(df, "minimum_version", (0, 2, 0)).collect()}
    assert rules() == set()
    assert rules(minimum_version="1.0.0") == {"version"} and rules(minimum_version="1.0") == {"version"}
    assert rules(extra=1) == {"keys"} and rules(pack_id="a b") == {"pack_id_form"} and rules(created_at="soon") == {"created_at_form"}
    uses = spark.createDataFrame([("data", "Data:A"), ("data", "Data:B"), ("data", "Data:B"), ("module", "M")], "kind string, name string")
    assert [tuple(r) for r in sc.data_reference_counts(uses).collect()] == [("Data:B", 2), ("Data:A", 1)]
