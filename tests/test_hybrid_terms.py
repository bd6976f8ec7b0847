"""The registered hybrid search asks for every term of a text."""

from __future__ import annotations

from loreloom.catalog import load_all


def test_a_late_term_finds_its_document(spark, tmp_path):
    texts = [(k, f"filler{k} nothing {k} of note", "en", "s", 1) for k in range(30)] + [(99, "quagga", "en", "s", 1)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    asked = " ".join(f"absent{'abcdefghijkl'[k]}" for k in range(12)) + " quagga"
    spark.createDataFrame([(1, asked)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = load_all().queries["hybrid_search"](spark, str(tmp_path)).collect()
    assert [(r.chunk_id, r.rank) for r in found if "bm25" in r.methods] == [("d99", 1)]
