"""Queries next to their SQL on small tables with rows that the test tables lack."""

import os

import pytest

from loreloom.catalog import load_all
from tests import oracle

REGISTRY = load_all()
SF_DIR = "/root/testdata/sf0.001"


def agrees(spark, folder, name, **tables):
    """Verdict of the query over ``tables``; the others are those of the smallest set."""
    for other in oracle.TABLES:
        if other not in tables:
            os.symlink(f"{SF_DIR}/{other}.parquet", f"{folder}/{other}.parquet")
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}")
        part = next(f for f in os.listdir(f"{folder}/{table}") if f.endswith(".parquet"))
        os.symlink(f"{folder}/{table}/{part}", f"{folder}/{table}.parquet")
    return oracle.compare(spark, str(folder), REGISTRY.queries[name], REGISTRY.sql[name])


pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the test tables")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_title_key_of_letters_that_become_several(spark, tmp_path):
    texts = ["ßieung", "Ns:ßa", "ŉx", "ǰa:b", "ﬁn", "ﬃ", "ΐa", "ᾳb", "ab", "äb", "x:", ":", ""]
    rows = [(i, t, "de", "src0", len(t)) for i, t in enumerate(texts)]
    assert agrees(spark, tmp_path, "normal_forms", documents=(rows, DOCUMENTS))[0] == "ok"


def test_phrase_places_that_overlap_count_each(spark, tmp_path):
    texts = ["the the the the", "The the, a the", "the a the a the a", "one", "one one", ""]
    rows = [(i, t, "en", "src0", len(t)) for i, t in enumerate(texts * 2)]
    items = [(2, "The the x"), (4, "the a the"), (8, "one")]
    verdict = agrees(spark, tmp_path, "phrase_filtered", documents=(rows, DOCUMENTS), benchmark=(items, "item_id long, text string"))
    assert verdict[0] == "ok" and verdict[2] > 0


def test_equal_lines_of_an_order_go_by_part(spark, tmp_path):
    rows = [(order, part, 1, 10.0) for order in range(20) for part in ((9, 3, 7) if order % 2 else (7, 9, 3))]
    verdict = agrees(spark, tmp_path, "top_two_parts", lineitem=(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_extendedprice double"))
    assert verdict == ("ok", verdict[1], 20)
    assert {r["best"] for r in REGISTRY.queries["top_two_parts"](spark, str(tmp_path)).collect()} == {"3,7"}


def test_part_aliases_use_all_cores(spark):
    """The table's scan has one split here, and few splits for a million rows."""
    rows = REGISTRY.queries["part_aliases"](spark, SF_DIR)
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_contained_keys_travel_with_the_length_of_the_query_alone(spark):
    plan = REGISTRY.queries["alias_contained"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("length(whole#") > plan.index("Join Inner")
