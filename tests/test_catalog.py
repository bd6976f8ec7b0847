"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from loreloom.catalog import load_all
from tests import oracle

SF_DIR = "/root/testdata/sf0.001"
REGISTRY = load_all()
#: Beyond SQL: greedy text packing, and an encoder in Python.
WITHOUT_SQL = {"sectioned_pages", "hybrid_search"}


@pytest.fixture(scope="module")
def db():
    return oracle.connect(SF_DIR)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(REGISTRY.queries))
def test_query(spark, db, name):
    verdict, _, rows = oracle.compare(spark, SF_DIR, REGISTRY.queries[name], REGISTRY.sql.get(name), db)
    assert verdict == ("rows-only" if name in WITHOUT_SQL else "ok")
    assert rows > 0 or name in REGISTRY.sql


def test_names_match():
    assert set(REGISTRY.sql) <= set(REGISTRY.queries)
