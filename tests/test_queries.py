"""Queries beside their oracle SQL on the smallest tables, and the driver's contract."""

from __future__ import annotations

import pytest
from compare import connect, difference

import __spark_entry__ as entry
from factloom.operators.common import query_scope
from factloom.plans import registry

FOLDER, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def databases():
    return {d: connect(d) for d in (FOLDER, LARGER)}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, databases, name):
    with query_scope(spark):
        assert difference(spark, FOLDER, registry.QUERIES[name], registry.ORACLES[name], databases[FOLDER]) == ""


@pytest.mark.parametrize("name", ["p2_found", "p3_found", "p3_instants", "p5_found", "p5_quantities"])
def test_oracle_on_larger_tables(spark, databases, name):
    with query_scope(spark):
        assert difference(spark, LARGER, registry.QUERIES[name], registry.ORACLES[name], databases[LARGER]) == ""


def test_queries_without_sql_give_rows(spark):
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"p3_zones", "lexicon_corrections", "normalized_blocks", "similar_fields"}
    for name in ("p3_zones", "lexicon_corrections", "normalized_blocks"):
        assert registry.QUERIES[name](spark, FOLDER).count() > 0


def test_contract(spark):
    df = entry.entry(spark)
    assert df.columns == ["artifact_id", "link_kind", "parent_id", "child_id"] and df.limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
