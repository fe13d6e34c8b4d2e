"""Text queries beside their SQL on the smallest tables."""

from __future__ import annotations

import pytest
from compare import connect, difference

from factloom.llm import registry
from factloom.operators.common import query_scope

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    with query_scope(spark):
        assert difference(spark, FOLDER, registry.QUERIES[name], registry.ORACLES[name], connect(FOLDER)) == ""
