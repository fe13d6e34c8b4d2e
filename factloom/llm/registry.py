"""All queries of the text operators."""

from __future__ import annotations

from factloom.llm import queries

QUERIES = {**queries.QUERIES}
ORACLES = {**queries.ORACLES}
