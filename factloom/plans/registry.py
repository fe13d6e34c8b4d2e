"""All queries of the core and their oracle SQL."""

from __future__ import annotations

from factloom.plans import documents, evidence, facts, general, grids, oracles, pages, projections, quality, readers, rendering, scenes, tabular, texts, values

_MODULES = (documents, facts, values, pages, tabular, quality, readers, scenes, rendering, texts, evidence, grids, projections)
QUERIES = general.QUERIES | {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = oracles.ORACLES | {k: v for m in _MODULES for k, v in m.ORACLES.items()}
