"""All queries outside the text preparation subpackage."""

from __future__ import annotations

from palimpsest.queries import context, preparation, records, retrieval, spaces, stages, stores, towers

MODULES = (preparation, retrieval, stores, spaces, context, records, stages, towers)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
FLAGSHIP = "bm25_topk"
