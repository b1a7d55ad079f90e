"""All queries of the library's own operators."""

from __future__ import annotations

from scopeloom.plans import bid_queries, grounding_queries, more_queries, payload_queries, scope_queries, text_queries  # noqa: F401
from scopeloom.plans.registry import ORACLES, QUERIES, Query

FLAGSHIP = "bm25_topk"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
