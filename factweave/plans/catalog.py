"""All registered queries."""

from __future__ import annotations

from factweave.plans import (  # noqa: F401  (importing registers)
    queries_batches,
    queries_corpus,
    queries_logs,
    queries_scores,
    queries_text,
)
from factweave.plans.registry import ORACLES, QUERIES

FLAGSHIP = "eval_summary"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
