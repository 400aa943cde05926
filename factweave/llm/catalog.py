"""All queries of this folder and their SQL."""

from __future__ import annotations

from factweave.llm import queries_corpus, queries_dedup, queries_models, queries_text, queries_vectors  # noqa: F401  (importing registers)
from factweave.llm.register import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
