"""All queries of this package outside optional parts, with their SQL oracles."""

from __future__ import annotations

from . import learning_queries, linguistic_queries, score_queries, storage_queries, text_queries, tree_queries, vector_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
