"""All queries of the engine."""

from __future__ import annotations

from . import block_queries, detail_queries, document_queries, layout_queries, line_queries, metric_queries, source_queries, structure_queries, text_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
