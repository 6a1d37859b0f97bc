"""Every query of the library outside heddle.llm, with its DuckDB SQL."""

from __future__ import annotations

from . import document_queries, event_queries, log_queries, more_queries, page_queries, rank_queries, search_queries, text_queries, thread_queries, verdict_queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "document_queries", "event_queries", "log_queries", "more_queries", "page_queries", "rank_queries", "search_queries", "text_queries", "thread_queries", "verdict_queries"]
