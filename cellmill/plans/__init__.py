"""Registered queries: operators composed over tables, and their SQL."""

from . import core_queries, domain_queries, file_queries, graph_queries, pipeline_queries, score_queries  # noqa: F401  (they register themselves)
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
