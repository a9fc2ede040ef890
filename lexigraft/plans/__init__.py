"""Registered queries over the given tables, each with its SQL."""

from . import annotation_queries, corpus_queries, dag_queries, document_queries, graph_queries, load_queries, mapping_queries, rule_queries, silver_queries, source_queries, text_queries  # noqa: F401
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
