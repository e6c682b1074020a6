"""Composed jobs and the registered query catalogue."""

from __future__ import annotations


def all_queries():
    """Import every query module (registration happens on import) and return the registry."""
    from routelens.plans import (queries_analysis, queries_cascade, queries_core, queries_ingest,  # noqa: F401
                                 queries_knn, queries_learned, queries_split)
    from routelens.plans.registry import QUERIES
    return QUERIES
