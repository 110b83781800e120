"""All queries outside the llm subpackage by name, and their SQL."""

from __future__ import annotations

from . import feed_queries, further_queries, join_queries, scalar_queries, sequence_queries, source_queries, structure_queries

_MODULES = [feed_queries, sequence_queries, join_queries, scalar_queries, structure_queries, source_queries, further_queries]


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def sql() -> dict:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}


def flagship(spark, d):
    return join_queries.jn11(spark, d)
