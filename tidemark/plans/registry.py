"""All queries of the core."""

from __future__ import annotations

from tidemark.plans import activity, index, problems, retrieval

MODULES = [activity, retrieval, index, problems]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}


def flagship(spark, sf_dir):
    return queries()["hybrid_search"](spark, sf_dir)
