"""Operators for large text corpora, and the queries that apply them to the test tables.

Each module holds one operator with a general DataFrame interface plus the thin ``opN_`` query.
"""

from __future__ import annotations


def queries():
    from framespark.llm import registry

    return registry.queries()


def oracle_sql():
    from framespark.llm import registry

    return registry.oracle_sql()
