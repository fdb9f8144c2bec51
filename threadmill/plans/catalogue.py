"""Query catalogue: one key per operator, with DuckDB SQL beside it where SQL can express it."""

from __future__ import annotations

from threadmill.plans import dataset_queries, evaluation_queries, retrieval_queries, text_queries

_MODULES = (text_queries, dataset_queries, retrieval_queries, evaluation_queries)


def entry(spark, sf_dir):
    return retrieval_queries.entry(spark, sf_dir)


def queries():
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
