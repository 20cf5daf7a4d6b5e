"""All queries of the core library and their SQL."""

from __future__ import annotations

from . import answer_queries, event_queries, filing_queries, question_queries, retrieval_queries, scoring_queries, source_queries, template_queries, training, training_sql, upkeep_queries

FAMILIES = (filing_queries, retrieval_queries, question_queries, answer_queries, event_queries, upkeep_queries, scoring_queries, template_queries, source_queries)


def queries() -> dict:
    return {**training.QUERIES, **{k: v for m in FAMILIES for k, v in m.QUERIES.items()}}


def oracle_sql() -> dict[str, str]:
    return {**training_sql.SQL, **{k: v for m in FAMILIES for k, v in m.SQL.items()}}
