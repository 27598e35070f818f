"""All named queries outside the llm subpackage, and their SQL."""

from __future__ import annotations

from textloom.plans import evaluate_queries, search_queries, search_sql, skew_queries, text_queries, trial_queries

FLAGSHIP = "complete"

QUERIES = {**search_queries.QUERIES, **text_queries.QUERIES, **evaluate_queries.QUERIES, **skew_queries.QUERIES, **trial_queries.QUERIES}
SQL = {**search_sql.SQL, **text_queries.SQL, **evaluate_queries.SQL, **skew_queries.SQL, **trial_queries.SQL}
