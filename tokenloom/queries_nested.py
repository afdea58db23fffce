"""Queries of problem 6."""

from __future__ import annotations

from tokenloom.operators import nested
from tokenloom.session import table


def queries() -> dict:
    return {
        "p6_found": lambda spark, d: nested.spans(table(spark, d, "raw_records")),
        "p6_texts": lambda spark, d: nested.texts(table(spark, d, "raw_records")),
        "p6_sentences": lambda spark, d: nested.sentences(table(spark, d, "raw_records")),
        "p6_tokens": lambda spark, d: nested.tokens(table(spark, d, "raw_records")),
    }


def oracle_sql() -> dict[str, str]:
    return {}
