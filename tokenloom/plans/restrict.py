"""Restrictions on metadata columns and small filters (PRD8-PRD15, PRD19)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that are no metadata. Fixed values.
STANDARD = ("id", "token", "_token_low", "pos", "lemma", "sent_id", "filename")
#: Punctuation that n-grams and contexts may leave out. Fixed values.
PUNCT = (".", ",", "!", "?", ";", ":", "(", ")", "[", "]", "{", "}", '"', "'", "“", "”", "‘", "’", "-", "–")

#: One restriction per column: a list of values, or a pair (low, high) of integers.
Restrictions = dict[str, list | tuple]


def predicate(restrictions: Restrictions | None) -> Column:
    """AND over the restrictions; a list keeps its values, a pair the integers between."""

    def one(item: tuple[str, list | tuple]) -> Column:
        name, value = item
        if isinstance(value, tuple):
            return F.expr(f"try_cast(`{name}` AS bigint)").between(*value)
        return F.col(name).isin(*value) if value else F.lit(False)

    return reduce(lambda a, b: a & b, map(one, sorted((restrictions or {}).items())), F.lit(True))


def attribute_columns(tokens: DataFrame) -> list[str]:
    """PRD10: all columns but the standard ones."""
    return [c for c in tokens.columns if c not in STANDARD]


def visible_attributes(tokens: DataFrame) -> list[str]:
    """Q17: attributes whose names end in _id, _len or _start are not shown."""
    return [c for c in attribute_columns(tokens) if not c.endswith(("_id", "_len", "_start"))]


def integer_columns(tokens: DataFrame, columns: list[str]) -> DataFrame:
    """PRD11: attribute, is_integer (no value that is not null fails the cast)."""
    if not columns:
        return tokens.sparkSession.createDataFrame([], "attribute string, is_integer boolean")
    bad = [F.count_if(F.expr(f"try_cast(`{c}` AS bigint)").isNull() & F.col(c).isNotNull()).alias(c) for c in columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("attribute"), (F.col(c) == 0).alias("is_integer")) for c in columns])
    return tokens.agg(*bad).select(F.inline(pairs))


def value_range(tokens: DataFrame, column: str) -> DataFrame:
    """PRD12: low, high of an attribute's integer values, one row, null without any."""
    value = F.expr(f"try_cast(`{column}` AS bigint)")
    return tokens.agg(F.min(value).alias("low"), F.max(value).alias("high"))


def value_domain(tokens: DataFrame, column: str) -> DataFrame:
    """PRD12: the distinct values of an attribute, blank ones and 'nan' left out."""
    value = F.col(column).cast("string")
    return tokens.select(value.alias("value")).where((F.trim("value") != "") & (F.lower("value") != "nan")).distinct()


def no_punctuation(column: str) -> Column:
    return ~F.col(column).rlike(r"^\p{Punct}+\z")


def no_digits(column: str) -> Column:
    return ~F.col(column).rlike(r"^[0-9]+\z")


def smart_filter(df: DataFrame, column: str, text: str) -> DataFrame:
    """PRD15: 'a, b' keeps these values, '-a, -b' drops them (any '-' drops all named)."""
    parts = [p.strip() for p in (text or "").split(",") if p.strip()]
    if not parts:
        return df
    values = [p.lstrip("-").strip().lower() for p in parts]
    low = F.lower(column)
    return df.where(~low.isin(*values)) if any(p.startswith("-") for p in parts) else df.where(low.isin(*values))


def significant(df: DataFrame, level: str) -> DataFrame:
    """PRD19: '***', '**' (with '***'), 'any' (not ns) or 'all'."""
    s = F.col("significance")
    if level in ("***", "**"):
        return df.where(s.contains(level))
    return df.where(s != "ns") if level == "any" else df
