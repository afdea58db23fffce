"""Comparison of two result sets (SET1-SET3, JN10, JN11, AGG27, SRT5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare(a: DataFrame, b: DataFrame, key: str, values: dict[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(shared, only in a, only in b) of two results by a key.

    Shared rows join on the key as it stands, provided its lower-cased form occurs on both
    sides; unique rows are those whose lower-cased key is missing on the other side.
    values maps columns to the stem of their names: stem_a, stem_b and stem_diff (a - b).
    Shared rows number one per pair of equal keys."""
    low = F.lower(F.col(key))
    la, lb = a.select(low.alias("_k")).distinct(), b.select(low.alias("_k")).distinct()
    left = a.select(key, *[F.col(c).alias(f"{s}_a") for c, s in values.items()])
    right = b.select(key, *[F.col(c).alias(f"{s}_b") for c, s in values.items()])
    shared = left.join(right, key)
    for s in values.values():
        shared = shared.withColumn(f"{s}_diff", F.col(f"{s}_a") - F.col(f"{s}_b"))
    only_a = a.withColumn("_k", low).join(lb, "_k", "left_anti").drop("_k")
    only_b = b.withColumn("_k", low).join(la, "_k", "left_anti").drop("_k")
    return shared, only_a, only_b


def compare_ngrams(a: DataFrame, b: DataFrame) -> DataFrame:
    """SET3: shared n-grams with freq and rel differences."""
    return compare(a, b, "ngram", {"frequency": "freq", "per_million": "rel"})[0]


def compare_collocations(a: DataFrame, b: DataFrame) -> DataFrame:
    """SET2: shared collocates with the difference of their observed counts."""
    return compare(a, b, "collocate", {"observed": "freq", "ll": "ll"})[0]


def by_difference(shared: DataFrame, column: str, key: str, top: int | None = None) -> DataFrame:
    """SRT5: shared rows by the size of a difference, then by the key; with top the first so many."""
    out = shared.orderBy(F.abs(F.col(column)).desc(), key)
    return out if top is None else out.limit(top)


def summary(shared: DataFrame, only_a: DataFrame, only_b: DataFrame) -> DataFrame:
    """AGG27: shared, unique_a, unique_b, overlap (% of all, 2 places), one row."""
    parts = [d.select(F.lit(n).alias("_p")) for n, d in (("s", shared), ("a", only_a), ("b", only_b))]
    counts = parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(
        F.count_if(F.col("_p") == "s").alias("shared"), F.count_if(F.col("_p") == "a").alias("unique_a"), F.count_if(F.col("_p") == "b").alias("unique_b")
    )
    total = F.col("shared") + F.col("unique_a") + F.col("unique_b")
    return counts.withColumn("overlap", F.when(total > 0, F.round(F.col("shared") / total * 100, 2)).otherwise(F.lit(0.0)))
