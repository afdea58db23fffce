"""Even partitioning of token rows by reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Token rows in a block of consecutive ids.
BLOCK = 4096


def block_of(column: str = "id", size: int = BLOCK) -> Column:
    return F.floor(F.col(column) / size).cast("bigint")


def distinct_rows(tokens: DataFrame, columns: list[str], size: int = BLOCK) -> DataFrame:
    """Each row of the given columns (id among them) once, rows without id left out.

    One exchange on blocks of consecutive ids: even whatever document, file or term is
    hot, and neighbours stay together so that later partial aggregates combine well.
    The block column stays for the caller."""
    picked = tokens.where(F.col("id").isNotNull()).select(block_of("id", size).alias("__block"), *columns)
    return picked.repartition("__block").distinct()
