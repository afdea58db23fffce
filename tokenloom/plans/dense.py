"""Dense numbering of a distributed, sorted set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.session import materialize


def dense_number(df: DataFrame, order: list[str], name: str, first: int = 0, label: str = "dense") -> DataFrame:
    """Number the rows of df first, first+1, ... in the given order (a unique key).

    Range-partitioned and sorted, numbered inside each partition, then shifted by the
    partition offsets. Only one count per partition reaches the driver; the sorted rows
    are written to the shared folder so that offsets and rows agree even if an executor
    is lost between the two passes."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__dense_part", F.spark_partition_id())
    kept = materialize(ranged, label)
    sizes = sorted((r["__dense_part"], r["n"]) for r in kept.groupBy("__dense_part").agg(F.count("*").alias("n")).collect())
    offsets, total = [], first
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    spark = df.sparkSession
    if not offsets:
        return kept.drop("__dense_part").withColumn(name, F.lit(None).cast("bigint"))
    shift = spark.createDataFrame(offsets, "__dense_part int, __dense_shift bigint")
    window = Window.partitionBy("__dense_part").orderBy(*order)
    return (
        kept.join(F.broadcast(shift), "__dense_part")
        .withColumn(name, F.col("__dense_shift") + F.row_number().over(window) - 1)
        .drop("__dense_part", "__dense_shift")
    )


def running(df: DataFrame, order: str, value: str, name: str, how: str = "sum", descending: bool = False, label: str = "running") -> DataFrame:
    """df with the sum or minimum of value over the rows up to each one in the order of a
    unique column: inside range partitions by a window, across them by one number a
    partition on the driver. No window spans all rows."""
    by = F.desc(order) if descending else F.asc(order)
    ranged = df.repartitionByRange(by).withColumn("__part", F.spark_partition_id())
    kept = materialize(ranged, label)
    fold = F.sum if how == "sum" else F.min
    each = sorted((r["__part"], r["v"]) for r in kept.groupBy("__part").agg(fold(value).alias("v")).collect())
    before, carry = [], None
    for part, v in each:
        before.append((part, None if carry is None else float(carry)))
        carry = v if carry is None else carry + v if how == "sum" else min(carry, v)
    shift = df.sparkSession.createDataFrame(before, "__part int, __before double")
    inside = fold(value).over(Window.partitionBy("__part").orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    whole = inside + F.coalesce("__before", F.lit(0.0)) if how == "sum" else F.least(inside, F.col("__before"))
    return kept.join(F.broadcast(shift), "__part").withColumn(name, whole).drop("__part", "__before")
