"""Annotations and labels written into a token table (SNK5-SNK7, JN15, SRC17)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_annotations(spark: SparkSession, text: str) -> DataFrame:
    """SRC17: an annotation document (key, corpus_path, corpus_name, search_term,
    annotations) as rows: id, attribute, value, n (order of writing)."""
    held = json.loads(text)
    rows = []
    for n, (token, values) in enumerate((held.get("annotations") or {}).items()):
        for attribute, value in (values or {}).items():
            rows.append((int(token), str(attribute), None if value is None else str(value), n))
    return spark.createDataFrame(rows, "id bigint, attribute string, value string, n int")


def write_annotations(annotations: DataFrame, *, key: str, corpus_path: str, corpus_name: str, search_term: str) -> str:
    """SRC17: the document of such rows. Annotations are made by hand: their number is small."""
    found: dict[str, dict] = {}
    for r in annotations.orderBy("n", "id", "attribute").collect():
        found.setdefault(str(r["id"]), {})[r["attribute"]] = r["value"]
    return json.dumps({"key": key, "corpus_path": corpus_path, "corpus_name": corpus_name, "search_term": search_term, "annotations": found}, ensure_ascii=False)


def persist_annotations(tokens: DataFrame, annotations: DataFrame, max_columns: int = 500) -> DataFrame:
    """SNK5: tokens with a string column per attribute; the last value written of an id and
    attribute wins, what is not annotated keeps its old value. More than max_columns
    attributes are refused with ValueError."""
    last = annotations.withColumn("_r", F.row_number().over(Window.partitionBy("id", "attribute").orderBy(F.desc("n")))).where(F.col("_r") == 1)
    attributes = sorted(r["attribute"] for r in last.select("attribute").distinct().limit(max_columns + 1).collect())
    if len(attributes) > max_columns:
        raise ValueError(f"more than {max_columns} attributes")
    wide = last.groupBy("id").pivot("attribute", attributes).agg(F.first("value")) if attributes else last.select("id").distinct()
    renamed = wide.select("id", *[F.col(a).alias(f"_new_{a}") for a in attributes])
    out = tokens.join(renamed, "id", "left")
    for a in attributes:
        old = F.col(a).cast("string") if a in tokens.columns else F.lit(None).cast("string")
        out = out.withColumn(a, F.coalesce(F.col(f"_new_{a}"), old)).drop(f"_new_{a}")
    return out


def _update(tokens: DataFrame, labels: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    one = labels.groupBy(*keys).agg(*[F.max(c).alias(f"_new_{c}") for c in columns])
    out = tokens.join(one, keys, "left")
    for c in columns:
        old = F.col(c) if c in tokens.columns else F.lit(None).cast("string")
        out = out.withColumn(c, F.coalesce(F.col(f"_new_{c}"), old)).drop(f"_new_{c}")
    ordered = tokens.columns + [c for c in columns if c not in tokens.columns]
    return out.select(*ordered)


def persist_by_token(tokens: DataFrame, labels: DataFrame, columns: tuple[str, ...] = ("topic", "sentiment")) -> DataFrame:
    """SNK6: labels(id, ...) set on their tokens; of several labels the greatest is taken."""
    return _update(tokens, labels, ["id"], [c for c in columns if c in labels.columns])


def persist_by_sentence(tokens: DataFrame, labels: DataFrame, columns: tuple[str, ...] = ("topic", "sentiment")) -> DataFrame:
    """SNK7: labels(filename, sent_id, ...) set on all tokens of their sentences."""
    return _update(tokens, labels, ["filename", "sent_id"], [c for c in columns if c in labels.columns])
