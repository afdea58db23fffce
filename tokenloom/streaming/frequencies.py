"""A running frequency list over a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.sources.text import tokens


def stream_tokens(documents: DataFrame, text: str = "text") -> DataFrame:
    """Token rows of a stream (or table) of documents: its columns but the text, token, _token_low."""
    rest = [c for c in documents.columns if c != text]
    return documents.select(*rest, F.explode(tokens(F.col(text))).alias("token")).withColumn("_token_low", F.lower("token"))


def running_frequencies(documents: DataFrame, text: str = "text") -> DataFrame:
    """token, freq so far; write with output mode 'complete' or 'update'."""
    return stream_tokens(documents, text).groupBy(F.col("_token_low").alias("token")).agg(F.count("*").alias("freq"))


def windowed_frequencies(documents: DataFrame, time: str, *, text: str = "text", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """window_start, token, freq by event time; documents later than `late` are dropped, so
    the state stays bounded; works in 'append' mode."""
    rows = documents.select(time, text).withWatermark(time, late)
    counts = stream_tokens(rows, text).groupBy(F.window(time, window), F.col("_token_low").alias("token")).agg(F.count("*").alias("freq"))
    return counts.select(F.col("window.start").alias("window_start"), "token", "freq")
