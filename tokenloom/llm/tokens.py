"""Sizes in tokens of a public tokenizer (byte-level BPE, rank file)."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Pre-split pattern published with the rank files. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LOADED: dict = {}


def ship_vocabulary(spark: SparkSession, vocabulary: str) -> None:
    """Send the rank file along with the job, so that executors need no copy of it."""
    spark.sparkContext.addFile(vocabulary)


def _path(vocabulary: str) -> str:
    """The shipped file in a task, the file itself elsewhere."""
    shipped = SparkFiles.get(os.path.basename(vocabulary)) if SparkFiles._is_running_on_worker else vocabulary
    return shipped if os.path.exists(shipped) else vocabulary


def encoding(vocabulary: str):
    """The tokenizer of this process, loaded once."""
    if vocabulary not in _LOADED:
        import tiktoken

        with open(_path(vocabulary), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _LOADED[vocabulary] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[vocabulary]


def token_lengths(text: str, vocabulary: str) -> np.ndarray:
    """Byte length of each token of the text, in order."""
    enc = encoding(vocabulary)
    return np.fromiter((len(b) for b in map(enc.decode_single_token_bytes, enc.encode_ordinary(text))), dtype=np.int64)


def n_tokens(text: Column, vocabulary: str) -> Column:
    """Size of a text in tokens; null for null, 0 for the empty text."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(vocabulary)
        for s in batches:
            yield pd.Series([None if t is None else len(enc.encode_ordinary(t)) for t in s], dtype="Int64")

    return count(text)
