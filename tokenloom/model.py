"""The corpus handle: one token table in reading order."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.plans.blocks import distinct_rows
from tokenloom.plans.restrict import Restrictions, predicate
from tokenloom.session import materialize

_LOADED: dict[tuple, Corpus] = {}


def _state(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files of a path: another table has another state."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    state = []
    for f in files or []:
        inner = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(f.getPath())
        state += [(g.getPath().toString(), g.getLen(), g.getModificationTime()) for g in inner]
    return tuple(sorted(state))


@dataclass(frozen=True)
class Corpus:
    """tokens: id bigint (reading order, dense from 1), token, _token_low, pos, lemma,
    sent_id, filename and any metadata; every id once."""

    tokens: DataFrame

    @staticmethod
    def of(table: DataFrame) -> Corpus:
        """A corpus over a stored token table: repeated rows once, rows without id left
        out, _token_low filled in from token where it is null."""
        rows = distinct_rows(table, table.columns).drop("__block")
        return Corpus(rows.withColumn("_token_low", F.coalesce("_token_low", F.lower("token"))))

    def where(self, restrictions: Restrictions | None) -> Corpus:
        """The part that fits the restrictions; the same handle each time, so that what is
        known of it (its size) is counted once."""
        if not restrictions:
            return self
        key = repr(sorted(restrictions.items()))
        if key not in self._parts:
            self._parts[key] = replace(self, tokens=self.tokens.where(predicate(restrictions)))
        return self._parts[key]

    @cached_property
    def _parts(self) -> dict[str, Corpus]:
        return {}

    @staticmethod
    def load(spark: SparkSession, path: str) -> Corpus:
        """The corpus of a stored token table, loaded once a session as the first step of
        any analysis: cleaned like of(), written to the shared folder in id order, so that
        later queries read only their columns and rows. Loading again gives the same handle,
        unless the files at the path have changed."""
        key = (spark.sparkContext.applicationId, path, _state(spark, path))
        if key not in _LOADED:
            rows = Corpus.of(spark.read.parquet(path)).tokens
            _LOADED[key] = Corpus(materialize(rows.repartitionByRange("id").sortWithinPartitions("id"), "corpus"))
        return _LOADED[key]

    @cached_property
    def is_dense(self) -> bool:
        """Ids run from 1 without gaps."""
        r = self.tokens.agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).first()
        return r["n"] == 0 or (r["low"] == 1 and r["high"] == r["n"])

    @cached_property
    def size(self) -> int:
        return self.tokens.select("id").count()

    @cached_property
    def is_raw(self) -> bool:
        """Untagged: no pos column, or more than 99 % of the rows with pos like '##%'."""
        if "pos" not in self.tokens.columns:
            return True
        r = self.tokens.agg(F.count("*").alias("n"), F.count_if(F.col("pos").startswith("##")).alias("raw")).first()
        return r["n"] > 0 and r["raw"] / r["n"] > 0.99

    @property
    def frequencies(self) -> DataFrame:
        """AGG4: _token_low, freq."""
        return self.tokens.groupBy("_token_low").agg(F.count("*").alias("freq"))
