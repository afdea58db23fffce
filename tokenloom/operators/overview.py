"""Corpus overview (AGG1-AGG9, AGG21, PRD10-PRD12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.expr import ttr
from tokenloom.model import Corpus
from tokenloom.plans.blocks import block_of
from tokenloom.plans.restrict import Restrictions, no_digits, no_punctuation

#: POS values that stand for a missing tag. Fixed values.
DUMMY_TAGS = ("", "##", "###", "##TAG", "TAG", "nan", "None")


def totals(corpus: Corpus, restrictions: Restrictions | None = None) -> DataFrame:
    """AGG1, AGG2: tokens, types, ttr of the corpus or a part of it, one row."""
    counts = corpus.where(restrictions).frequencies
    return counts.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("tokens"), F.count("_token_low").alias("types")).withColumn("ttr", ttr(F.col("types"), F.col("tokens")))


def top_frequencies(corpus: Corpus, limit: int = 20, restrictions: Restrictions | None = None) -> DataFrame:
    """AGG5: the commonest (token, pos) that are neither punctuation nor digits."""
    rows = corpus.where(restrictions).tokens.where(no_punctuation("_token_low") & no_digits("_token_low"))
    counts = rows.groupBy(F.col("_token_low").alias("token"), "pos").agg(F.count("*").alias("frequency"))
    return counts.orderBy(F.desc("frequency"), "token", "pos").limit(limit)


def pos_tags(corpus: Corpus) -> DataFrame:
    """AGG6: the distinct POS tags but those that stand for none."""
    return corpus.tokens.where(F.col("pos").isNotNull() & ~F.col("pos").isin(*DUMMY_TAGS)).select("pos").distinct()


def by_attribute(corpus: Corpus, attribute: str, max_values: int | None = None) -> DataFrame:
    """AGG7, AGG8: value, tokens, types, ttr per value of a column, all values. With
    max_values an attribute of more values is refused with ValueError."""
    counts = corpus.tokens.where(F.col(attribute).isNotNull()).groupBy(F.col(attribute).alias("value"), "_token_low").agg(F.count("*").alias("n"))
    if max_values is not None and counts.select("value").distinct().limit(max_values + 1).count() > max_values:
        raise ValueError(f"{attribute} has more than {max_values} values")
    return counts.groupBy("value").agg(F.sum("n").alias("tokens"), F.count("_token_low").alias("types")).withColumn("ttr", ttr(F.col("types"), F.col("tokens")))


def label_counts(corpus: Corpus, column: str) -> DataFrame:
    """AGG9: tokens per label, null labels left out."""
    return corpus.tokens.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("label")).agg(F.count("*").alias("tokens"))


#: Ids of a block in which the tokens of a sentence are joined first.
PART = 4096


def sentence_texts(corpus: Corpus, numbered_only: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """AGG21: filename, sent_id, text (and further keys): the tokens of each sentence in order.

    Rows without a sentence number (null or 0) are one sentence per file and number, as
    whoever reads a file without sentences sees it; numbered_only leaves them out. The
    tokens of such a group are joined block by block before the blocks are joined, so
    that no task holds them one by one."""
    rows = corpus.tokens.where(F.col("filename").isNotNull())
    if numbered_only:
        rows = rows.where(F.col("sent_id") > 0)
    names = ["filename", "sent_id", *keys]
    words = lambda c: F.array_join(F.transform(c, lambda x: x["token"]), " ")
    parts = rows.groupBy(*names, block_of("id", PART).alias("_b")).agg(F.sort_array(F.collect_list(F.struct("id", "token"))).alias("_w"))
    joined = parts.where(F.exists("_w", lambda x: x["token"].isNotNull())).select(*names, "_b", words("_w").alias("token"))
    grouped = joined.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("_b", "token"))).alias("_w"))
    return grouped.select(*names, words("_w").alias("text"))
