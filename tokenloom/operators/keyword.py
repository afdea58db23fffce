"""Keywords of a corpus against a reference (AGG15, AGG16, JN7, SRT4, Q23)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.expr import keyword_ll, log_ratio, significance
from tokenloom.model import Corpus
from tokenloom.plans.restrict import Restrictions, no_digits, no_punctuation


def _counts(tokens: DataFrame, *keys: str) -> DataFrame:
    clean = tokens.where(no_punctuation("_token_low") & no_digits("_token_low"))
    return clean.groupBy(*keys, F.col("_token_low").alias("token")).agg(F.count("*").alias("freq"))


def _scored(joined: DataFrame, n1, n2) -> DataFrame:
    o1, o2 = F.col("freq_t"), F.col("freq_r")
    return (
        joined.withColumn("ll", keyword_ll(o1, o2, n1, n2))
        .withColumn("log_ratio", log_ratio(o1, o2, n1, n2))
        .withColumn("significance", significance(F.col("ll")))
        .withColumn("type", F.when(F.col("log_ratio") > 0, "Positive").otherwise("Negative"))
    )


def keywords(
    target: Corpus,
    reference: Corpus | None = None,
    *,
    restrictions: Restrictions | None = None,
    reference_restrictions: Restrictions | None = None,
    min_freq: int = 3,
    ref_freq: DataFrame | None = None,
    ref_total: int = 0,
) -> DataFrame:
    """Words unusually frequent (Positive) or rare (Negative) in the target.

    Columns: token, freq_t, freq_r, ll, log_ratio, significance, type. Punctuation and
    digits are no words, but count in the totals. min_freq prunes the target; tokens of
    the reference that are pruned or absent there enter with freq_t 0, and may even come
    out Positive by the smoothing (Q23). ref_freq (token, freq) stands in for a reference
    corpus, ref_total for its size (its sum if not positive)."""
    part = target.where(restrictions)
    mine = _counts(part.tokens).where(F.col("freq") >= min_freq).withColumnRenamed("freq", "freq_t")
    if ref_freq is not None:
        other = ref_freq.where(F.col("token").isNotNull()).groupBy("token").agg(F.sum("freq").alias("freq_r"))
        n2 = ref_total if ref_total > 0 else int(other.agg(F.coalesce(F.sum("freq_r"), F.lit(0))).first()[0])
    else:
        region = reference.where(reference_restrictions)
        other, n2 = _counts(region.tokens).withColumnRenamed("freq", "freq_r"), region.size
    joined = mine.join(other, "token", "full_outer").fillna(0, ["freq_t", "freq_r"])
    return _scored(joined, F.lit(float(part.size)), F.lit(float(n2)))


def grouped_keywords(target: Corpus, group: str, ref_freq: DataFrame, *, ref_total: int = 0, min_freq: int = 3, max_groups: int = 50, restrictions: Restrictions | None = None) -> DataFrame:
    """One keyword list per value of a column, in one pass: the group column and the
    columns of keywords(). Groups without a token of min_freq are left out, null groups
    too. Tokens of the reference absent from a group enter with freq_t 0, so the rows
    number groups times reference vocabulary; a column of more than max_groups values is
    refused with ValueError."""
    part = target.where(restrictions).tokens.where(F.col(group).isNotNull())
    mine = _counts(part, group).where(F.col("freq") >= min_freq).withColumnRenamed("freq", "freq_t")
    totals = part.groupBy(group).agg(F.count("*").alias("n1"))
    groups = totals.join(mine.select(group).distinct(), group, "left_semi")
    other = ref_freq.where(F.col("token").isNotNull()).groupBy("token").agg(F.sum("freq").alias("freq_r"))
    n2 = ref_total if ref_total > 0 else int(other.agg(F.coalesce(F.sum("freq_r"), F.lit(0))).first()[0])
    present = mine.join(other, "token", "left")
    # the reference's tokens that a group lacks: the list is spread over the groups, then a group's own tokens go
    names = [r[group] for r in groups.select(group).limit(max_groups + 1).collect()]
    if len(names) > max_groups:
        raise ValueError(f"{group} has more than {max_groups} values with keywords")
    if not names:
        lists = other.withColumn(group, F.lit(None).cast(part.schema[group].dataType)).limit(0)
    else:
        lists = other.withColumn(group, F.explode(F.array(*[F.lit(v) for v in names])))
    absent = lists.join(mine.select(group, "token"), [group, "token"], "left_anti").withColumn("freq_t", F.lit(0).cast("bigint"))
    columns = [group, "token", "freq_t", "freq_r"]
    joined = present.select(*columns).unionByName(absent.select(*columns)).fillna(0, ["freq_r"]).join(groups, group)
    return _scored(joined, F.col("n1").cast("double"), F.lit(float(n2))).drop("n1")


def top_keywords(scored: DataFrame, n: int, group: str | None = None) -> DataFrame:
    """SRT4: the n strongest of each type (and group)."""
    keys = [c for c in (group, "type") if c]
    window = Window.partitionBy(*keys).orderBy(F.desc("ll"), "token")
    return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)
