"""Statistical tests (STA1-STA4, STA13, AGG22-AGG24, AGG26, JN12, JN13, WIN5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.expr import chi2_yates, cohen_h, correlation_label, stars, ttr
from tokenloom.functions.special import chi2_p, correlation_p
from tokenloom.model import Corpus
from tokenloom.plans.dense import running
from tokenloom.plans.positions import matches, with_text
from tokenloom.plans.restrict import Restrictions
from tokenloom.plans.terms import compile_term, parse_query


def _hits(corpus: Corpus, query: str, restrictions: Restrictions | None, columns: list[str]) -> DataFrame:
    """id, word and columns of every match of a one-term query; several terms are refused."""
    terms = parse_query(query, alternatives=True)
    if len(terms) != 1:
        raise ValueError("one term only")
    if terms[0].kind == "tag":
        found = with_text(matches(corpus, terms, restrictions), corpus.tokens, name="word")
        return found.join(corpus.tokens.select("id", *columns), "id").select("id", F.lower("word").alias("word"), *columns)
    raw = corpus.is_raw if terms[0].kind in ("lemma", "pos", "token_pos") else False
    rows = corpus.where(restrictions).tokens.where(compile_term(terms[0], raw=raw))
    return rows.select("id", F.lower("token").alias("word"), *columns)


def preview(corpus: Corpus, query: str, *, min_freq: int = 1, limit: int = 20, restrictions: Restrictions | None = None) -> DataFrame:
    """AGG26: word, freq of the commonest matches."""
    counts = _hits(corpus, query, restrictions, []).groupBy("word").agg(F.count("*").alias("freq")).where(F.col("freq") >= min_freq)
    return counts.orderBy(F.desc("freq"), "word").limit(limit)


def compare_groups(
    corpus: Corpus,
    query: str,
    attribute: str,
    groups: tuple[str, str],
    *,
    min_freq: int = 5,
    correction: str = "bonferroni",
    restrictions: Restrictions | None = None,
) -> DataFrame:
    """STA1, STA2: each matched word in two groups: word, freq_1, freq_2, prop_1, prop_2,
    chi2 (Yates), p_value, effect_size (Cohen's h), p_corrected, significance.

    Words of at least min_freq over both groups are tested. correction: bonferroni, bh or
    none; with one word nothing is corrected. The labels go by the corrected value (Q13:
    the test is always chi-squared)."""
    g1, g2 = groups
    rows = _hits(corpus, query, restrictions, [attribute]).where(F.col(attribute).cast("string").isin(g1, g2))
    value = F.col(attribute).cast("string")
    sizes = corpus.where(restrictions).tokens.agg(F.count_if(value == g1).alias("a"), F.count_if(value == g2).alias("b")).first()
    counts = rows.groupBy("word").agg(F.count_if(value == g1).alias("freq_1"), F.count_if(value == g2).alias("freq_2"))
    counts = counts.where(F.col("freq_1") + F.col("freq_2") >= max(1, min_freq))
    t1, t2 = F.lit(float(sizes["a"])), F.lit(float(sizes["b"]))
    p1 = F.when(t1 > 0, F.col("freq_1") / t1).otherwise(F.lit(0.0))
    p2 = F.when(t2 > 0, F.col("freq_2") / t2).otherwise(F.lit(0.0))
    tested = (
        counts.withColumn("prop_1", p1)
        .withColumn("prop_2", p2)
        .withColumn("chi2", chi2_yates(F.col("freq_1"), t1, F.col("freq_2"), t2))
        .withColumn("effect_size", cohen_h(F.col("prop_1"), F.col("prop_2")))
        .withColumn("p_value", chi2_p(F.col("chi2")))
    )
    return adjusted(tested, correction).withColumn("significance", stars(F.col("p_corrected")))


def adjusted(tested: DataFrame, method: str) -> DataFrame:
    """p_corrected by Bonferroni or Benjamini-Hochberg (Q33).

    The Benjamini-Hochberg minimum from the top runs over the tests in p order; equal p
    share the last of their ranks, which leaves the minimum as it is, so the running
    minimum is kept on the distinct p values only, range by range."""
    if method == "none":
        return tested.withColumn("p_corrected", F.col("p_value"))
    m = tested.count()
    if m <= 1:
        return tested.withColumn("p_corrected", F.col("p_value"))
    if method == "bonferroni":
        return tested.withColumn("p_corrected", F.least(F.col("p_value") * m, F.lit(1.0)))
    values = running(tested.groupBy("p_value").agg(F.count("*").alias("_n")), "p_value", "_n", "_rank", label="ranks")
    stepped = values.withColumn("_step", F.col("p_value") * m / F.col("_rank"))
    ranked = running(stepped, "p_value", "_step", "_low", how="min", descending=True, label="steps")
    return tested.join(ranked.select("p_value", F.least("_low", F.lit(1.0)).alias("p_corrected")), "p_value")


def frequency_vector(corpus: Corpus, query: str, group: str = "filename", restrictions: Restrictions | None = None) -> DataFrame:
    """AGG22: group, value: matches per group (groups without any are absent)."""
    return _hits(corpus, query, restrictions, [group]).where(F.col(group).isNotNull()).groupBy(F.col(group).alias("group")).agg(F.count("*").cast("double").alias("value"))


def metadata_vector(corpus: Corpus, attribute: str, group: str = "filename", restrictions: Restrictions | None = None) -> DataFrame:
    """AGG23: group, value: mean of an attribute's distinct numeric values per group."""
    rows = corpus.where(restrictions).tokens.where(F.col(group).isNotNull())
    numeric = rows.select(F.col(group).alias("group"), F.expr(f"try_cast(`{attribute}` AS double)").alias("value")).where(F.col("value").isNotNull()).distinct()
    return numeric.groupBy("group").agg(F.avg("value").alias("value"))


def metric_vector(corpus: Corpus, metric: str, group: str = "filename", restrictions: Restrictions | None = None) -> DataFrame:
    """AGG24: group, value of ttr, token_count or type_count."""
    counts = corpus.where(restrictions).tokens.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("group"), "_token_low").agg(F.count("*").alias("n"))
    sums = counts.groupBy("group").agg(F.sum("n").alias("tokens"), F.count("_token_low").alias("types"))
    column = {"ttr": ttr(F.col("types"), F.col("tokens")), "token_count": F.col("tokens").cast("double"), "type_count": F.col("types").cast("double")}[metric]
    return sums.select("group", column.alias("value"))


def correlation(x: DataFrame, y: DataFrame, *, method: str = "pearson", zero_fill: bool = False) -> DataFrame:
    """STA4: n, r, p_value, label of two (group, value) vectors, one row.

    Groups present on one side only are dropped, or count as 0 with zero_fill (Q15).
    Fewer than three groups give null r. Spearman works on average ranks."""
    both = x.select("group", F.col("value").alias("x")).join(y.select("group", F.col("value").alias("y")), "group", "full_outer" if zero_fill else "inner")
    both = both.fillna(0.0, ["x", "y"]) if zero_fill else both
    if method == "spearman":
        for c in ("x", "y"):
            ranks = both.groupBy(c).agg(F.count("*").alias("_n"))
            ranks = running(ranks, c, "_n", "_up", label="ranks").withColumn("_r", F.col("_up") - (F.col("_n") - 1) / 2)
            both = both.join(ranks.select(c, "_r"), c).drop(c).withColumnRenamed("_r", c)
    r = both.agg(F.count("*").alias("n"), F.corr("x", "y").alias("r")).first()
    usable = r["n"] >= 3 and r["r"] is not None and r["r"] == r["r"]
    value = r["r"] if usable else None
    out = x.sparkSession.createDataFrame([(r["n"], value, correlation_p(value, r["n"]) if usable else None)], "n bigint, r double, p_value double")
    return out.withColumn("label", F.when(F.col("r").isNotNull(), correlation_label(F.col("r"))))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
