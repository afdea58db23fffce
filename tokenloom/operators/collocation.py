"""Collocations (AGG12-AGG14, JN3, JN8, JN9, SRT2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.expr import collocation_cells, collocation_ll, mutual_information, significance
from tokenloom.model import Corpus
from tokenloom.plans.positions import around, few, matches
from tokenloom.plans.restrict import Restrictions, no_digits, no_punctuation, smart_filter
from tokenloom.plans.terms import parse_query


def collocations(
    corpus: Corpus,
    query: str,
    *,
    window: int = 5,
    min_freq: int = 1,
    limit: int | None = 50,
    restrictions: Restrictions | None = None,
    token_filter: str = "",
    pos_filter: str = "",
    lemma_filter: str = "",
    min_freq_on: str = "side",
) -> DataFrame:
    """Words around a node with log-likelihood and mutual information.

    Columns: collocate, pos, lemma, obs_l, obs_r, observed, total_freq, ll, mi, direction
    (L, R or B by the larger side), significance. The node span is left out of its
    window; overlapping windows count a token more than once. Punctuation and digits are
    no collocates. min_freq acts per side and again on the total (Q2); with
    min_freq_on='total' on the total only. A restriction applies to the node, to the
    total frequencies and to N, not to the tokens in the window (Q4). Ordered by ll, then
    collocate, pos and lemma; limit None gives all."""
    terms = parse_query(query, keep_affixes=True)
    raw = corpus.is_raw and any(t.kind in ("lemma", "pos", "token_pos") for t in terms)
    if raw:  # an untagged corpus has no lemmas: look at the words
        terms = [type(t)("word", t.value) if t.kind == "lemma" else t for t in terms]
    found = matches(corpus, terms, restrictions, raw=raw, alternation=True)
    region = corpus.where(restrictions)
    found, rows = few(found)
    node = found.count() if rows is None else rows.num_rows
    total = region.size
    beside = around(found, corpus.tokens, window, window, ["_token_low", "pos", "lemma"], rows).where(
        ((F.col("offset") < 0) | (F.col("offset") >= F.col("len"))) & no_punctuation("_token_low") & no_digits("_token_low")
    )
    sides = beside.groupBy(F.col("_token_low").alias("collocate"), "pos", F.lower("lemma").alias("lemma")).agg(
        F.count_if(F.col("offset") < 0).alias("obs_l"), F.count_if(F.col("offset") >= 0).alias("obs_r")
    )
    if min_freq_on == "side":
        sides = sides.withColumn("obs_l", F.when(F.col("obs_l") >= min_freq, F.col("obs_l")).otherwise(0)).withColumn(
            "obs_r", F.when(F.col("obs_r") >= min_freq, F.col("obs_r")).otherwise(0)
        )
    seen = sides.withColumn("observed", F.col("obs_l") + F.col("obs_r")).where((F.col("observed") >= min_freq) & (F.col("observed") > 0))
    joined = seen.join(region.frequencies.withColumnRenamed("_token_low", "collocate"), "collocate", "left")
    n = F.lit(float(total))
    full = joined.withColumn("total_freq", F.greatest(F.coalesce("freq", F.lit(0)), F.col("observed"))).drop("freq")
    cells = collocation_cells(F.col("observed"), F.lit(float(node)), F.col("total_freq"), n)
    scored = (
        full.withColumn("ll", collocation_ll(cells, n))
        .withColumn("mi", mutual_information(cells, n))
        .withColumn("direction", F.when(F.col("obs_r") > F.col("obs_l"), "R").when(F.col("obs_l") > F.col("obs_r"), "L").otherwise("B"))
        .withColumn("significance", significance(F.col("ll")))
    )
    for column, text in (("collocate", token_filter), ("pos", pos_filter), ("lemma", lemma_filter)):
        scored = smart_filter(scored, column, text)
    if limit is None:
        return scored
    return scored.orderBy(F.desc("ll"), "collocate", "pos", "lemma").limit(limit)
