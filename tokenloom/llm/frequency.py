"""Problem 5: frequency of every distinct value or term."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.session import materialize

#: Sentinels that stand for a missing lemma. Fixed values.
NO_LEMMA = ("##", "###")


def term_frequencies(
    corpus: DataFrame,
    freq_list: DataFrame,
    *,
    rare_df: int = 1,
    rare_list_below: int = 5,
    common_percent: int = 15,
) -> DataFrame:
    """Occurrences and documents of every term, with a mark.

    Method: counts per term and document are combined by hash inside each map task
    before the one wide exchange, on (term, doc_id), for tokens and lemmas together;
    occurrences and documents are summed from those partial counts, again combined
    before the exchange, so that neither a frequent term nor a long document meets in
    one task. Rows themselves are never exchanged to find repeated ids: only the ids
    are, and the surplus of the few repeated rows is subtracted.

    Columns: kind ('token' or 'lemma'), term, n (rows, once per id), df (distinct
    doc_id), list_freq (positive frequencies of the reference list, entries trimmed and
    lower-cased), mark: 'common' when 100*df > common_percent*D, else 'rare' when
    df <= rare_df and list_freq < rare_list_below, else null. D counts distinct doc_id.

    Null terms are no terms; rows with null id are left out; rows with null doc_id count
    as occurrences but as no document. Empty tables give an empty result. Extra columns
    of either table are ignored."""
    rows = corpus.where(F.col("id").isNotNull()).select("id", "doc_id", F.col("_token_low").alias("token"), F.when(~F.col("lemma").isin(*NO_LEMMA), F.col("lemma")).alias("lemma"))
    # written first, so that the planner knows their size: few are met by broadcast, many by a join behind a bloom filter
    repeated = materialize(rows.groupBy("id").agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select("id"), "terms-repeated")
    surplus = rows.join(repeated, "id", "left_semi").groupBy("id", "doc_id", "token", "lemma").agg((1 - F.count("*")).alias("w")).where(F.col("w") < 0)
    counted = rows.select("doc_id", "token", "lemma", F.lit(1).cast("bigint").alias("w")).unionByName(surplus.select("doc_id", "token", "lemma", "w"))
    none = F.lit(0).cast("bigint")

    def term(name: str, n_token, n_lemma):
        return F.struct(F.col(name).alias("term"), n_token.alias("n_token"), n_lemma.alias("n_lemma"))

    both = F.array(term("token", F.col("w"), F.col("w")))
    each = F.array(term("token", F.col("w"), none), term("lemma", none, F.col("w")))
    long = counted.select("doc_id", F.inline(F.when(F.col("token") == F.col("lemma"), both).otherwise(each))).where(F.col("term").isNotNull())
    per_document = long.groupBy("term", "doc_id").agg(F.sum("n_token").alias("n_token"), F.sum("n_lemma").alias("n_lemma"))
    summed = per_document.groupBy("term").agg(
        *[F.sum(f"n_{k}").alias(f"n_{k}") for k in ("token", "lemma")],
        *[F.count_if((F.col(f"n_{k}") > 0) & F.col("doc_id").isNotNull()).alias(f"df_{k}") for k in ("token", "lemma")],
    )
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"n_{k}").alias("n"), F.col(f"df_{k}").alias("df")) for k in ("token", "lemma")])
    terms = summed.select("term", F.inline(kinds)).where(F.col("n") > 0).select("kind", "term", "n", "df")
    n_docs = corpus.where(F.col("id").isNotNull()).select("doc_id").where(F.col("doc_id").isNotNull()).distinct().count()
    reference = (
        freq_list.where(F.col("token").isNotNull() & (F.col("freq") > 0))
        .groupBy(F.lower(F.regexp_replace("token", r"^\s+|\s+$", "")).alias("_key"))
        .agg(F.sum("freq").alias("list_freq"))
    )
    joined = terms.join(reference, F.lower("term") == F.col("_key"), "left").drop("_key")
    return joined.withColumn("list_freq", F.coalesce("list_freq", F.lit(0))).withColumn(
        "mark",
        F.when(F.col("df") * 100 > common_percent * n_docs, "common").when(
            (F.col("df") <= rare_df) & (F.col("list_freq") < rare_list_below), "rare"
        ),
    )
