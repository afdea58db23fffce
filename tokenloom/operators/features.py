"""Feature matrices for stylometry (AGG25, WIN3, JN14, STA9, STA12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.model import Corpus
from tokenloom.plans.positions import leads
from tokenloom.plans.restrict import Restrictions, no_punctuation
from tokenloom.session import materialize


def feature_matrix(
    corpus: Corpus,
    group: str = "filename",
    *,
    top: int = 50,
    sizes: tuple[int, ...] = (1,),
    groups: list[str] | None = None,
    exclude_punctuation: bool = True,
    restrictions: Restrictions | None = None,
) -> DataFrame:
    """group, feature, freq in long form: the top n-grams of each size by frequency in
    every group (0 filled in). N-grams lie within runs of rows of one filename and
    sent_id; all sizes are made in one pass. Ties of the top go by the feature. Neighbours
    come from chunks of ids, so that a file without sentence numbers is no single task."""
    rows = corpus.where(restrictions).tokens.where(F.col(group).isNotNull() & F.col("_token_low").isNotNull())
    if groups is not None:
        rows = rows.where(F.col(group).isin(*groups))
    if exclude_punctuation:
        rows = rows.where(no_punctuation("_token_low"))
    widest = max(sizes)
    if widest == 1:
        wide = rows.select(F.col(group).alias("group"), F.col("_token_low").alias("w0"))
    else:
        run = F.xxhash64("filename", "sent_id")
        near = leads(rows.select("id", F.col(group).alias("_g"), "_token_low", run.alias("_s")), ["_g", "_token_low", "_s"], widest, label="features")
        same = [F.when(F.col(f"_s_{k + 1}") == F.col("_s_1"), F.col(f"_token_low_{k + 1}")).alias(f"w{k}") for k in range(widest)]
        wide = near.select(F.col("_g_1").alias("group"), *same)
    grams = [
        F.struct(F.lit(n).alias("size"), F.when(F.col(f"w{n - 1}").isNotNull(), F.concat_ws(" ", *[f"w{k}" for k in range(n)])).alias("feature")) for n in sizes
    ]
    counts = wide.select("group", F.inline(F.array(*grams))).where(F.col("feature").isNotNull()).groupBy("group", "size", "feature").agg(F.count("*").alias("freq"))
    counts = materialize(counts, "features")  # read twice: for the top and for the matrix
    totals = counts.groupBy("size", "feature").agg(F.sum("freq").alias("total"))
    best = totals.withColumn("_r", F.row_number().over(Window.partitionBy("size").orderBy(F.desc("total"), "feature"))).where(F.col("_r") <= top)
    names_ = sorted({r["feature"] for r in best.select("feature").collect()})  # at most top a size
    kept = counts.where(F.col("feature").isin(*names_)).select("group", "feature", "freq")
    present = rows.select(F.col(group).alias("group")).distinct()
    full = present.select("group", F.explode(F.array(*[F.lit(n) for n in names_])).alias("feature")) if names_ else kept.select("group", "feature").limit(0)
    return full.join(kept, ["group", "feature"], "left").fillna(0, ["freq"])


def z_scores(matrix: DataFrame, value: str = "freq") -> DataFrame:
    """STA12: group, feature, z of the raw counts over the groups (ddof 1; a deviation of 0 counts as 1)."""
    per = matrix.groupBy("feature").agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    sd = F.when(F.coalesce("_s", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("_s"))
    return matrix.join(per, "feature").select("group", "feature", ((F.col(value) - F.col("_m")) / sd).alias("z"))


def burrows_delta(z: DataFrame, labels: DataFrame, test: list[str]) -> DataFrame:
    """STA9: group, author, delta: Manhattan distance (a sum) of each test group to the
    mean z of each author's training groups. labels(group, author); all distributed."""
    known = labels.where(F.col("author").isNotNull()).distinct()
    centroids = z.where(~F.col("group").isin(*test)).join(known, "group").groupBy("author", "feature").agg(F.avg("z").alias("_c"))
    return z.where(F.col("group").isin(*test)).join(centroids, "feature").groupBy("group", "author").agg(F.sum(F.abs(F.col("z") - F.col("_c"))).alias("delta"))


def group_authors(corpus: Corpus, author: str, group: str = "filename") -> DataFrame:
    """JN17: group, author: the largest author value of each group."""
    return corpus.tokens.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("group")).agg(F.max(author).alias("author"))


def distances(matrix: DataFrame, value: str = "freq", metric: str = "cityblock", max_groups: int = 5_000) -> DataFrame:
    """a, b (a < b), distance between groups: cityblock or euclidean, by a join on the
    feature. Every pair of groups is a row of the result, so more than max_groups groups
    (checked) are refused with ValueError: choose documents or attribute values."""
    if matrix.select("group").distinct().limit(max_groups + 1).count() > max_groups:
        raise ValueError(f"more than {max_groups} groups")
    left = matrix.select(F.col("group").alias("a"), "feature", F.col(value).alias("x"))
    right = matrix.select(F.col("group").alias("b"), "feature", F.col(value).alias("y"))
    pairs = left.join(right, "feature").where(F.col("a") < F.col("b"))
    d = F.abs(F.col("x") - F.col("y"))
    if metric == "euclidean":
        return pairs.groupBy("a", "b").agg(F.sqrt(F.sum(d * d)).alias("distance"))
    return pairs.groupBy("a", "b").agg(F.sum(d).cast("double").alias("distance"))


def similarity_network(matrix: DataFrame, threshold: float = 0.4, value: str = "freq") -> DataFrame:
    """STA11: a, b, similarity = 1 - d / max d of the cityblock distances, from the threshold on."""
    d = distances(matrix, value)
    top = d.agg(F.max("distance")).first()[0] or 1.0
    return d.select("a", "b", (1 - F.col("distance") / F.lit(float(top))).alias("similarity")).where(F.col("similarity") >= threshold)
