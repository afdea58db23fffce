"""Distribution of matches over the corpus and its metadata (AGG17, AGG18, Q16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.model import Corpus
from tokenloom.plans.dense import dense_number
from tokenloom.plans.positions import matches
from tokenloom.plans.restrict import Restrictions, visible_attributes
from tokenloom.plans.terms import parse_query


def segments(corpus: Corpus, query: str, *, restrictions: Restrictions | None = None, n_segments: int = 100, densify: bool = False) -> DataFrame:
    """position (1 to n_segments), absolute, density (% of the segment), relative_to_peak (%).

    Segment = min(floor(id / size), last) with size = N / n_segments, N the tokens of the
    restricted region while ids stay those of the corpus; densify numbers the region's
    tokens instead (Q16). Empty regions give zeros."""
    region = corpus.where(restrictions)
    found = matches(corpus, parse_query(query), restrictions)
    if densify:
        numbered = dense_number(region.tokens.select("id"), ["id"], "_n", 1, "segments")
        found = found.join(numbered, "id").select(F.col("_n").alias("id"))
    size = max(region.size, 1) / n_segments
    counted = found.select(F.least(F.floor(F.col("id") / F.lit(size)), F.lit(n_segments - 1)).cast("bigint").alias("_s")).groupBy("_s").agg(F.count("*").alias("absolute"))
    grid = corpus.tokens.sparkSession.range(n_segments).withColumnRenamed("id", "_s")
    full = grid.join(counted, "_s", "left").fillna(0, ["absolute"])
    # n_segments rows only
    return full.withColumn("_peak", F.max("absolute").over(Window.partitionBy())).select(
        (F.col("_s") + 1).alias("position"),
        "absolute",
        (F.col("absolute") / F.lit(size) * 100).alias("density"),
        F.when(F.col("_peak") > 0, F.col("absolute") / F.col("_peak") * 100).otherwise(F.lit(0.0)).alias("relative_to_peak"),
    )


def by_attributes(corpus: Corpus, query: str, columns: list[str] | None = None, *, restrictions: Restrictions | None = None) -> DataFrame:
    """attribute, value, absolute, per_million (within the value), relative (% of the
    attribute's largest per_million). Null and blank values are passed over. All
    attributes are counted in one pass over the tokens."""
    columns = visible_attributes(corpus.tokens) if columns is None else columns
    region = corpus.where(restrictions).tokens
    found = matches(corpus, parse_query(query), restrictions).select("id", F.lit(1).alias("_hit"))
    pairs = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in columns])
    long = region.select("id", *columns).join(found, "id", "left").select("_hit", F.inline(pairs)).where(F.trim("value") != "")
    counts = long.groupBy("attribute", "value").agg(F.count("_hit").alias("absolute"), F.count("*").alias("_n")).where(F.col("absolute") > 0)
    rated = counts.withColumn("per_million", F.col("absolute") / F.col("_n") * 1e6).drop("_n")
    peaks = rated.groupBy("attribute").agg(F.max("per_million").alias("_peak"))
    return rated.join(peaks, "attribute").withColumn("relative", F.col("per_million") / F.col("_peak") * 100).drop("_peak")
