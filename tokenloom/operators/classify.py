"""Topic and sentiment of short texts (CLS1-CLS3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seed words of the topics. Fixed values.
TOPIC_SEEDS = {
    "Sport": [
        "match", "game", "score", "player", "team", "tournament", "league", "cup", "football", "basketball", "tennis",
        "golf", "win", "lose", "champion", "stadium", "goal", "coach", "athlete", "medal", "olympic",
    ],
    "Religion": [
        "god", "church", "pray", "faith", "belief", "holy", "bible", "quran", "mosque", "temple", "divine", "soul",
        "spirit", "worship", "sacred", "priest", "monk", "prophet", "religion", "religious", "spiritual",
    ],
    "Science": [
        "study", "research", "data", "experiment", "theory", "method", "analysis", "result", "scientist",
        "laboratory", "physics", "chemistry", "biology", "observation", "evidence", "hypothesis", "technology",
        "scientific", "journal",
    ],
    "Politics": [
        "government", "policy", "law", "election", "vote", "party", "minister", "president", "parliament", "senate",
        "campaign", "candidate", "democracy", "political", "state", "republic", "tax", "regulation", "diplomacy",
    ],
    "Economy": [
        "market", "price", "money", "business", "company", "trade", "finance", "cost", "profit", "loss", "bank",
        "stock", "investment", "growth", "economic", "industry", "supply", "demand", "inflation", "currency",
        "revenue",
    ],
    "Technology": [
        "computer", "software", "internet", "device", "system", "app", "mobile", "digital", "code", "algorithm",
        "network", "server", "user", "interface", "hardware", "processor", "ai", "robot", "tech", "online",
    ],
}
#: Words that turn the valence of a word after them, and how far before it they are
#: looked for; weight of a turned valence; constant of the normal form. Fixed values.
NEGATIONS = ("not", "no", "never", "without", "cannot")
NEGATION_SPAN, TURNED, ALPHA = 3, -0.74, 15.0
GENERAL = "General"


def topics_by_seeds(texts: DataFrame, key: str = "text_id", text: str = "text", *, stop_words: tuple[str, ...] = (), max_terms: int | None = None) -> DataFrame:
    """CLS2: key, topic, score: the topic whose seed list is most similar by tf-idf cosine,
    'General' where no seed word occurs.

    The inverse frequencies are counted over all texts and the six seed lists, not over a
    sample. stop_words are no terms; max_terms keeps the commonest terms only (ties by
    the word), as a bounded vocabulary does; without it every word counts. Ties go to
    the first topic by name. Null texts are General."""
    spark = texts.sparkSession
    seeds = [(t, w) for t, words in TOPIC_SEEDS.items() for w in words if w not in stop_words]
    seed = spark.createDataFrame(seeds, "topic string, word string")
    docs = texts.select(key, F.explode(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))).alias("word"))
    if stop_words:
        docs = docs.where(~F.col("word").isin(*stop_words))
    counts = docs.groupBy(key, "word").agg(F.count("*").alias("tf"))
    if max_terms is not None:
        used = counts.select("word", "tf").unionByName(seed.select("word", F.lit(1).cast("bigint").alias("tf"))).groupBy("word").agg(F.sum("tf").alias("n"))
        terms = used.orderBy(F.desc("n"), "word").limit(max_terms).select("word")
        counts, seed = counts.join(terms, "word", "left_semi"), seed.join(terms, "word", "left_semi")
    n = texts.count() + len(TOPIC_SEEDS)
    frequency = counts.select("word").unionByName(seed.select("word")).groupBy("word").agg(F.count("*").alias("df"))
    idf = frequency.select("word", (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    weighted = counts.join(idf, "word").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    vectors = seed.join(idf, "word").select("topic", "word", F.col("idf").alias("s"))
    sizes = vectors.groupBy("topic").agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("size"))
    # six short seed lists
    products = weighted.join(F.broadcast(vectors), "word").groupBy(key, "topic").agg(F.sum(F.col("w") * F.col("s")).alias("dot"))
    scored = products.join(F.broadcast(sizes), "topic").join(norms, key).withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("size")), 9))
    best = scored.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), "topic")).alias("_b"))
    joined = texts.select(key).join(best, key, "left")
    return joined.select(key, F.coalesce(F.col("_b.topic"), F.lit(GENERAL)).alias("topic"), F.coalesce(-F.col("_b.s"), F.lit(0.0)).alias("score"))


def sentiment(texts: DataFrame, lexicon: DataFrame, key: str = "text_id", text: str = "text") -> DataFrame:
    """CLS1: key, compound, sentiment by a lexicon(word, valence) of the caller: the sum of
    the valences of the words of a text, turned after a negation, in the normal form
    s / sqrt(s^2 + ALPHA). Positive from 0.05, Negative from -0.05 down, else Neutral.

    Words are parted at white space, marks at their edges and case aside, and meet the
    lexicon in a join. Texts without a listed word, and null ones, are Neutral. Of several
    entries of a word the mean counts. Keys are unique."""
    listed = lexicon.where(F.col("word").isNotNull() & F.col("valence").isNotNull()).groupBy(F.lower("word").alias("word")).agg(F.avg("valence").alias("valence"))
    low = F.transform(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"^[.,;:!?\"'()]+|[.,;:!?\"'()]+$", "")))
    words = texts.select(key, low.alias("_w")).select(key, "_w", F.posexplode("_w").alias("_i", "word"))
    start = F.greatest(F.col("_i") - NEGATION_SPAN, F.lit(0))
    turned = F.exists(F.slice("_w", start + 1, F.col("_i") - start), lambda w: w.isin(*NEGATIONS))
    found = words.select(key, "word", turned.alias("_turned")).join(listed, "word").where(F.col("valence") != 0)
    sums = found.groupBy(key).agg(F.sum(F.when(F.col("_turned"), F.col("valence") * TURNED).otherwise(F.col("valence"))).alias("_s"))
    compound = F.coalesce(F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + ALPHA), F.lit(0.0))
    scored = texts.select(key).join(sums, key, "left").select(key, compound.alias("compound"))
    return scored.withColumn("sentiment", F.when(F.col("compound") >= 0.05, "Positive").when(F.col("compound") <= -0.05, "Negative").otherwise("Neutral"))


def discover_topics(texts: DataFrame, n_topics: int = 5, *, key: str = "text_id", text: str = "text", seed: int = 42) -> DataFrame:
    """CLS3: key, topic (number), found without seeds: hashed term frequencies and k-means
    on their tf-idf. Another model than a neural one, with the same interface."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer

    usable = texts.select(key, F.coalesce(text, F.lit("")).alias("_text"))
    stages = [
        RegexTokenizer(inputCol="_text", outputCol="_w", pattern=r"[^\p{L}\p{N}]+", minTokenLength=2),
        HashingTF(inputCol="_w", outputCol="_tf", numFeatures=4096),
        IDF(inputCol="_tf", outputCol="_idf", minDocFreq=2),
        Normalizer(inputCol="_idf", outputCol="features"),
        KMeans(k=n_topics, seed=seed, maxIter=10, featuresCol="features", predictionCol="topic"),
    ]
    return Pipeline(stages=stages).fit(usable).transform(usable).select(key, "topic")
