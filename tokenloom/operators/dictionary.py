"""Dictionary entries (AGG19, AGG20, DIC1-DIC3, SMP2, SMP3, PRJ10)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.expr import band, pmw, zipf
from tokenloom.model import Corpus
from tokenloom.operators.collocation import collocations
from tokenloom.plans.positions import around, few
from tokenloom.plans.restrict import PUNCT, Restrictions
from tokenloom.session import materialize

#: The nine frames of a node in its context: name and offsets. Fixed values.
FRAMES = (
    ("bigram_left", (-1, 0)), ("bigram_right", (0, 1)),
    ("trigram_left", (-2, -1, 0)), ("trigram_middle", (-1, 0, 1)), ("trigram_right", (0, 1, 2)),
    ("fourgram_1", (-3, -2, -1, 0)), ("fourgram_2", (-2, -1, 0, 1)), ("fourgram_3", (-1, 0, 1, 2)), ("fourgram_4", (0, 1, 2, 3)),
)


def lemma_forms(corpus: Corpus, word: str, restrictions: Restrictions | None = None) -> DataFrame:
    """AGG19, JN16: every (token, pos, lemma) of the lemmas that the word belongs to, with
    freq, per_million, zipf and band."""
    region = corpus.where(restrictions)
    tokens = region.tokens
    lemmas = tokens.where(F.col("_token_low") == word.lower()).select(F.lower("lemma").alias("_l")).where(F.col("_l").isNotNull()).distinct()
    forms = (
        tokens.withColumn("_l", F.lower("lemma"))
        .join(lemmas, "_l", "left_semi")
        .groupBy(F.col("_token_low").alias("token"), "pos", F.col("_l").alias("lemma"))
        .agg(F.count("*").alias("freq"))
    )
    rated = forms.withColumn("per_million", pmw(F.col("freq"), F.lit(region.size)))
    z = zipf(F.col("per_million"))
    return rated.withColumn("zipf", F.round(z, 2)).withColumn("band", band(z))


def nearest(kept: DataFrame, word: str, n: int, reach: int = 16) -> DataFrame:
    """id and _at, a map from offset to word, of every occurrence of a word: itself and the
    n rows before and after it, by order, not by id.

    Only the ids within `reach` of an occurrence are read; occurrences that find fewer
    than n rows on a side there are looked at again within four times as many, until
    the ends of the corpus are reached."""
    nodes = kept.where(F.col("_token_low") == word).select("id", F.lit(1).cast("bigint").alias("len"))
    nodes, rows = few(nodes)
    ends = kept.agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
    done = []
    while True:
        lines = around(nodes, kept, reach, reach, ["_token_low"], rows)
        packed = lines.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("offset", F.col("_token_low").alias("t")))).alias("_w"))
        before = F.reverse(F.filter("_w", lambda x: x["offset"] < 0))
        after = F.filter("_w", lambda x: x["offset"] > 0)
        sides = packed.select("id", before.alias("_b"), after.alias("_a"))
        row = F.concat(
            F.array(F.struct(F.lit(0).cast("bigint").alias("o"), F.lit(word).alias("t"))),
            F.transform(F.slice("_b", 1, n), lambda x, i: F.struct((-1 - i).cast("bigint").alias("o"), x["t"].alias("t"))),
            F.transform(F.slice("_a", 1, n), lambda x, i: F.struct((i + 1).cast("bigint").alias("o"), x["t"].alias("t"))),
        )
        whole = ((F.size("_b") >= n) | (F.col("id") - reach <= F.lit(ends["low"]))) & ((F.size("_a") >= n) | (F.col("id") + reach >= F.lit(ends["high"])))
        sides = materialize(sides.select("id", F.map_from_entries(row).alias("_at"), whole.alias("_whole")), "nearest")
        done.append(sides.where("_whole").select("id", "_at"))
        open_ = sides.where(~F.col("_whole"))
        if open_.isEmpty():
            return reduce(lambda a, b: a.unionByName(b), done)
        nodes, rows = few(open_.select("id", F.lit(1).cast("bigint").alias("len")))
        reach *= 4


def context_ngrams(corpus: Corpus, word: str, *, top: int = 5, restrictions: Restrictions | None = None) -> DataFrame:
    """AGG20, WIN2: the commonest bigrams, trigrams and four-grams around a word by frame:
    frame, ngram, frequency, first_id (of its first occurrence), rank. Punctuation is left out before neighbours are looked
    at, so frames bridge it; contexts cross sentence boundaries."""
    kept = corpus.where(restrictions).tokens.where(~F.col("_token_low").isin(*PUNCT) & F.col("_token_low").isNotNull())
    wide = nearest(kept, word.lower(), 3)
    pieces = [
        F.struct(F.lit(name).alias("frame"), F.array(*[F.element_at("_at", F.lit(o).cast("bigint")) for o in offsets]).alias("words"))
        for name, offsets in FRAMES
    ]
    long = wide.select("id", F.inline(F.array(*pieces))).where(~F.exists("words", lambda w: w.isNull()))
    counts = long.groupBy("frame", F.array_join("words", " ").alias("ngram")).agg(F.count("*").alias("frequency"), F.min("id").alias("first_id"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("frequency"), "ngram")))
    return ranked.where(F.col("rank") <= top)


def excerpt(words: Column, at: Column, width: int = 7) -> Column:
    """PRJ10: up to width words either side of word number at (from 1), the word in bold,
    dots where something is cut off, no space before marks."""
    low, n = F.greatest(at - width, F.lit(1)), F.size(words)
    high = F.least(at + width, n)
    shown = F.transform(F.slice(words, low, high - low + 1), lambda w, i: F.when(i + low == at, F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w))
    text = F.regexp_replace(F.array_join(shown, " "), r"\s+([.,!?;:])", "$1")
    return F.concat(F.when(low > 1, "... ").otherwise(""), text, F.when(high < n, " ...").otherwise(""))


def _sentences_with(corpus: Corpus, nodes: DataFrame) -> DataFrame:
    keys = nodes.where(F.col("filename").isNotNull() & (F.col("sent_id") > 0)).select("filename", "sent_id").distinct()
    rows = corpus.tokens.join(keys, ["filename", "sent_id"], "left_semi")
    return rows.groupBy("filename", "sent_id").agg(F.sort_array(F.collect_list(F.struct("id", "token"))).alias("_w"))


def sentence_lengths(corpus: Corpus, word: str) -> DataFrame:
    """JN6: filename, sent_id, length of every numbered sentence with the word."""
    nodes = corpus.tokens.where(F.col("_token_low") == word.lower()).select("filename", "sent_id")
    return _sentences_with(corpus, nodes).select("filename", "sent_id", F.size("_w").alias("length"))


def with_lookup(rows: DataFrame, lookup: DataFrame, key: str = "token", word: str = "word") -> DataFrame:
    """FN12: rows with the columns of a word list (level, pronunciation or whatever the
    caller has) by the word without case, null where it is not listed. Of several entries
    of a word the least is taken, so rows never multiply."""
    values = [c for c in lookup.columns if c != word]
    one = lookup.where(F.col(word).isNotNull()).groupBy(F.lower(F.trim(word)).alias("_k")).agg(F.min(F.struct(*values)).alias("_v"))
    return rows.join(one, F.lower(F.col(key)) == F.col("_k"), "left").select(*[rows[c] for c in rows.columns], *[F.col(f"_v.{c}").alias(c) for c in values])


def examples(corpus: Corpus, word: str, *, prefer_below: int = 15, seed: int | None = 42, restrictions: Restrictions | None = None) -> DataFrame:
    """DIC1, WIN4: one example per POS of a word: pos, filename, sent_id, length, example.
    Sentences below prefer_below tokens come first, then the shortest; ties fall to a
    seeded hash instead of chance, or with seed None to the first by id. Sentences are (filename, sent_id) (Q19)."""
    nodes = corpus.where(restrictions).tokens.where(F.col("_token_low") == word.lower()).select("id", "pos", "filename", "sent_id")
    sentences = _sentences_with(corpus, nodes)
    joined = nodes.join(sentences, ["filename", "sent_id"]).withColumn("length", F.size("_w"))
    order = [F.col("length") >= prefer_below, F.col("length"), *([] if seed is None else [F.xxhash64("id", F.lit(seed))]), F.col("id")]
    first = joined.withColumn("_r", F.row_number().over(Window.partitionBy("pos").orderBy(*order))).where(F.col("_r") == 1)
    at = F.array_position(F.transform("_w", lambda x: x["id"]), F.col("id")).cast("int")
    return first.select("pos", "filename", "sent_id", "length", excerpt(F.transform("_w", lambda x: x["token"]), at).alias("example"))


def random_sentences(corpus: Corpus, word: str, n: int = 5, seed: int = 42) -> DataFrame:
    """SMP2: n sentences with the word, drawn by a seeded hash: filename, sent_id, text."""
    nodes = corpus.tokens.where(F.col("_token_low") == word.lower()).select("filename", "sent_id")
    keys = nodes.where(F.col("filename").isNotNull() & (F.col("sent_id") > 0)).distinct().orderBy(F.xxhash64("filename", "sent_id", F.lit(seed)), "filename", "sent_id").limit(n)
    return _sentences_with(corpus, keys).select("filename", "sent_id", F.array_join(F.transform("_w", lambda x: x["token"]), " ").alias("text"))


def related_forms(corpus: Corpus, word: str, limit: int = 50) -> DataFrame:
    """SMP3: distinct words that begin with the word, the first in order."""
    low = corpus.tokens.where(F.col("_token_low").startswith(word.lower()) & (F.col("_token_low") != word.lower())).select(F.col("_token_low").alias("form"))
    return low.distinct().orderBy("form").limit(limit)


def entry(corpus: Corpus, word: str) -> DataFrame:
    """DIC2: one row: word, freq, per_million, zipf, band, patterns and collocates.

    patterns: per frame of two, three and four words the 2, 3 and 4 commonest, each with
    its frequency and the first line that shows it; collocates: the 20 strongest (window
    5, at least 3)."""
    low = word.lower()
    n = corpus.size
    head = corpus.tokens.where(F.col("_token_low") == low).agg(F.count("*").alias("freq")).withColumn("per_million", pmw(F.col("freq"), F.lit(n)))
    z = zipf(F.col("per_million"))
    picks = F.when(F.col("frame").startswith("bi"), 2).when(F.col("frame").startswith("tri"), 3).otherwise(4)
    best = context_ngrams(corpus, low, top=4).where(F.col("rank") <= picks)
    patterns = best.agg(F.array_sort(F.collect_list(F.struct("frame", "rank", "ngram", "frequency", "first_id"))).alias("patterns"))
    top = collocations(corpus, low, window=5, min_freq=3, limit=20).agg(F.array_sort(F.collect_list("collocate")).alias("collocates"))
    one = F.lit(1)
    return (
        head.select(F.lit(low).alias("word"), "freq", "per_million", F.round(z, 2).alias("zipf"), band(z).alias("band"), one.alias("_k"))
        .join(patterns.withColumn("_k", one), "_k")
        .join(top.withColumn("_k", one), "_k")
        .drop("_k")
    )


def collocate_examples(corpus: Corpus, word: str, *, window: int = 5, n: int = 10, min_freq: int = 3) -> DataFrame:
    """DIC3: the first line with each of the n strongest collocates, all in one job:
    collocate, ll, match_id, line."""
    best = collocations(corpus, word, window=window, min_freq=min_freq, limit=n).groupBy("collocate").agg(F.max("ll").alias("ll"))
    nodes = corpus.tokens.where(F.col("_token_low") == word.lower()).select("id", F.lit(1).cast("bigint").alias("len"))
    lines = around(nodes, corpus.tokens, window, window, ["token", "_token_low"])
    hit = lines.where(F.col("offset") != 0).join(F.broadcast(best), lines["_token_low"] == best["collocate"]).groupBy("collocate", "ll").agg(F.min("id").alias("id"))
    shown = lines.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("offset", "token"))).alias("_w"))
    return hit.join(shown, "id").select("collocate", "ll", F.col("id").alias("match_id"), F.array_join(F.transform("_w", lambda x: x["token"]), " ").alias("line"))
