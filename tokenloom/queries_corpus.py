"""Queries of the corpus operators, named by their inventory ids, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.functions import expr
from tokenloom.model import Corpus
from tokenloom.functions import g2p
from tokenloom.operators import annotate, classify, collocation, compare, dictionary, distribution, features, keyword, kwic, multivariate, ngram, overview, pattern_groups, stats
from tokenloom.plans import nl_rules, patterns, positions, restrict
from tokenloom.plans.terms import parse_query
from tokenloom.sources import loader
from tokenloom.sources import tables as side
from tokenloom.sources import text as plain
from tokenloom.sources import xml
from tokenloom.streaming import frequencies as streaming
from tokenloom.session import table

TAG_QUERY = '<PN type="human"> was'


def corpus(spark, d) -> Corpus:
    return Corpus.load(spark, f"{d}/corpus.parquet")


def reference_list(spark, d):
    """The frequency list as a reference: words lower-cased and trimmed, positive counts."""
    rows = table(spark, d, "freq_list").where(F.col("token").isNotNull() & (F.col("freq") > 0))
    return rows.groupBy(F.lower(F.trim("token")).alias("token")).agg(F.sum("freq").alias("freq"))


def _part(spark, d, lang) -> Corpus:
    return Corpus(corpus(spark, d).tokens.where(F.col("lang") == lang))


def _matches(query, **options):
    return lambda s, d: positions.with_text(positions.matches(corpus(s, d), parse_query(query), options.get("restrictions")), corpus(s, d).tokens)


def _bands(spark, d):
    counts = corpus(spark, d).frequencies
    total = corpus(spark, d).size
    rated = counts.withColumn("per_million", expr.pmw(F.col("freq"), F.lit(total)))
    z = expr.zipf(F.col("per_million"))
    return rated.select(F.col("_token_low").alias("token"), "freq", "per_million", F.round(z, 6).alias("zipf"), expr.band(z).alias("band")).where(F.col("token").isNotNull())


#: Valences for the sentiment query; a real lexicon is the caller's.
LEXICON = {
    "good": 1.9, "great": 3.1, "friend": 2.0, "honesty": 1.6, "bright": 1.5, "famous": 1.4, "gentle": 1.2, "ready": 1.2, "careful": 0.9, "quiet": 0.4,
    "old": -0.2, "narrow": -0.3, "heavy": -0.4, "cold": -0.5, "strange": -0.6, "empty": -0.8, "forget": -0.9, "struck": -1.0, "warned": -1.1, "missing": -1.2,
    "dispute": -1.2, "lost": -1.3, "delay": -1.3, "useless": -1.8, "fails": -2.0,
}


def _texts(spark, d, lang=None):
    part = corpus(spark, d) if lang is None else _part(spark, d, lang)
    return overview.sentence_texts(part).select(F.concat_ws(":", "filename", "sent_id").alias("text_id"), "text")


def _sentiment(spark, d):
    lexicon = spark.createDataFrame(sorted(LEXICON.items()), "word string, valence double")
    return _rounded(classify.sentiment(_texts(spark, d), lexicon), "compound")


def _shared_words(spark, d):
    words = [_part(spark, d, g).frequencies.where(F.col("_token_low").isNotNull()) for g in ("en", "id")]
    return compare.compare(*words, "_token_low", {"freq": "freq"})[0]


def _lines(spark, d, limit):
    lines = pattern_groups.node_lines(corpus(spark, d), "lamp", limit=limit)
    return lines.select("id", F.array_join(F.transform("line", lambda x: F.concat_ws("/", x["token"], x["pos"], x["lemma"])), " ").alias("line"))


def _plain(spark, d):
    documents = table(spark, d, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("filename"), "text")
    return plain.build(plain.plain_rows(documents))


def _vertical(spark, d):
    c = corpus(spark, d).tokens.where(F.col("filename").isNotNull() & F.col("token").isNotNull())
    line = F.concat_ws("\t", "token", F.coalesce("pos", F.lit("")), F.coalesce("lemma", F.lit("")))
    by_block = c.groupBy("filename", F.floor(F.col("id") / 4096).alias("block")).agg(F.sort_array(F.collect_list(F.struct("id", line.alias("line")))).alias("_w"))
    texts = by_block.select(F.concat_ws("#", "filename", F.lpad(F.col("block").cast("string"), 12, "0")).alias("filename"), F.array_join(F.transform("_w", lambda x: x["line"]), "\n").alias("text"))
    return plain.build(plain.vertical_rows(texts))


def _xml(spark, d):
    return table(spark, d, "raw_records").where(F.col("fmt") == "xml").select(F.lpad(F.col("record_id").cast("string"), 12, "0").alias("filename"), F.col("body").alias("text")).distinct()


def _shared_ngrams(spark, d):
    return compare.compare(
        ngram.ngrams(_part(spark, d, "en"), 2, restrictions={"lang": ["en"]}, min_freq=1), ngram.ngrams(_part(spark, d, "id"), 2, restrictions={"lang": ["id"]}, min_freq=1),
        "ngram", {"frequency": "freq", "per_million": "rel"},
    )


def _matrix(spark, d, **options):
    return features.feature_matrix(corpus(spark, d), "lang", **options)


def _loaded(spark, d):
    texts = table(spark, d, "documents").select(F.format_string("d%012d.txt", "doc_id").alias("filename"), "text")
    marked = _xml(spark, d).select(F.concat(F.lit("r"), "filename", F.lit(".xml")).alias("filename"), "text")
    return loader.load(texts.unionByName(marked), language="English").tokens.groupBy("filename").agg(F.count("*").alias("tokens"), F.count("pn_len").alias("spans"))


def _annotations(spark, d):
    rows = corpus(spark, d).tokens.where(F.col("_token_low") == "people").select("id", F.lit("sense").alias("attribute"), F.concat(F.lit("p"), F.col("pos")).alias("value"), F.lit(1).alias("n"))
    again = rows.where(F.col("id") % 2 == 0).select("id", "attribute", F.lit("changed").alias("value"), F.lit(2).alias("n"))
    return rows.unionByName(again)


#: Plain sentences, one of each form that tells the order of words, and what their terms ask of the tokens.
ASKED = {
    "find a determiner followed by an adjective followed by a noun": ("pos = 'DT'", "pos = 'JJ'", "pos = 'NN'"),
    "find a preposition followed by a determiner and a noun": ("pos = 'IN'", "pos = 'DT'", "pos = 'NN'"),
    "a word beginning with bri followed by a noun": ("starts_with(_token_low, 'bri')", "pos = 'NN'"),
    "lamp preceded by determiner": ("pos = 'DT'", "_token_low = 'lamp'"),
    "a word ending with er before anything": ("ends_with(_token_low, 'er')", "_token_low IS NOT NULL"),
    "search for river after a word containing amo": ("contains(_token_low, 'amo')", "_token_low = 'river'"),
    "nouns following adjectives": ("pos = 'JJ'", "pos = 'NN'"),
    "river and any word": ("_token_low = 'river'", "_token_low IS NOT NULL"),
    "preposition preceding pronoun": ("pos = 'IN'", "pos = 'PRP'"),
}


def _nl(spark, d):
    c = corpus(spark, d)
    found = [positions.matches(c, parse_query(nl_rules.parse(asked)["query"])).select(F.lit(asked).alias("asked"), "id", "len") for asked in ASKED]
    return stats.union_all(found)


def _nl_sql() -> str:
    parts = []
    for asked, tests in ASKED.items():
        joins = " ".join(f"JOIN (SELECT * FROM c WHERE {t}) t{k} ON t{k}.id = t0.id + {k}" for k, t in enumerate(tests) if k)
        parts.append(f"SELECT '{asked}' AS asked, t0.id, CAST({len(tests)} AS BIGINT) AS len FROM (SELECT * FROM c WHERE {tests[0]}) t0 {joins}")
    return f"{_C} " + " UNION ALL ".join(parts)


PATTERNS, _ = patterns.parse_definitions("of : <> of (_DT) #\nbefore : # <>\nand : <> and #\nfar : <> + + #")


def _rounded(df, *columns, places=6):
    for c in columns:
        df = df.withColumn(c, F.round(c, places))
    return df


def queries() -> dict:
    return {
        "CON1_kwic": lambda s, d: kwic.kwic(corpus(s, d), "the", left=5, right=5, limit=1000, metadata=False).drop("collocate", "metadata"),
        "CON1_kwic_metadata": lambda s, d: kwic.kwic(corpus(s, d), "people", limit=None).drop("collocate"),
        "PRJ9_kwic_tags": lambda s, d: kwic.kwic(corpus(s, d), "lamp", left=3, right=3, limit=None, show_pos=True, show_lemma=True, metadata=False).drop("collocate", "metadata"),
        "CON3_kwic_collocate": lambda s, d: kwic.kwic(corpus(s, d), "the", limit=None, collocate="lamp", window=3, metadata=False).drop("metadata"),
        "AGG10_breakdown": lambda s, d: kwic.breakdown(corpus(s, d), "th*"),
        "AGG28_frequency": lambda s, d: positions.matches(corpus(s, d), parse_query("the")).agg(F.count("*").alias("n")),
        "PRD1_word": _matches("people"),
        "PRD2_wildcard": _matches("bri*ge"),
        "PRD3_lemma": _matches("[be]"),
        "PRD4_pos": lambda s, d: positions.matches(corpus(s, d), parse_query("_VB*|IN")),
        "PRD5_token_pos": _matches("the_DT"),
        "PRD6_tag": _matches(TAG_QUERY),
        "PRD8_restriction_list": _matches("the", restrictions={"lang": ["en"], "speaker": ["SPK0054", "SPK0001"]}),
        "PRD9_restriction_range": _matches("the", restrictions={"year": (2000, 2010)}),
        "PRD11_integer_columns": lambda s, d: restrict.integer_columns(corpus(s, d).tokens, ["lang", "speaker", "year", "pn_len", "topic"]),
        "PRD12_range": lambda s, d: restrict.value_range(corpus(s, d).tokens, "year"),
        "PRD12_domain": lambda s, d: restrict.value_domain(corpus(s, d).tokens, "topic"),
        "JN1_sequence": _matches("in the _NN"),
        "PRJ5_bands": _bands,
        "AGG1_totals": lambda s, d: overview.totals(corpus(s, d)),
        "AGG2_restricted_totals": lambda s, d: overview.totals(corpus(s, d), {"lang": ["de", "fr"]}),
        "AGG4_frequencies": lambda s, d: corpus(s, d).frequencies,
        "AGG5_top": lambda s, d: overview.top_frequencies(corpus(s, d), 100),
        "AGG6_pos_tags": lambda s, d: overview.pos_tags(corpus(s, d)),
        "AGG7_files": lambda s, d: overview.by_attribute(corpus(s, d), "filename"),
        "AGG8_attribute": lambda s, d: overview.by_attribute(corpus(s, d), "lang"),
        "AGG9_labels": lambda s, d: overview.label_counts(corpus(s, d), "topic"),
        "AGG21_sentences": lambda s, d: overview.sentence_texts(corpus(s, d)),
        "AGG12_collocations": lambda s, d: collocation.collocations(corpus(s, d), "[be]", window=4, min_freq=2, limit=200),
        "AGG12_collocations_restricted": lambda s, d: collocation.collocations(corpus(s, d), "the", window=2, limit=None, restrictions={"lang": ["en"], "year": (2005, 2015)}),
        "AGG11_bigrams": lambda s, d: ngram.ngrams(corpus(s, d), 2, min_freq=2),
        "AGG11_trigrams_filtered": lambda s, d: ngram.ngrams(corpus(s, d), 3, restrictions={"lang": ["en"]}, skip_punctuation=True, slots={1: "t*", 3: "-_NN"}, min_freq=2),
        "SRT3_top_ngrams": lambda s, d: ngram.ngrams(corpus(s, d), 2, top=100),
        "AGG11_pos_trigrams": lambda s, d: ngram.ngrams(corpus(s, d), 3, basis="p", negative=["the"]),
        "AGG15_keywords": lambda s, d: _rounded(keyword.keywords(_part(s, d, "en"), _part(s, d, "id")), "ll", "log_ratio"),
        "AGG15_keywords_list": lambda s, d: _rounded(keyword.keywords(_part(s, d, "en"), ref_freq=reference_list(s, d)), "ll", "log_ratio"),
        "AGG16_grouped_keywords": lambda s, d: _rounded(keyword.grouped_keywords(corpus(s, d), "lang", reference_list(s, d)), "ll", "log_ratio"),
        "SRT4_top_keywords": lambda s, d: keyword.top_keywords(_rounded(keyword.keywords(_part(s, d, "en"), _part(s, d, "id")), "ll", "log_ratio"), 25),
        "AGG19_lemma_forms": lambda s, d: dictionary.lemma_forms(corpus(s, d), "was"),
        "AGG20_context_ngrams": lambda s, d: dictionary.context_ngrams(corpus(s, d), "lamp"),
        "DIC1_examples": lambda s, d: dictionary.examples(corpus(s, d), "people", seed=None),
        "DIC2_entry": lambda s, d: dictionary.entry(corpus(s, d), "lamp"),
        "DIC3_collocate_examples": lambda s, d: _rounded(dictionary.collocate_examples(corpus(s, d), "lamp"), "ll"),
        "SMP2_random_sentences": lambda s, d: dictionary.random_sentences(corpus(s, d), "lamp", 5),
        "SMP3_related_forms": lambda s, d: dictionary.related_forms(corpus(s, d), "the"),
        "SET1_shared_vocabulary": _shared_words,
        "SRT5_by_difference": lambda s, d: compare.by_difference(_shared_ngrams(s, d)[0], "freq_diff", "ngram", 50),
        "SET3_shared_ngrams": lambda s, d: _shared_ngrams(s, d)[0],
        "SET3_unique_ngrams": lambda s, d: _shared_ngrams(s, d)[1],
        "AGG27_summary": lambda s, d: compare.summary(*_shared_ngrams(s, d)),
        "SET2_collocations": lambda s, d: compare.compare_collocations(
            collocation.collocations(corpus(s, d), "lamp", limit=None, restrictions={"year": (2000, 2009)}), collocation.collocations(corpus(s, d), "lamp", limit=None, restrictions={"year": (2010, 2019)})
        ),
        "STA1_compare_groups": lambda s, d: _rounded(stats.compare_groups(corpus(s, d), "t*", "lang", ("en", "id")), "prop_1", "prop_2", "chi2", "effect_size", "p_value", "p_corrected"),
        "STA2_benjamini_hochberg": lambda s, d: _rounded(stats.compare_groups(corpus(s, d), "_NN", "lang", ("en", "de"), correction="bh"), "chi2", "p_value", "p_corrected").select("word", "chi2", "p_value", "p_corrected"),
        "STA4_pearson": lambda s, d: _rounded(stats.correlation(stats.frequency_vector(corpus(s, d), "the"), stats.metric_vector(corpus(s, d), "ttr")), "r").drop("p_value"),
        "STA4_p_value": lambda s, d: _rounded(stats.correlation(stats.frequency_vector(corpus(s, d), "the"), stats.metric_vector(corpus(s, d), "ttr")), "p_value").select("p_value"),
        "STA4_spearman": lambda s, d: _rounded(stats.correlation(stats.metric_vector(corpus(s, d), "token_count"), stats.metric_vector(corpus(s, d), "ttr"), method="spearman"), "r").drop("p_value"),
        "AGG22_frequency_vector": lambda s, d: stats.frequency_vector(corpus(s, d), "(the|a)"),
        "AGG23_metadata_vector": lambda s, d: stats.metadata_vector(corpus(s, d), "year"),
        "AGG24_metric_vector": lambda s, d: stats.metric_vector(corpus(s, d), "type_count", "lang"),
        "AGG26_preview": lambda s, d: stats.preview(corpus(s, d), "[be]"),
        "AGG25_matrix": lambda s, d: _matrix(s, d, top=40, sizes=(1, 2)),
        "STA12_z_scores": lambda s, d: _rounded(features.z_scores(_matrix(s, d, top=30)), "z"),
        "STA9_delta": lambda s, d: _rounded(
            features.burrows_delta(features.z_scores(features.feature_matrix(corpus(s, d), "topic", top=30)), s.createDataFrame([("Sport", "A"), ("Science", "A"), ("Politics", "B")], "group string, author string"), ["Economy", "Religion"]), "delta"
        ),
        "STA11_network": lambda s, d: _rounded(features.similarity_network(_matrix(s, d, top=40), 0.1), "similarity"),
        "STA5_clustering": lambda s, d: _rounded(multivariate.cluster(_matrix(s, d, top=40)), "height"),
        "STA7_correspondence": lambda s, d: _rounded(multivariate.correspondence(_matrix(s, d, top=40)), "coordinate", "inertia"),
        "STA10_pca": lambda s, d: _rounded(multivariate.principal_components(_matrix(s, d, top=40), 3), "score", "variance"),
        "PAT6_pattern_groups": lambda s, d: pattern_groups.group_by_patterns(corpus(s, d), "lamp", PATTERNS),
        "PAT7_node_lines": lambda s, d: _lines(s, d, None),
        "SMP4_first_lines": lambda s, d: _lines(s, d, 100),
        "PRD18_rules": _nl,
        "CLS1_sentiment": _sentiment,
        "CLS2_topics": lambda s, d: _rounded(classify.topics_by_seeds(_texts(s, d, "en")), "score"),
        "CLS3_discovered_topics": lambda s, d: classify.discover_topics(_texts(s, d)),
        "FN11_ipa": lambda s, d: _part(s, d, "id").tokens.select("token").distinct().select("token", g2p.ipa(F.col("token"), divide=False).alias("ipa")),
        "FN12_lookup": lambda s, d: dictionary.with_lookup(overview.pos_tags(corpus(s, d)), table(s, d, "pos_definitions"), "pos", "tag"),
        "JN17_authors": lambda s, d: features.group_authors(corpus(s, d), "speaker"),
        "SNK5_annotations": lambda s, d: annotate.persist_annotations(corpus(s, d).tokens, _annotations(s, d)).where(F.col("sense").isNotNull()).select("id", "token", "sense"),
        "SNK7_sentence_labels": lambda s, d: annotate.persist_by_sentence(
            corpus(s, d).tokens.select("id", "filename", "sent_id", "topic"), corpus(s, d).tokens.where(F.col("_token_low") == "lamp").select("filename", "sent_id", F.lit("Lamps").alias("topic"))
        ).select("id", "topic"),
        "SNK6_token_labels": lambda s, d: annotate.persist_by_token(
            corpus(s, d).tokens.select("id", "topic"), corpus(s, d).tokens.where(F.col("_token_low") == "lamp").select("id", F.lit("Lamps").alias("topic"), F.lit("good").alias("sentiment"))
        ),
        "SRC1_loader": _loaded,
        "JN6_sentence_lengths": lambda s, d: dictionary.sentence_lengths(corpus(s, d), "lamp"),
        "AGG3_part_size": lambda s, d: corpus(s, d).where({"lang": ["en"], "year": (2000, 2010)}).tokens.agg(F.count("*").alias("n")),
        "PRD13_clean_words": lambda s, d: corpus(s, d).tokens.where(restrict.no_punctuation("_token_low") & restrict.no_digits("_token_low")).groupBy("_token_low").agg(F.count("*").alias("n")),
        "PRD15_smart_filter": lambda s, d: restrict.smart_filter(restrict.smart_filter(corpus(s, d).frequencies, "_token_low", "the, a, of, lamp"), "_token_low", "-a"),
        "PRD19_significant": lambda s, d: restrict.significant(_rounded(keyword.keywords(_part(s, d, "en"), _part(s, d, "id")), "ll", "log_ratio"), "***"),
        "SRT1_sorted_lines": lambda s, d: kwic.sort_lines(kwic.kwic(corpus(s, d), "lamp", left=2, right=2, limit=None, metadata=False), "right").select("match_id", "right"),
        "SMP1_sample": lambda s, d: kwic.kwic(corpus(s, d), "the", limit=50, sample=True, metadata=False).select("match_id", "node"),
        "TOK4_strip_markup": lambda s, d: table(s, d, "documents").select("doc_id", plain.strip_markup(F.col("text")).alias("text")),
        "TOK1_sentences": lambda s, d: table(s, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.posexplode(plain.sentences(F.col("text"))).alias("place", "sentence")),
        "TOK2_tokens": lambda s, d: table(s, d, "documents").where(F.col("text").isNotNull()).select(F.explode(plain.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n")),
        "SRC2_vertical": _vertical,
        "SRC3_plain_text": _plain,
        "SRC4_xml": lambda s, d: xml.read_xml(_xml(s, d)).select("id", "filename", "sent_id", "token", "pos", "lemma", "in_pn_start", "pn_len", "pn_type"),
        "SRC9_structure": lambda s, d: xml.structure(_xml(s, d)).select("tag", "attribute", F.array_join("values", "|").alias("values")),
        "SRC16_frequency_list": lambda s, d: side.frequency_list(table(s, d, "freq_list").select(F.concat_ws(" ", "token", F.col("freq").cast("string")).alias("value"))),
        "SET4_misaligned": lambda s, d: side.misaligned(_part(s, d, "en").tokens, _part(s, d, "id").tokens),
        "SET5_concatenate": lambda s, d: side.concatenate([_part(s, d, "de").tokens.select("id", "token", "lang"), _part(s, d, "fr").tokens.select("id", "token", "year")]).select("id", "token", "lang", "year"),
        "STR1_frequencies": lambda s, d: streaming.running_frequencies(table(s, d, "documents").select("text")),
        "AGG17_segments": lambda s, d: _rounded(distribution.segments(corpus(s, d), "the"), "density", "relative_to_peak"),
        "AGG17_segments_densified": lambda s, d: _rounded(distribution.segments(corpus(s, d), "the", restrictions={"lang": ["en"]}, densify=True), "density", "relative_to_peak"),
        "AGG18_attributes": lambda s, d: _rounded(distribution.by_attributes(corpus(s, d), "the", ["lang", "topic", "year"]), "per_million", "relative", places=4),
    }


_C = """WITH c0 AS (SELECT DISTINCT * FROM corpus WHERE id IS NOT NULL),
c AS (SELECT * REPLACE (coalesce(_token_low, lower(token)) AS _token_low) FROM c0)"""

_LL = "CASE WHEN {o} > 0 AND {e} > 0 THEN {o} * ln({o} / {e}) ELSE 0 END"


def _one(condition: str, restriction: str = "true") -> str:
    return f"{_C} SELECT id, CAST(1 AS BIGINT) AS len, token AS match_token FROM c WHERE ({condition}) AND ({restriction})"


def _ngrams(n: int, where: str, slots: str, basis: str, min_freq: int, size_where: str | None = None) -> str:
    cols = ", ".join(f"lead({c}, {k}) OVER w AS {c}_{k + 1}" for c in ("_token_low", "pos", "lemma") for k in range(n))
    shown = [f"{basis}_{k + 1}" for k in range(n)]
    content = " OR ".join(f"NOT regexp_matches({s}, '^([[:punct:]]|[0-9]+)$')" for s in shown)
    return f"""{_C}, k AS (SELECT * FROM c WHERE {where}), l AS (SELECT {cols} FROM k WINDOW w AS (ORDER BY id)),
g AS (SELECT {", ".join(shown)}, count(*) AS frequency FROM l WHERE {slots} AND {" AND ".join(s + " IS NOT NULL" for s in shown)} GROUP BY ALL)
SELECT concat_ws(' ', {", ".join(shown)}) AS ngram, frequency, round(frequency / (SELECT count(*) FROM c WHERE {size_where or "true"}) * 1e6, 4) AS per_million
FROM g WHERE frequency >= {min_freq} AND ({content})"""


def _collocations(node: str, window: int, min_freq: int, region: str, limit: str) -> str:
    cells = {"k11": "observed", "k12": "(f - observed)", "k21": "(total_freq - observed)", "k22": "(n - greatest(observed + (f - observed) + (total_freq - observed), 0))"}
    rows = [("k11", "k11 + k12", "k11 + k21"), ("k12", "k11 + k12", "k12 + k22"), ("k21", "k21 + k22", "k11 + k21"), ("k22", "k21 + k22", "k12 + k22")]
    ll = " + ".join(_LL.format(o=o, e=f"(({r}) * ({c}) / n)") for o, r, c in rows)
    return f"""{_C}, r AS (SELECT * FROM c WHERE {region}), m AS (SELECT id FROM r WHERE {node}),
s AS (
  SELECT t._token_low AS collocate, t.pos, lower(t.lemma) AS lemma, count(*) FILTER (t.id < m.id) AS l, count(*) FILTER (t.id > m.id) AS r
  FROM m JOIN (SELECT unnest(range(-{window}, {window} + 1)) AS o) w ON o <> 0 JOIN c t ON t.id = m.id + o
  WHERE NOT regexp_matches(t._token_low, '^[[:punct:]]+$') AND NOT regexp_matches(t._token_low, '^[0-9]+$') GROUP BY ALL
), q AS (SELECT collocate, pos, lemma, CASE WHEN l >= {min_freq} THEN l ELSE 0 END AS obs_l, CASE WHEN r >= {min_freq} THEN r ELSE 0 END AS obs_r FROM s),
u AS (SELECT q.*, obs_l + obs_r AS observed, greatest(coalesce(f.freq, 0), obs_l + obs_r) AS total_freq FROM q
  LEFT JOIN (SELECT _token_low, count(*) AS freq FROM r GROUP BY 1) f ON f._token_low = collocate WHERE obs_l + obs_r >= {min_freq} AND obs_l + obs_r > 0),
v AS (SELECT u.*, (SELECT count(*) FROM m)::DOUBLE AS f, (SELECT count(*) FROM r)::DOUBLE AS n FROM u),
x AS (SELECT v.*, {", ".join(f"({e})::DOUBLE AS {k}" for k, e in cells.items())} FROM v),
y AS (SELECT *, round(2 * ({ll}), 6) AS ll, round(CASE WHEN k11 > 0 AND (k11 + k12) * (k11 + k21) > 0 THEN log2(k11 / ((k11 + k12) * (k11 + k21) / n)) ELSE 0 END, 6) AS mi FROM x)
SELECT collocate, pos, lemma, obs_l, obs_r, observed, total_freq, ll, mi,
  CASE WHEN obs_r > obs_l THEN 'R' WHEN obs_l > obs_r THEN 'L' ELSE 'B' END AS direction,
  CASE WHEN ll >= 15.13 THEN '*** (p<0.001)' WHEN ll >= 10.83 THEN '** (p<0.01)' WHEN ll >= 3.84 THEN ' * (p<0.05)' ELSE 'ns' END AS significance
FROM y {limit}"""


_CLEAN = "NOT regexp_matches(_token_low, '^[[:punct:]]+$') AND NOT regexp_matches(_token_low, '^[0-9]+$')"
_SCORE = f"""round(2 * ({_LL.format(o='freq_t', e='(n1 * (freq_t + freq_r) / (n1 + n2))')} + {_LL.format(o='freq_r', e='(n2 * (freq_t + freq_r) / (n1 + n2))')}), 6) AS ll,
  round(log2(((freq_t + 0.5) / (n1 + 0.5)) / ((freq_r + 0.5) / (n2 + 0.5))), 6) AS log_ratio"""
_LABELS = """CASE WHEN ll >= 15.13 THEN '*** (p<0.001)' WHEN ll >= 10.83 THEN '** (p<0.01)' WHEN ll >= 3.84 THEN ' * (p<0.05)' ELSE 'ns' END AS significance,
  CASE WHEN log_ratio > 0 THEN 'Positive' ELSE 'Negative' END AS type"""
_LIST = "(SELECT lower(trim(token)) AS token, CAST(sum(freq) AS BIGINT) AS freq_r FROM freq_list WHERE token IS NOT NULL AND freq > 0 GROUP BY 1)"


def _keywords(reference: str, n2: str) -> str:
    return f"""{_C}, t AS (SELECT _token_low AS token, count(*) AS freq_t FROM c WHERE lang = 'en' AND {_CLEAN} GROUP BY 1 HAVING count(*) >= 3), r AS {reference},
j AS (SELECT token, coalesce(freq_t, 0) AS freq_t, coalesce(freq_r, 0) AS freq_r, (SELECT count(*) FROM c WHERE lang = 'en')::DOUBLE AS n1, ({n2})::DOUBLE AS n2 FROM t FULL JOIN r USING (token)),
s AS (SELECT token, freq_t, freq_r, {_SCORE} FROM j)
SELECT *, {_LABELS} FROM s"""


_KEY_ID = _keywords(f"(SELECT _token_low AS token, count(*) AS freq_r FROM c WHERE lang = 'id' AND {_CLEAN} GROUP BY 1)", "SELECT count(*) FROM c WHERE lang = 'id'")
_TTR = "count(*) AS tokens, count(DISTINCT _token_low) AS types, CASE WHEN count(*) > 0 THEN round(count(DISTINCT _token_low) / count(*), 4) ELSE 0 END AS ttr"
_PM = "round(absolute_frequency / (SELECT count(*) FROM c) * 1e6, 4)"
_BAND = "CASE WHEN {z} >= 7 THEN 1 WHEN {z} >= 6 THEN 2 WHEN {z} >= 5 THEN 3 WHEN {z} >= 4 THEN 4 ELSE 5 END AS band"


#: Visible attributes of the corpus table, as a list of name and value.
_ATTRIBUTES = "[" + ", ".join(f"{{'a': '{a}', 'v': CAST(c.{a} AS VARCHAR)}}" for a in ("pos_in_doc", "lang", "topic", "speaker", "year", "in_pn", "pn_type")) + "]"


def _kwic(node: str, width: int, limit: str, columns: str = "", shown: str = "token") -> str:
    return f"""{_C}, m AS (SELECT id FROM c n WHERE {node} {limit}),
w AS (SELECT m.id AS match_id, t.id - m.id AS o, {shown} AS token, t._token_low FROM m JOIN (SELECT unnest(range(-{width}, {width} + 1)) AS o) k ON true JOIN c t ON t.id = m.id + k.o)
SELECT match_id, coalesce(string_agg(token, ' ' ORDER BY o) FILTER (o < 0), '') AS "left", string_agg(token, ' ' ORDER BY o) FILTER (o = 0) AS node,
  coalesce(string_agg(token, ' ' ORDER BY o) FILTER (o > 0), '') AS "right" {columns} FROM w GROUP BY match_id"""


def _kwic_lines(limit: str) -> str:
    return f"""{_C}, m AS (SELECT id FROM c WHERE _token_low = 'lamp' {limit})
SELECT m.id, string_agg(concat_ws('/', token, pos, lemma), ' ' ORDER BY t.id) AS line FROM m JOIN (SELECT unnest(range(-5, 6)) AS o) k ON true JOIN c t ON t.id = m.id + k.o GROUP BY 1"""


def _collocate_examples_sql(word: str) -> str:
    best = _collocations(f"_token_low = '{word}'", 5, 3, "true", "ORDER BY ll DESC, collocate, pos NULLS FIRST, lemma NULLS FIRST LIMIT 10")
    return f"""{_C}, b AS (SELECT collocate, max(ll) AS ll FROM ({best}) GROUP BY 1), m AS (SELECT id FROM c WHERE _token_low = '{word}'),
l AS (SELECT m.id, k.o, t.token, t._token_low FROM m JOIN (SELECT unnest(range(-5, 6)) AS o) k ON true JOIN c t ON t.id = m.id + k.o),
h AS (SELECT collocate, ll, min(id) AS match_id FROM l JOIN b ON b.collocate = l._token_low WHERE o <> 0 GROUP BY ALL)
SELECT collocate, ll, match_id, (SELECT string_agg(token, ' ' ORDER BY o) FROM l WHERE l.id = match_id) AS line FROM h"""


def _examples_sql(word: str) -> str:
    return f"""{_C}, n AS (SELECT id, pos, filename, sent_id FROM c WHERE _token_low = '{word}' AND filename IS NOT NULL AND sent_id > 0),
s AS (SELECT filename, sent_id, list(token ORDER BY id) AS w, list(id ORDER BY id) AS ids FROM c WHERE (filename, sent_id) IN (SELECT (filename, sent_id) FROM n) GROUP BY ALL),
j AS (SELECT n.*, w, len(w) AS length, list_position(ids, n.id) AS place FROM n JOIN s USING (filename, sent_id)),
r AS (SELECT *, greatest(place - 7, 1) AS low, least(place + 7, length) AS high, row_number() OVER (PARTITION BY pos ORDER BY length >= 15, length, id) AS r FROM j)
SELECT pos, filename, sent_id, CAST(length AS INT) AS length, CASE WHEN low > 1 THEN '... ' ELSE '' END
  || regexp_replace(array_to_string(list_transform(w[low:high], lambda x, i: CASE WHEN i + low - 1 = place THEN '<b>' || x || '</b>' ELSE x END), ' '), '\\s+([.,!?;:])', '\\1', 'g')
  || CASE WHEN high < length THEN ' ...' ELSE '' END AS example FROM r WHERE r = 1"""


def _pattern_groups_sql(word: str) -> str:
    top = _collocations(f"_token_low = '{word}'", 5, 1, "true", "ORDER BY ll DESC, collocate, pos NULLS FIRST, lemma NULLS FIRST LIMIT 50")
    at = "JOIN l {a} ON {a}.id = n.id AND {a}.o = n.o + {k}"
    of = at.format(a="a", k=1) + " AND a._token_low = 'of' "
    parts = {
        "of": [of + at.format(a="k", k=2), of + at.format(a="d", k=2) + " AND d.pos = 'DT' " + at.format(a="k", k=3)],
        "before": [at.format(a="k", k=-1)],
        "and": [at.format(a="a", k=1) + " AND a._token_low = 'and' " + at.format(a="k", k=2)],
        "far": [at.format(a="k", k=3)],
    }
    found = " UNION ".join(f"SELECT '{label}' AS label, k._token_low AS collocate, n.id FROM l n {join} WHERE n._token_low = '{word}'" for label, joins in parts.items() for join in joins)
    return f"""{_C}, m AS (SELECT id FROM c WHERE _token_low = '{word}'), l AS (SELECT m.id, k.o, t.token, t._token_low, t.pos FROM m JOIN (SELECT unnest(range(-5, 6)) AS o) k ON true JOIN c t ON t.id = m.id + k.o),
f AS ({found}), h AS (SELECT label, collocate, min(id) AS match_id FROM f WHERE collocate IN (SELECT collocate FROM ({top})) GROUP BY ALL)
SELECT *, (SELECT string_agg(token, ' ' ORDER BY o) FROM l WHERE l.id = match_id) AS example FROM h"""


def _sentiment_sql() -> str:
    listed = ", ".join(f"('{w}', {v})" for w, v in LEXICON.items())
    return f"""{_C}, s AS (SELECT concat_ws(':', filename, sent_id) AS text_id, string_agg(token, ' ' ORDER BY id) AS text FROM c WHERE filename IS NOT NULL GROUP BY filename, sent_id),
w AS (SELECT text_id, list_transform(regexp_split_to_array(text, '\\s+'), lambda x: lower(regexp_replace(x, '^[.,;:!?"''()]+|[.,;:!?"''()]+$', '', 'g'))) AS w FROM s),
u AS (SELECT text_id, w, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w), x(word, valence) AS (VALUES {listed}),
t AS (SELECT text_id, sum(CASE WHEN list_has_any(w[greatest(i - 3, 1):i - 1], ['not', 'no', 'never', 'without', 'cannot']) THEN -0.74 * valence ELSE valence END) AS s FROM u JOIN x USING (word) GROUP BY 1),
y AS (SELECT text_id, coalesce(t.s / sqrt(t.s * t.s + 15), 0) AS k FROM s LEFT JOIN t USING (text_id))
SELECT text_id, round(k, 6) AS compound, CASE WHEN k >= 0.05 THEN 'Positive' WHEN k <= -0.05 THEN 'Negative' ELSE 'Neutral' END AS sentiment FROM y"""


def _ipa_sql() -> str:
    consonants = g2p.CONSONANTS
    listed = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in g2p.E_WORDS.items())
    word = "lower(regexp_replace(token, '^\\s+|\\s+$', '', 'g'))"
    out = f"regexp_replace({word}, '^([bmpkst])e([{consonants}])', '\\1ə\\2')"
    out = f"CASE {word} {listed} ELSE replace(regexp_replace({out}, 'e([rktp])', 'ɛ\\1', 'g'), 'e', 'ə') END"
    out = f"regexp_replace({out}, 'o([{consonants}])', 'ɔ\\1', 'g')"
    for spelling, sound in g2p.SPELLINGS:
        out = f"replace({out}, '{spelling}', '{sound}')"
    out = f"regexp_replace({out}, 'k([^\\p{{L}}\\p{{N}}_]|$)', 'ʔ\\1', 'g')"
    return f"{_C} SELECT DISTINCT token, CASE WHEN regexp_matches({word}, '[<>{{}}=\\\\/]') THEN token ELSE {out} END AS ipa FROM c WHERE lang = 'id'"


def _segments(region: str, number: str) -> str:
    return f"""{_C}, r AS (SELECT *, row_number() OVER (ORDER BY id) AS k FROM c WHERE {region}), n AS (SELECT count(*) / 100 AS size FROM r),
h AS (SELECT least(floor({number} / size), 99) + 1 AS position, count(*) AS absolute FROM r, n WHERE _token_low = 'the' GROUP BY 1),
g AS (SELECT p AS position, coalesce(absolute, 0) AS absolute FROM range(1, 101) t(p) LEFT JOIN h ON h.position = p)
SELECT position, absolute, round(absolute / size * 100, 6) AS density, round(CASE WHEN max(absolute) OVER () > 0 THEN absolute / max(absolute) OVER () * 100 ELSE 0 END, 6) AS relative_to_peak FROM g, n"""


def _frames(word: str) -> str:
    punct = "('.', ',', '!', '?', ';', ':', '(', ')', '[', ']', '{', '}', '\"', '\'\'', '“', '”', '‘', '’', '-', '–')"
    cols = "id, " + ", ".join(f"{'lag' if o < 0 else 'lead'}(_token_low, {abs(o)}) OVER w AS w{o + 3}" for o in range(-3, 4))
    parts = " UNION ALL ".join(
        f"SELECT '{name}' AS frame, " + " || ' ' || ".join(f"w{o + 3}" for o in offsets) + " AS ngram, id FROM n" for name, offsets in dictionary.FRAMES
    )
    return f"""{_C}, k AS (SELECT * FROM c WHERE _token_low IS NOT NULL AND _token_low NOT IN {punct}), l AS (SELECT _token_low, {cols} FROM k WINDOW w AS (ORDER BY id)),
n AS (SELECT * FROM l WHERE _token_low = '{word}'), f AS ({parts}), g AS (SELECT frame, ngram, count(*) AS frequency, min(id) AS first_id FROM f WHERE ngram IS NOT NULL GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY frame ORDER BY frequency DESC, ngram) AS INT) AS rank FROM g) WHERE rank <= 5"""


def _bigrams_of(lang: str) -> str:
    return f"(SELECT * FROM ({_ngrams(2, f"lang = '{lang}'", "true", "_token_low", 1, f"lang = '{lang}'")}))"


_SETS = f"WITH a AS {_bigrams_of('en')}, b AS {_bigrams_of('id')}"


_SHARED = _SETS + " SELECT a.ngram, a.frequency AS freq_a, a.per_million AS rel_a, b.frequency AS freq_b, b.per_million AS rel_b, a.frequency - b.frequency AS freq_diff, a.per_million - b.per_million AS rel_diff FROM a JOIN b USING (ngram)"


def _groups(words: str, a: str, b: str) -> str:
    """Tests of each word in two languages; p by the series of the error function."""
    cells = (("freq_1", "t1", "c1"), ("(t1 - freq_1)", "t1", "c2"), ("freq_2", "t2", "c1"), ("(t2 - freq_2)", "t2", "c2"))
    return f"""{_C}, n AS (SELECT count(*) FILTER (lang = '{a}')::DOUBLE AS t1, count(*) FILTER (lang = '{b}')::DOUBLE AS t2 FROM c),
w AS (SELECT lower(token) AS word, count(*) FILTER (lang = '{a}') AS freq_1, count(*) FILTER (lang = '{b}') AS freq_2 FROM c WHERE {words} AND lang IN ('{a}', '{b}') GROUP BY 1 HAVING count(*) >= 5),
x AS (SELECT *, freq_1 / t1 AS p1, freq_2 / t2 AS p2, freq_1 + freq_2 AS c1, t1 + t2 - freq_1 - freq_2 AS c2, t1 + t2 AS t FROM w, n),
y AS (SELECT *, {" + ".join(_yates(*cell) for cell in cells)} AS x2 FROM x),
v AS (SELECT x2, CASE WHEN x2 = 0 THEN 1 WHEN x2 > 60 THEN 0 ELSE 1 - (SELECT sum(exp((k + 0.5) * ln(x2 / 2) - x2 / 2 - lgamma(k + 1.5))) FROM range(0, 200) r(k)) END AS p FROM (SELECT DISTINCT x2 FROM y)),
z AS (SELECT y.*, v.p, least(v.p * (SELECT count(*) FROM y), 1) AS bonferroni FROM y JOIN v USING (x2))"""


def _yates(o: str, r: str, c: str) -> str:
    e = f"({r} * {c} / t)"
    return f"CASE WHEN {e} > 0 THEN pow(abs({o} - {e}) - least(0.5, abs({o} - {e})), 2) / {e} ELSE 0 END"


def _rank(x: str) -> str:
    return f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2"


def _correlation(x: str, a: str, b: str) -> str:
    return f"""{_C}, x AS ({x}), y AS (SELECT filename AS g, round(count(DISTINCT _token_low) / count(*), 4) AS y FROM c WHERE filename IS NOT NULL GROUP BY 1),
v AS (SELECT ({a})::DOUBLE AS a, ({b})::DOUBLE AS b FROM x JOIN y USING (g)), r AS (SELECT count(*) AS n, corr(a, b) AS r FROM v)
SELECT n, round(r, 6) AS r, CASE WHEN abs(r) >= 0.8 THEN 'Very Strong' WHEN abs(r) >= 0.6 THEN 'Strong' WHEN abs(r) >= 0.4 THEN 'Moderate' WHEN abs(r) >= 0.2 THEN 'Weak' ELSE 'Negligible' END
  || CASE WHEN r >= 0 THEN ' Positive' ELSE ' Negative' END AS label FROM r"""


def _matrix_sql(group: str, top: int, sizes: tuple, select: str, tail: bool = False) -> str:
    grams = " UNION ALL ".join(
        f"SELECT {group} AS g, {n} AS size, " + " || ' ' || ".join(["_token_low"] + [f"CASE WHEN lead(s, {k}) OVER (ORDER BY id) = s THEN lead(_token_low, {k}) OVER (ORDER BY id) END" for k in range(1, n)]) + " AS feature FROM r" for n in sizes
    )
    return f"""{_C}, r AS (SELECT *, concat(filename, ':', sent_id) AS s FROM c WHERE {group} IS NOT NULL AND _token_low IS NOT NULL AND NOT regexp_matches(_token_low, '^[[:punct:]]+$')), a AS ({grams}),
h AS (SELECT g, size, feature, count(*) AS freq FROM a WHERE feature IS NOT NULL GROUP BY ALL),
u AS (SELECT size, feature, sum(freq) AS total FROM h GROUP BY ALL),
t AS (SELECT feature FROM (SELECT *, row_number() OVER (PARTITION BY size ORDER BY total DESC, feature) AS i FROM u) WHERE i <= {top}),
m AS (SELECT x.g, t.feature, coalesce(h.freq, 0) AS freq FROM (SELECT DISTINCT g FROM h) x CROSS JOIN t LEFT JOIN h ON h.g = x.g AND h.feature = t.feature) {select if tail else select}"""


_TOKENS = r"WITH t AS (SELECT unnest(list_filter(regexp_split_to_array(regexp_replace(text, '([^\p{L}\p{N}_\s\p{Z}])', ' \1 ', 'g'), '[\s\p{Z}]+'), lambda x: x <> '')) AS token FROM documents)"


_SENTENCES = r"""WITH x AS (SELECT doc_id, text, list_filter(list_transform(regexp_extract_all(text, '(?s).*?[.?!](?:\s+|$)'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL),
y AS (SELECT doc_id, CASE WHEN len(s) > 0 THEN s ELSE list_filter([regexp_replace(text, '^\s+|\s+$', '', 'g')], lambda x: x <> '') END AS s FROM x),
s AS (SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INT) AS place, unnest(s) AS sentence FROM y)"""


def _topics_sql() -> str:
    seeds = ", ".join(f"('{t}', '{w}')" for t, words in classify.TOPIC_SEEDS.items() for w in words)
    return f"""{_C}, s AS (SELECT concat_ws(':', filename, sent_id) AS text_id, string_agg(token, ' ' ORDER BY id) AS text FROM c WHERE filename IS NOT NULL AND lang = 'en' GROUP BY filename, sent_id),
seed(topic, word) AS (VALUES {seeds}), w AS (SELECT text_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS word FROM s),
k AS (SELECT text_id, word, count(*) AS tf FROM w GROUP BY ALL), df AS (SELECT word, count(*) AS df FROM (SELECT word FROM k UNION ALL SELECT word FROM seed) GROUP BY 1),
i AS (SELECT word, ln(((SELECT count(*) FROM s) + 7.0) / (1 + df)) + 1 AS idf FROM df), v AS (SELECT text_id, word, tf * idf AS w FROM k JOIN i USING (word)),
n AS (SELECT text_id, sqrt(sum(w * w)) AS norm FROM v GROUP BY 1), z AS (SELECT topic, word, idf AS s FROM seed JOIN i USING (word)), y AS (SELECT topic, sqrt(sum(s * s)) AS size FROM z GROUP BY 1),
q AS (SELECT text_id, topic, round(sum(w * s) / (any_value(norm) * any_value(size)), 9) AS score FROM v JOIN z USING (word) JOIN n USING (text_id) JOIN y USING (topic) GROUP BY text_id, topic),
b AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY score DESC, topic) AS r FROM q)
SELECT s.text_id, coalesce(b.topic, 'General') AS topic, round(coalesce(b.score, 0), 6) AS score FROM s LEFT JOIN b ON b.text_id = s.text_id AND b.r = 1"""


def oracle_sql() -> dict[str, str]:
    return {
        "CON1_kwic": _kwic("_token_low = 'the'", 5, "ORDER BY id LIMIT 1000"),
        "CON3_kwic_collocate": _kwic(
            "_token_low = 'the' AND EXISTS (SELECT 1 FROM c x WHERE x._token_low = 'lamp' AND x.id BETWEEN n.id - 3 AND n.id + 3 AND x.id <> n.id)",
            3, "", ", arg_min(token, o) FILTER (_token_low = 'lamp' AND o <> 0) AS collocate",
        ),
        "AGG10_breakdown": f"""{_C}, b AS (SELECT token AS token_form, count(*) AS absolute_frequency FROM c WHERE starts_with(_token_low, 'th') GROUP BY 1),
            p AS (SELECT *, {_PM} AS per_million FROM b) SELECT *, round(log10(per_million) + 3, 2) AS zipf, {_BAND.format(z="log10(per_million) + 3")} FROM p""",
        "AGG28_frequency": f"{_C} SELECT count(*) AS n FROM c WHERE _token_low = 'the'",
        "PRD1_word": _one("_token_low = 'people'"),
        "PRD2_wildcard": _one("regexp_matches(_token_low, '^bri.*ge$')"),
        "PRD3_lemma": _one("lower(lemma) = 'be'"),
        "PRD4_pos": f"{_C} SELECT id, CAST(1 AS BIGINT) AS len FROM c WHERE regexp_matches(pos, '^(VB.*|IN)$')",
        "PRD5_token_pos": _one("_token_low = 'the' AND pos = 'DT'"),
        "PRD6_tag": f"""{_C}, h AS (SELECT a.id, a.pn_len + 1 AS len FROM c a JOIN c b ON b.id = a.id + a.pn_len WHERE a.in_pn_start AND a.pn_type = 'human' AND b._token_low = 'was')
            SELECT h.id, CAST(h.len AS BIGINT) AS len, string_agg(t.token, ' ' ORDER BY t.id) AS match_token FROM h JOIN c t ON t.id BETWEEN h.id AND h.id + h.len - 1 GROUP BY ALL""",
        "PRD8_restriction_list": _one("_token_low = 'the'", "lang = 'en' AND speaker IN ('SPK0054', 'SPK0001')"),
        "PRD9_restriction_range": _one("_token_low = 'the'", "year BETWEEN 2000 AND 2010"),
        "PRD11_integer_columns": f"""{_C} SELECT u.attribute, count(*) FILTER (try_cast(u.value AS BIGINT) IS NULL AND u.value IS NOT NULL) = 0 AS is_integer
            FROM c, LATERAL (VALUES ('lang', lang), ('speaker', speaker), ('year', CAST(year AS VARCHAR)), ('pn_len', CAST(pn_len AS VARCHAR)), ('topic', topic)) u(attribute, value) GROUP BY 1""",
        "PRD12_domain": f"{_C} SELECT DISTINCT topic AS value FROM c WHERE trim(topic) <> '' AND lower(topic) <> 'nan'",
        "JN1_sequence": f"""{_C} SELECT a.id, CAST(3 AS BIGINT) AS len, a.token || ' ' || b.token || ' ' || d.token AS match_token
            FROM c a JOIN c b ON b.id = a.id + 1 JOIN c d ON d.id = a.id + 2 WHERE a._token_low = 'in' AND b._token_low = 'the' AND d.pos = 'NN'""",
        "PRJ5_bands": f"""{_C}, b AS (SELECT _token_low AS token, count(*) AS freq FROM c WHERE _token_low IS NOT NULL GROUP BY 1),
            p AS (SELECT *, round(freq / (SELECT count(*) FROM c) * 1e6, 4) AS per_million FROM b)
            SELECT *, round(log10(per_million) + 3, 6) AS zipf, {_BAND.format(z="log10(per_million) + 3")} FROM p""",
        "AGG1_totals": f"{_C} SELECT {_TTR} FROM c",
        "AGG2_restricted_totals": f"{_C} SELECT {_TTR} FROM c WHERE lang IN ('de', 'fr')",
        "AGG4_frequencies": f"{_C} SELECT _token_low, count(*) AS freq FROM c GROUP BY 1",
        "AGG5_top": f"{_C} SELECT _token_low AS token, pos, count(*) AS frequency FROM c WHERE {_CLEAN} GROUP BY ALL ORDER BY frequency DESC, token, pos NULLS FIRST LIMIT 100",
        "AGG6_pos_tags": f"{_C} SELECT DISTINCT pos FROM c WHERE pos NOT IN ('', '##', '###', '##TAG', 'TAG', 'nan', 'None')",
        "AGG7_files": f"{_C} SELECT filename AS value, {_TTR} FROM c WHERE filename IS NOT NULL GROUP BY 1",
        "AGG8_attribute": f"{_C} SELECT lang AS value, {_TTR} FROM c WHERE lang IS NOT NULL GROUP BY 1",
        "AGG9_labels": f"{_C} SELECT topic AS label, count(*) AS tokens FROM c WHERE topic IS NOT NULL GROUP BY 1",
        "AGG21_sentences": f"{_C} SELECT filename, sent_id, string_agg(token, ' ' ORDER BY id) AS text FROM c WHERE filename IS NOT NULL GROUP BY ALL",
        "AGG12_collocations": _collocations("lower(lemma) = 'be'", 4, 2, "true", "ORDER BY ll DESC, collocate, pos NULLS FIRST, lemma NULLS FIRST LIMIT 200"),
        "AGG12_collocations_restricted": _collocations("_token_low = 'the'", 2, 1, "lang = 'en' AND year BETWEEN 2005 AND 2015", ""),
        "AGG11_bigrams": _ngrams(2, "true", "true", "_token_low", 2),
        "AGG11_trigrams_filtered": _ngrams(
            3, "lang = 'en' AND _token_low NOT IN ('.', ',', '!', '?', ';', ':', '(', ')', '[', ']', '{', '}', '\"', '''', '“', '”', '‘', '’', '-', '–')",
            "regexp_matches(_token_low_1, '^t.*$') AND NOT regexp_matches(pos_3, '(?i)^NN$')", "_token_low", 2, "lang = 'en'",
        ),
        "AGG11_pos_trigrams": _ngrams(3, "true", " AND ".join(f"_token_low_{k} <> 'the'" for k in (1, 2, 3)), "pos", 1),
        "AGG15_keywords": _KEY_ID,
        "AGG15_keywords_list": _keywords(_LIST, f"SELECT sum(freq_r) FROM {_LIST}"),
        "AGG16_grouped_keywords": f"""{_C}, t AS (SELECT lang, _token_low AS token, count(*) AS freq_t FROM c WHERE lang IS NOT NULL AND {_CLEAN} GROUP BY ALL HAVING count(*) >= 3),
            r AS {_LIST}, g AS (SELECT lang, count(*)::DOUBLE AS n1 FROM c WHERE lang IN (SELECT lang FROM t) GROUP BY 1),
            k AS (SELECT lang, token FROM t UNION SELECT lang, token FROM g, r),
            j AS (SELECT k.lang, k.token, coalesce(freq_t, 0) AS freq_t, coalesce(freq_r, 0) AS freq_r, n1, (SELECT sum(freq_r) FROM r)::DOUBLE AS n2
              FROM k JOIN g ON g.lang = k.lang LEFT JOIN t ON t.lang = k.lang AND t.token = k.token LEFT JOIN r ON r.token = k.token),
            s AS (SELECT lang, token, freq_t, freq_r, {_SCORE} FROM j) SELECT *, {_LABELS} FROM s""",
        "SRT4_top_keywords": f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY type ORDER BY ll DESC, token) AS INT) AS rank FROM ({_KEY_ID})) WHERE rank <= 25",
        "AGG19_lemma_forms": f"""{_C}, f AS (SELECT _token_low AS token, pos, lower(lemma) AS lemma, count(*) AS freq FROM c
              WHERE lower(lemma) IN (SELECT lower(lemma) FROM c WHERE _token_low = 'was' AND lemma IS NOT NULL) GROUP BY ALL),
            p AS (SELECT *, round(freq / (SELECT count(*) FROM c) * 1e6, 4) AS per_million FROM f)
            SELECT *, round(log10(per_million) + 3, 2) AS zipf, {_BAND.format(z="log10(per_million) + 3")} FROM p""",
        "AGG20_context_ngrams": _frames("lamp"),
        "SMP3_related_forms": f"{_C} SELECT DISTINCT _token_low AS form FROM c WHERE starts_with(_token_low, 'the') AND _token_low <> 'the' ORDER BY form LIMIT 50",
        "SET1_shared_vocabulary": f"""{_C}, a AS (SELECT _token_low, count(*) AS freq_a FROM c WHERE lang = 'en' GROUP BY 1), b AS (SELECT _token_low, count(*) AS freq_b FROM c WHERE lang = 'id' GROUP BY 1)
            SELECT _token_low, freq_a, freq_b, freq_a - freq_b AS freq_diff FROM a JOIN b USING (_token_low)""",
        "SRT5_by_difference": f"SELECT * FROM ({_SHARED}) ORDER BY abs(freq_diff) DESC, ngram LIMIT 50",
        "SET3_shared_ngrams": _SHARED,
        "SET3_unique_ngrams": _SETS + " SELECT * FROM a WHERE lower(ngram) NOT IN (SELECT lower(ngram) FROM b)",
        "AGG27_summary": _SETS + """, k AS (SELECT (SELECT count(*) FROM a JOIN b USING (ngram)) AS shared, (SELECT count(*) FROM a WHERE lower(ngram) NOT IN (SELECT lower(ngram) FROM b)) AS unique_a,
            (SELECT count(*) FROM b WHERE lower(ngram) NOT IN (SELECT lower(ngram) FROM a)) AS unique_b) SELECT *, round(shared / (shared + unique_a + unique_b) * 100, 2) AS overlap FROM k""",
        "SET2_collocations": f"""SELECT collocate, a.observed AS freq_a, a.ll AS ll_a, b.observed AS freq_b, b.ll AS ll_b, a.observed - b.observed AS freq_diff, a.ll - b.ll AS ll_diff
            FROM ({_collocations("_token_low = 'lamp'", 5, 1, "year BETWEEN 2000 AND 2009", "")}) a JOIN ({_collocations("_token_low = 'lamp'", 5, 1, "year BETWEEN 2010 AND 2019", "")}) b USING (collocate)""",
        "STA1_compare_groups": _groups("starts_with(_token_low, 't')", "en", "id") + """ SELECT word, freq_1, freq_2, round(p1, 6) AS prop_1, round(p2, 6) AS prop_2, round(x2, 6) AS chi2,
              round(2 * (asin(sqrt(p1)) - asin(sqrt(p2))), 6) AS effect_size, round(p, 6) AS p_value, round(bonferroni, 6) AS p_corrected,
              CASE WHEN bonferroni < 0.001 THEN '***' WHEN bonferroni < 0.01 THEN '**' WHEN bonferroni < 0.05 THEN '*' ELSE 'ns' END AS significance FROM z""",
        "STA2_benjamini_hochberg": _groups("pos = 'NN'", "en", "de") + """, r AS (SELECT *, count(*) OVER () * p / rank AS step FROM (SELECT *, count(*) OVER (ORDER BY p) AS rank FROM z))
            SELECT word, round(x2, 6) AS chi2, round(p, 6) AS p_value, round(least(min(step) OVER (ORDER BY p DESC), 1), 6) AS p_corrected FROM r""",
        "STA4_pearson": _correlation("SELECT filename AS g, count(*)::DOUBLE AS x FROM c WHERE _token_low = 'the' AND filename IS NOT NULL GROUP BY 1", "x", "y"),
        "STA4_spearman": _correlation("SELECT filename AS g, count(*)::DOUBLE AS x FROM c WHERE filename IS NOT NULL GROUP BY 1", _rank("x"), _rank("y")),
        "AGG22_frequency_vector": f"{_C} SELECT filename AS \"group\", count(*)::DOUBLE AS value FROM c WHERE _token_low IN ('the', 'a') AND filename IS NOT NULL GROUP BY 1",
        "AGG23_metadata_vector": f"{_C} SELECT g AS \"group\", avg(y) AS value FROM (SELECT DISTINCT filename AS g, year::DOUBLE AS y FROM c WHERE filename IS NOT NULL AND year IS NOT NULL) GROUP BY 1",
        "AGG24_metric_vector": f"{_C} SELECT lang AS \"group\", count(DISTINCT _token_low)::DOUBLE AS value FROM c WHERE lang IS NOT NULL GROUP BY 1",
        "AGG26_preview": f"{_C} SELECT lower(token) AS word, count(*) AS freq FROM c WHERE lower(lemma) = 'be' GROUP BY 1 ORDER BY freq DESC, word LIMIT 20",
        "AGG25_matrix": _matrix_sql("lang", 40, (1, 2), 'SELECT g AS "group", feature, freq FROM m'),
        "STA12_z_scores": _matrix_sql("lang", 30, (1,), """SELECT m.g AS "group", m.feature, round((freq - a) / CASE WHEN coalesce(s, 0) = 0 THEN 1 ELSE s END, 6) AS z
            FROM m JOIN (SELECT feature, avg(freq) AS a, stddev_samp(freq) AS s FROM m GROUP BY 1) v USING (feature)"""),
        "STA9_delta": _matrix_sql("topic", 30, (1,), """, v AS (SELECT feature, avg(freq) AS a, stddev_samp(freq) AS s FROM m GROUP BY 1), z AS (SELECT m.g, m.feature, (freq - a) / CASE WHEN coalesce(s, 0) = 0 THEN 1 ELSE s END AS z FROM m JOIN v USING (feature)),
            k AS (SELECT author, feature, avg(z) AS mean FROM z JOIN (VALUES ('Sport', 'A'), ('Science', 'A'), ('Politics', 'B')) l(g, author) USING (g) GROUP BY ALL)
            SELECT z.g AS "group", author, round(sum(abs(z - mean)), 6) AS delta FROM z JOIN k USING (feature) WHERE z.g IN ('Economy', 'Religion') GROUP BY ALL""", tail=True),
        "STA11_network": _matrix_sql("lang", 40, (1,), """, d AS (SELECT x.g AS a, y.g AS b, sum(abs(x.freq - y.freq))::DOUBLE AS d FROM m x JOIN m y ON x.feature = y.feature AND x.g < y.g GROUP BY ALL)
            SELECT a, b, round(1 - d / (SELECT max(d) FROM d), 6) AS similarity FROM d WHERE 1 - d / (SELECT max(d) FROM d) >= 0.1""", tail=True),
        "PRD18_rules": _nl_sql(),
        "CON1_kwic_metadata": f"""SELECT k.*, '{{' || array_to_string([to_json(x.a)::VARCHAR || ':' || to_json(x.v)::VARCHAR FOR x IN {_ATTRIBUTES} IF trim(x.v) <> ''], ',') || '}}' AS metadata
            FROM ({_kwic("_token_low = 'people'", 7, "")}) k JOIN ({_C} SELECT * FROM c) c ON c.id = match_id""",
        "PRJ9_kwic_tags": _kwic("_token_low = 'lamp'", 3, "", shown="concat_ws('/', token, pos, lemma)"),
        "PRD12_range": f"{_C} SELECT CAST(min(year) AS BIGINT) AS low, CAST(max(year) AS BIGINT) AS high FROM c",
        "SRT3_top_ngrams": f"SELECT * FROM ({_ngrams(2, 'true', 'true', '_token_low', 1)}) ORDER BY frequency DESC, ngram LIMIT 100",
        "FN12_lookup": f"{_C} SELECT pos, min(definition) AS definition FROM (SELECT DISTINCT pos FROM c WHERE pos NOT IN ('', '##', '###', '##TAG', 'TAG', 'nan', 'None')) LEFT JOIN pos_definitions ON lower(pos) = lower(trim(tag)) GROUP BY pos",
        "JN17_authors": f'{_C} SELECT filename AS "group", max(speaker) AS author FROM c WHERE filename IS NOT NULL GROUP BY 1',
        "PAT7_node_lines": _kwic_lines(""),
        "SMP4_first_lines": _kwic_lines("ORDER BY id LIMIT 100"),
        "PAT6_pattern_groups": _pattern_groups_sql("lamp"),
        "DIC1_examples": _examples_sql("people"),
        "DIC3_collocate_examples": _collocate_examples_sql("lamp"),
        "CLS1_sentiment": _sentiment_sql(),
        "FN11_ipa": _ipa_sql(),
        "SRC2_vertical": f"""{_C}, l AS (SELECT filename || '#' || lpad(CAST(id // 4096 AS VARCHAR), 12, '0') AS filename, id, trim(token, ' ') AS token, trim(coalesce(pos, ''), ' ') AS pos, trim(coalesce(lemma, ''), ' ') AS lemma
              FROM c WHERE filename IS NOT NULL AND token IS NOT NULL AND NOT starts_with(token, '#'))
            SELECT filename, CAST(0 AS BIGINT) AS sent_id, CASE WHEN token = '' THEN '###' ELSE token END AS token, CASE WHEN pos = '' THEN '###' ELSE pos END AS pos, CASE WHEN lemma = '' THEN '###' ELSE lemma END AS lemma,
              row_number() OVER (ORDER BY filename, id) AS id, lower(CASE WHEN token = '' THEN '###' ELSE token END) AS _token_low FROM l""",
        "SRC3_plain_text": _SENTENCES + r""", t AS (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS filename, CAST(place + 1 AS BIGINT) AS sent_id,
              list_filter(regexp_split_to_array(regexp_replace(sentence, '([^\p{L}\p{N}_\s\p{Z}])', ' \1 ', 'g'), '[\s\p{Z}]+'), lambda x: x <> '') AS w FROM s),
            u AS (SELECT filename, sent_id, unnest(w) AS token, generate_subscripts(w, 1) AS k FROM t)
            SELECT filename, sent_id, token, 'TAG' AS pos, token AS lemma, row_number() OVER (ORDER BY filename, sent_id, k) AS id, lower(token) AS _token_low FROM u""",
        "SNK5_annotations": f"{_C} SELECT id, token, CASE WHEN id % 2 = 0 THEN 'changed' ELSE 'p' || pos END AS sense FROM c WHERE _token_low = 'people' AND (id % 2 = 0 OR pos IS NOT NULL)",
        "SNK7_sentence_labels": f"{_C} SELECT id, CASE WHEN (filename, sent_id) IN (SELECT (filename, sent_id) FROM c WHERE _token_low = 'lamp' AND filename IS NOT NULL AND sent_id IS NOT NULL) THEN 'Lamps' ELSE topic END AS topic FROM c",
        "SNK6_token_labels": f"{_C} SELECT id, CASE WHEN _token_low = 'lamp' THEN 'Lamps' ELSE topic END AS topic, CASE WHEN _token_low = 'lamp' THEN 'good' END AS sentiment FROM c",
        "JN6_sentence_lengths": f"{_C} SELECT filename, sent_id, CAST(count(*) AS INT) AS length FROM c WHERE sent_id > 0 AND filename IS NOT NULL GROUP BY ALL HAVING bool_or(_token_low = 'lamp')",
        "AGG3_part_size": f"{_C} SELECT count(*) AS n FROM c WHERE lang = 'en' AND year BETWEEN 2000 AND 2010",
        "PRD13_clean_words": f"{_C} SELECT _token_low, count(*) AS n FROM c WHERE {_CLEAN} GROUP BY 1",
        "PRD15_smart_filter": f"{_C} SELECT _token_low, count(*) AS freq FROM c WHERE _token_low IN ('the', 'of', 'lamp') GROUP BY 1",
        "PRD19_significant": f"SELECT * FROM ({_KEY_ID}) WHERE significance LIKE '%***%'",
        "SRT1_sorted_lines": f"SELECT match_id, \"right\" FROM ({_kwic("_token_low = 'lamp'", 2, "")})",
        "TOK4_strip_markup": "SELECT doc_id, regexp_replace(text, '<[^>]*>', '', 'g') AS text FROM documents",
        "TOK1_sentences": _SENTENCES + " SELECT * FROM s",
        "TOK2_tokens": _TOKENS + " SELECT token, count(*) AS n FROM t GROUP BY 1",
        "STR1_frequencies": _TOKENS + " SELECT lower(token) AS token, count(*) AS freq FROM t GROUP BY 1",
        "SET4_misaligned": f"""{_C}, e AS (SELECT DISTINCT sent_id FROM c WHERE lang = 'en' AND sent_id IS NOT NULL), i AS (SELECT DISTINCT sent_id FROM c WHERE lang = 'id' AND sent_id IS NOT NULL)
            SELECT 'source' AS side, sent_id FROM e WHERE sent_id NOT IN (SELECT sent_id FROM i) UNION ALL SELECT 'target', sent_id FROM i WHERE sent_id NOT IN (SELECT sent_id FROM e)""",
        "SET5_concatenate": f"""{_C} SELECT row_number() OVER (ORDER BY p, old) AS id, token, lang, year FROM (SELECT 0 AS p, id AS old, token, lang, NULL::INT AS year FROM c WHERE lang = 'de'
            UNION ALL SELECT 1, id, token, NULL, year FROM c WHERE lang = 'fr')""",
        "SRC16_frequency_list": """SELECT token, CAST(sum(freq) AS BIGINT) AS freq FROM (SELECT lower(c[1]) AS token, try_cast(c[2] AS BIGINT) AS freq FROM
            (SELECT regexp_split_to_array(trim(concat_ws(' ', token, CAST(freq AS VARCHAR))), '\\s+') AS c FROM freq_list) WHERE len(c) >= 2) WHERE freq IS NOT NULL AND token <> '' GROUP BY 1""",
        "CLS2_topics": _topics_sql(),
        "AGG17_segments": _segments("true", "id"),
        "AGG17_segments_densified": _segments("lang = 'en'", "k"),
        "AGG18_attributes": f"""{_C}, u AS (SELECT u.attribute, u.value, _token_low FROM c, LATERAL (VALUES ('lang', lang), ('topic', topic), ('year', CAST(year AS VARCHAR))) u(attribute, value) WHERE trim(u.value) <> ''),
            a AS (SELECT attribute, value, count(*) FILTER (_token_low = 'the') AS absolute, count(*) AS n FROM u GROUP BY ALL HAVING count(*) FILTER (_token_low = 'the') > 0)
            SELECT attribute, value, absolute, round(absolute / n * 1e6, 4) AS per_million, round(absolute / n * 1e6 / max(absolute / n * 1e6) OVER (PARTITION BY attribute) * 100, 4) AS relative FROM a""",
    }
