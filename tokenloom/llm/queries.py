"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.llm import contamination, cooccurrence, encoding, frequency, packing, sentences, splitting, subjects
from tokenloom.session import table

#: Rank file of the public tokenizer in which sizes are counted.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def _p3(spark, d):
    return cooccurrence.sentence_pairs(table(spark, d, "corpus"))


def _p3_pairs(spark, d):
    return _p3(spark, d).select(
        "item_a", "item_b", "n_ab", "n_a", "n_b", "n_records", F.round("lift", 6).alias("lift"), F.round("odds_ratio", 4).alias("odds_ratio")
    )


def _p4(spark, d):
    return subjects.document_subjects(table(spark, d, "documents"), table(spark, d, "corpus"), table(spark, d, "topic_list"))


def _p5(spark, d):
    return frequency.term_frequencies(table(spark, d, "corpus"), table(spark, d, "freq_list"))


def _p7(spark, d):
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "size_limits"), vocabulary=VOCABULARY)


def _p8(spark, d, operator):
    return operator(table(spark, d, "documents"), table(spark, d, "eval_items"))


def _p9(spark, d, limit_name=None):
    return splitting.split_documents(table(spark, d, "documents"), table(spark, d, "size_limits"), vocabulary=VOCABULARY, limit_name=limit_name)


def queries() -> dict:
    return {
        "p1_found": lambda s, d: encoding.damaged_tokens(table(s, d, "corpus")).select("id"),
        "p1_tokens": lambda s, d: encoding.damaged_tokens(table(s, d, "corpus")),
        "p1_documents": lambda s, d: encoding.repaired_documents(table(s, d, "documents"), table(s, d, "corpus")),
        "p2_found": lambda s, d: sentences.sentence_ends(table(s, d, "corpus")).select("id"),
        "p2_units": lambda s, d: sentences.sentence_units(table(s, d, "corpus")),
        "p3_found": lambda s, d: _p3(s, d).select(F.col("item_a").alias("token_a"), F.col("item_b").alias("token_b")),
        "p3_pairs": _p3_pairs,
        "p4_found": lambda s, d: _p4(s, d).select("doc_id", "topic"),
        "p4_shares": lambda s, d: subjects.subject_shares(_p4(s, d)),
        "p5_found": lambda s, d: _p5(s, d).where(F.col("mark").isNotNull()).select("kind", "term", "mark"),
        "p5_terms": _p5,
        "p7_pack": _p7,
        "p7_report": lambda s, d: packing.packing_report(_p7(s, d)),
        "p8_found": lambda s, d: _p8(s, d, contamination.contained_items).select("doc_id", "item_id").distinct(),
        "p8_spans": lambda s, d: _p8(s, d, contamination.removal_spans),
        "p9_found": lambda s, d: _p9(s, d, "split_hard").select("doc_id").distinct(),
        "p9_pieces": lambda s, d: _p9(s, d),
    }


_PAIRS = """
WITH r AS (
  SELECT DISTINCT filename, sent_id, CASE WHEN regexp_matches(_token_low, '[a-z]') THEN _token_low END AS item
  FROM corpus WHERE lang = 'en' AND sent_id > 0 AND filename IS NOT NULL
), s AS (SELECT count(*) AS n FROM (SELECT DISTINCT filename, sent_id FROM r)),
i AS (SELECT * FROM r WHERE item IS NOT NULL),
c AS (SELECT item, count(*) AS n FROM i GROUP BY item),
p AS (
  SELECT a.item AS item_a, b.item AS item_b, count(*) AS n_ab
  FROM i a JOIN i b ON a.filename = b.filename AND a.sent_id = b.sent_id AND a.item < b.item
  GROUP BY ALL HAVING count(*) >= 5
)
SELECT item_a, item_b, n_ab, ca.n AS n_a, cb.n AS n_b, s.n AS n_records,
  round(n_ab * s.n / (ca.n * cb.n), 6) AS lift,
  round((n_ab + 0.5) * (s.n - ca.n - cb.n + n_ab + 0.5) / ((ca.n - n_ab + 0.5) * (cb.n - n_ab + 0.5)), 4) AS odds_ratio
FROM p JOIN c ca ON ca.item = item_a JOIN c cb ON cb.item = item_b, s
WHERE n_ab * s.n >= 10 * ca.n * cb.n
"""

_TERMS = """
WITH t AS (SELECT DISTINCT id, doc_id, _token_low, lemma FROM corpus WHERE id IS NOT NULL),
l AS (
  SELECT doc_id, 'token' AS kind, _token_low AS term FROM t WHERE _token_low IS NOT NULL
  UNION ALL SELECT doc_id, 'lemma', lemma FROM t WHERE lemma IS NOT NULL AND lemma NOT IN ('##', '###')
), d AS (SELECT count(DISTINCT doc_id) AS n FROM corpus),
f AS (SELECT lower(trim(token)) AS k, sum(freq) AS freq FROM freq_list WHERE freq > 0 GROUP BY 1),
c AS (SELECT kind, term, count(*) AS n, count(DISTINCT doc_id) AS df FROM l GROUP BY 1, 2)
SELECT kind, term, c.n, df, CAST(coalesce(f.freq, 0) AS BIGINT) AS list_freq,
  CASE WHEN 100 * df > 15 * d.n THEN 'common' WHEN df = 1 AND coalesce(f.freq, 0) < 5 THEN 'rare' END AS mark
FROM c LEFT JOIN f ON f.k = lower(term), d
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"SELECT item_a AS token_a, item_b AS token_b FROM ({_PAIRS})",
        "p3_pairs": _PAIRS,
        "p5_found": f"SELECT kind, term, mark FROM ({_TERMS}) WHERE mark IS NOT NULL",
        "p5_terms": _TERMS,
    }
