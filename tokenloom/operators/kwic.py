"""Concordance: keyword in context (CON1-CON3, AGG10, AGG28, SRT1, SMP1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.expr import band, pmw, zipf
from tokenloom.model import Corpus
from tokenloom.plans.positions import around, matches, near, with_text
from tokenloom.plans.restrict import Restrictions, visible_attributes
from tokenloom.plans.terms import Term, compile_term, glob_regex, parse_query, parse_term


def collocate_filter(text: str, pos: str = "") -> Column:
    """Predicate of a collocate filter: a word (exact or with wildcards, without case), a
    [lemma], a _POS or token_POS, and optionally a POS of its own (Q9)."""
    tests: list[Column] = []
    if text:
        term = parse_term(text)
        if term.kind == "tag":
            raise ValueError("a tag cannot be a collocate filter")
        if term.kind == "word":
            tests.append(F.col("_token_low").rlike("(?i)" + glob_regex(term.value)) if "*" in term.value else F.col("_token_low") == term.value)
        elif term.kind == "lemma":
            tests.append(F.col("lemma").rlike("(?i)" + glob_regex(term.value, alternation=True)))
        elif term.kind == "pos":
            tests.append(F.col("pos").rlike("(?i)" + glob_regex(term.value, alternation=True)))
        else:
            tests.append(compile_term(term))
    if pos:
        tests.append(F.col("pos").rlike("(?i)" + glob_regex(pos.lstrip("_"), alternation=True)))
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def hits(corpus: Corpus, query: str, *, restrictions: Restrictions | None = None, collocate: str = "", collocate_pos: str = "", window: int = 5) -> DataFrame:
    """Matches (id, len) of a query, optionally only those near a collocate."""
    found = matches(corpus, parse_query(query), restrictions)
    if collocate or collocate_pos:
        found = near(found, corpus.tokens.where(collocate_filter(collocate, collocate_pos)), window)
    return found


def chosen(found: DataFrame, limit: int | None, sample: bool, seed: int = 42) -> DataFrame:
    """The first hits by id, or a seeded sample of them (Q7, SMP1)."""
    if limit is None:
        return found
    order = [F.xxhash64("id", F.lit(seed)), F.col("id")] if sample else [F.col("id")]
    return found.orderBy(*order).limit(limit)


def kwic(
    corpus: Corpus,
    query: str,
    *,
    left: int = 7,
    right: int = 7,
    limit: int | None = 100,
    sample: bool = False,
    restrictions: Restrictions | None = None,
    collocate: str = "",
    collocate_pos: str = "",
    window: int = 5,
    show_pos: bool = False,
    show_lemma: bool = False,
    metadata: bool = True,
) -> DataFrame:
    """Keyword in context: match_id, left, node, right, collocate, metadata.

    The limit is applied before any context is fetched. Contexts cross sentence and file
    boundaries. With a collocate filter both context widths become its window (CON3) and
    collocate holds the first token that fits it in line order (CON2). metadata holds the
    visible attributes of the node's first token that are not blank, as JSON. Limit None
    gives every hit. No hit gives no row."""
    active = bool(collocate or collocate_pos)
    if active:
        left = right = window
    found = chosen(hits(corpus, query, restrictions=restrictions, collocate=collocate, collocate_pos=collocate_pos, window=window), limit, sample)
    text = F.col("token")
    if show_pos:
        text = F.concat_ws("/", text, "pos")
    if show_lemma:
        text = F.concat_ws("/", text, "lemma")
    shown = [c for c in visible_attributes(corpus.tokens) if c != "doc_id"] if metadata else []
    base = corpus.tokens.withColumn("_t", text).withColumn("_hit", collocate_filter(collocate, collocate_pos) if active else F.lit(False))
    if shown:
        pairs = F.filter(
            F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in shown]),
            lambda x: x["value"].isNotNull() & (F.trim(x["value"]) != ""),
        )
        base = base.withColumn("_meta", F.to_json(F.map_from_entries(pairs)))
    else:
        base = base.withColumn("_meta", F.lit(None).cast("string"))
    lines = around(found, base, left, right, ["_t", "_hit", "_meta", "token"])
    grouped = lines.groupBy("id", "len").agg(F.sort_array(F.collect_list(F.struct("offset", "_t", "_hit", "_meta", "token"))).alias("_w"))

    def part(test) -> Column:
        return F.array_join(F.transform(F.filter("_w", test), lambda x: x["_t"]), " ")

    outside = F.filter("_w", lambda x: x["_hit"] & ((x["offset"] < 0) | (x["offset"] >= F.col("len"))))
    return grouped.select(
        F.col("id").alias("match_id"),
        part(lambda x: x["offset"] < 0).alias("left"),
        part(lambda x: (x["offset"] >= 0) & (x["offset"] < F.col("len"))).alias("node"),
        part(lambda x: x["offset"] >= F.col("len")).alias("right"),
        F.try_element_at(outside, F.lit(1))["token"].alias("collocate"),
        F.try_element_at(F.filter("_w", lambda x: x["offset"] == 0), F.lit(1))["_meta"].alias("metadata"),
    )


def breakdown(corpus: Corpus, query: str, *, restrictions: Restrictions | None = None, **filters) -> DataFrame:
    """AGG10: token_form, absolute_frequency, per_million, zipf (2 places), band of every
    form matched, letter case kept."""
    found = with_text(hits(corpus, query, restrictions=restrictions, **filters), corpus.tokens)
    total = corpus.where(restrictions).size
    counts = found.groupBy(F.col("match_token").alias("token_form")).agg(F.count("*").alias("absolute_frequency"))
    per = pmw(F.col("absolute_frequency"), F.lit(total))
    return counts.withColumn("per_million", per).withColumn("zipf", F.round(zipf(F.col("per_million")), 2)).withColumn("band", band(zipf(F.col("per_million"))))


def sort_lines(lines: DataFrame, by: str = "left", descending: bool = False) -> DataFrame:
    """SRT1: lines by left, node or right text, markup and case aside."""
    key = F.lower(F.regexp_replace(by, "<[^>]*>", ""))
    return lines.orderBy(key.desc() if descending else key.asc(), "match_id")


def frequency(corpus: Corpus, query: str, **filters) -> int:
    """AGG28: number of hits."""
    return hits(corpus, query, **filters).count()


__all__ = ["Term", "breakdown", "chosen", "collocate_filter", "frequency", "hits", "kwic", "sort_lines"]
