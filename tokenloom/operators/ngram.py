"""N-grams (AGG11, PRD16, PRD17, WIN1, SRT3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.expr import pmw
from tokenloom.model import Corpus
from tokenloom.plans.positions import leads
from tokenloom.plans.restrict import PUNCT, Restrictions
from tokenloom.plans.terms import basis_column, slot_predicate


def ngrams(
    corpus: Corpus,
    n: int = 2,
    *,
    restrictions: Restrictions | None = None,
    slots: dict[int, str | list[str]] | None = None,
    basis: str | list[str] = "t",
    skip_punctuation: bool = False,
    skip_pos: list[str] | None = None,
    negative: list[str] | None = None,
    min_freq: int = 1,
    raw: bool | None = None,
    top: int | None = None,
) -> DataFrame:
    """Counts of runs of n tokens: ngram, frequency, per_million.

    Order of steps: restriction, punctuation and POS left out, neighbours by what is left
    (n-grams bridge the tokens left out), slot filters (slot numbers from 1) and the
    negative list, no null slot, count, only n-grams with some token that is neither one
    ASCII punctuation mark nor all digits. basis is t, p or l for all slots or one each.
    Empty when fewer than n tokens are left. top gives the so many commonest, ordered by
    frequency, then n-gram (SRT3)."""
    raw = corpus.is_raw if raw is None and slots else bool(raw)
    region = corpus.where(restrictions)
    kept = region.tokens
    filtered = bool(restrictions) or skip_punctuation or bool(skip_pos)
    if skip_punctuation:
        kept = kept.where(~F.col("_token_low").isin(*PUNCT))
    if skip_pos:
        kept = kept.where(~F.col("pos").isin(*skip_pos))
    each = [basis] * n if isinstance(basis, str) else list(basis)
    needed = {basis_column(b) for b in each} | {"_token_low"}
    if slots:
        needed |= {"pos", "lemma"}
    wide = leads(kept, sorted(needed), n, dense=not filtered and corpus.is_dense, label="ngrams")
    for k, pattern in (slots or {}).items():
        cols = {c: F.col(f"{c}_{k}") for c in needed}
        wide = wide.where(slot_predicate(pattern, cols["_token_low"], cols["pos"], cols["lemma"], each[k - 1], raw))
    if negative:
        low = [w.lower() for w in negative]
        wide = reduce(lambda d, k: d.where(~F.col(f"_token_low_{k}").isin(*low)), range(1, n + 1), wide)
    shown = [f"{basis_column(b)}_{k + 1}" for k, b in enumerate(each)]
    wide = reduce(lambda d, c: d.where(F.col(c).isNotNull()), shown, wide)
    counts = wide.groupBy(*dict.fromkeys(shown)).agg(F.count("*").alias("frequency"))
    content = reduce(lambda a, c: a | ~F.col(c).rlike(r"^(\p{Punct}|\p{Nd}+)\z"), shown, F.lit(False))
    out = counts.where(content & (F.col("frequency") >= min_freq)).select(
        F.concat_ws(" ", *shown).alias("ngram"), "frequency", pmw(F.col("frequency"), F.lit(region.size)).alias("per_million")
    )
    return out if top is None else out.orderBy(F.desc("frequency"), "ngram").limit(top)

