"""Positional plans: sequences, contexts, spans and n-gram windows by equi-joins.

Every "between id-w and id+w" is written as positions exploded from the small side and
joined on the id itself (P1), so no plan needs a nested-loop or range join.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.model import Corpus
from tokenloom.plans.blocks import BLOCK
from tokenloom.plans.dense import dense_number
from tokenloom.plans.restrict import Restrictions, predicate
from tokenloom.plans.terms import Term, compile_term, term_length

#: Ids of a window chunk, and of the next chunk that are read with it.
CHUNK, HALO = 65_536, 1_024
#: Hits that are few; id ranges that a scan is asked for.
FEW, RANGES = 20_000, 64


def matches(corpus: Corpus, terms: list[Term], restrictions: Restrictions | None = None, *, raw: bool | None = None, alternation: bool = False) -> DataFrame:
    """id and len of every hit of a sequence of terms (JN1).

    Each term is filtered first; hits are chained by equality of the next position, so
    the exchange carries hits only. A restriction looks at the first token (Q6)."""
    raw = corpus.is_raw if raw is None and any(t.kind in ("lemma", "pos", "token_pos") for t in terms) else bool(raw)
    found = None
    for k, term in enumerate(terms):
        rows = corpus.tokens
        if k == 0 and restrictions:
            rows = rows.where(predicate(restrictions))
        rows = rows.where(compile_term(term, raw=raw, alternation=alternation)).select(F.col("id").alias("_at"), term_length(term).alias("_len"))
        if found is None:
            found = rows.select(F.col("_at").alias("id"), F.col("_len").alias("len"))
        else:
            found = found.join(rows, F.col("id") + F.col("len") == F.col("_at")).select("id", (F.col("len") + F.col("_len")).alias("len"))
    return found


def few(hits: DataFrame) -> tuple[DataFrame, pa.Table | None]:
    """The hits and, if they are at most FEW (checked), their rows on the driver; then the
    hits are a local table that costs no second search."""
    rows = hits.limit(FEW + 1).toArrow()
    return (hits, None) if rows.num_rows > FEW else (hits.sparkSession.createDataFrame(rows, hits.schema), rows)


def in_reach(tokens: DataFrame, rows: pa.Table, left: int, right: int) -> DataFrame:
    """The tokens of the id ranges around some hits. The corpus is stored in id order, so
    the ranges prune files and row groups; near ranges are joined until few are left, and
    all are one if they leave out less than half."""
    if rows.num_rows == 0:
        return tokens.where(F.lit(False))
    ids = rows.column("id").to_numpy()
    order = np.argsort(ids)
    low, high = (ids - left)[order], np.maximum.accumulate((ids + rows.column("len").to_numpy() + right)[order])
    gap = BLOCK
    while True:
        first = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1] + gap]))
        last = np.append(first[1:], len(low)) - 1
        if len(first) <= RANGES:
            break
        gap *= 4
    if 2 * (high[last] - low[first]).sum() > high[-1] - low[0]:
        first, last = first[:1], last[-1:]
    ranges = [F.col("id").between(int(a), int(b)) for a, b in zip(low[first], high[last])]
    return tokens.where(reduce(lambda a, b: a | b, ranges))


def around(hits: DataFrame, tokens: DataFrame, left: int, right: int, columns: list[str], rows: pa.Table | None = None) -> DataFrame:
    """Token rows from left before to right after each hit: the columns of hits, pos_id,
    offset (negative before, 0 to len-1 inside, len and more after) and the token columns (JN2).

    Few hits (checked, or given as rows) read only their id ranges and meet them by
    broadcast; many are joined on the id."""
    if rows is None:
        hits, rows = few(hits)
    if rows is not None:
        tokens = in_reach(tokens, rows, left, right)
        hits = F.broadcast(hits)
    spread = hits.withColumn("offset", F.explode(F.sequence(F.lit(-left).cast("bigint"), F.col("len") + right - 1))).withColumn("pos_id", F.col("id") + F.col("offset"))
    return spread.join(tokens.select(F.col("id").alias("pos_id"), *[c for c in columns if c != "id"]), "pos_id")


def with_text(hits: DataFrame, tokens: DataFrame, column: str = "token", name: str = "match_token") -> DataFrame:
    """Each hit with the text of its span (PRJ3, JN5)."""
    hits, rows = few(hits)
    inside = around(hits.select("id", "len"), tokens, 0, 0, [column], rows)
    joined = inside.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("offset", F.col(column).alias("t")))).alias("_w"))
    return hits.join(joined.select("id", F.array_join(F.transform("_w", lambda x: x["t"]), " ").alias(name)), "id")


def near(hits: DataFrame, collocates: DataFrame, window: int) -> DataFrame:
    """Hits with a collocate (an id) within the window, the hit itself left out (JN4)."""
    spread = hits.select("id", F.explode(F.sequence(F.lit(-window).cast("bigint"), F.col("len") + window - 1)).alias("_o"), "len").where(
        (F.col("_o") < 0) | (F.col("_o") >= F.col("len"))
    )
    kept = spread.withColumn("_p", F.col("id") + F.col("_o")).join(collocates.select(F.col("id").alias("_p")), "_p", "left_semi")
    return hits.join(kept.select("id").distinct(), "id", "left_semi")


def _halo_suffices(rows: DataFrame, n: int) -> bool:
    """Whether every chunk of ids that holds rows is followed by n-1 more rows within HALO
    ids, but for the last one. One small row per chunk is exchanged."""
    chunk = F.floor(F.col("id") / CHUNK).cast("bigint")
    each = rows.select(chunk.alias("_c"), (F.pmod("id", F.lit(CHUNK)) < HALO).alias("_h")).groupBy("_c").agg(F.count_if("_h").alias("_n"))
    good = each.where(F.col("_n") >= n - 1).select((F.col("_c") - 1).alias("_c"))
    return each.join(good, "_c", "left_anti").limit(2).count() <= 1


def leads(rows: DataFrame, columns: list[str], n: int, *, dense: bool = False, label: str = "leads") -> DataFrame:
    """For every row the values of the columns in it and the n-1 next rows by id, as
    <column>_1 .. <column>_n (WIN1, P2).

    Without one global window and without renumbering: rows are exchanged by chunks of
    ids, and the rows in the first HALO ids of each chunk are copied to the chunk before.
    Where rows were left out so thickly that this is not enough (checked), they are
    numbered densely first (P3). dense tells that the ids are without gaps."""
    if dense or _halo_suffices(rows, n):
        numbered, halo = rows.select(F.col("id").alias("_n"), *columns), (n - 1 if dense else HALO)
    else:
        numbered, halo = dense_number(rows.select("id", *columns), ["id"], "_n", 1, label), n - 1
    own = F.floor(F.col("_n") / CHUNK).cast("bigint")
    copies = F.when(F.pmod("_n", F.lit(CHUNK)) < halo, F.array(own, own - 1)).otherwise(F.array(own))
    spread = numbered.withColumn("_own", own).withColumn("_chunk", F.explode(copies))
    window = Window.partitionBy("_chunk").orderBy("_n")
    wide = spread.select(
        (F.col("_own") == F.col("_chunk")).alias("_owned"),
        *[F.col("_n")],
        *[(F.lead(c, k).over(window) if k else F.col(c)).alias(f"{c}_{k + 1}") for c in columns for k in range(n)],
    )
    return wide.where("_owned").drop("_owned")
