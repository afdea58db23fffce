"""Collocates grouped by patterns (PAT6, PAT7, SMP4)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.model import Corpus
from tokenloom.operators.collocation import collocations
from tokenloom.plans.patterns import Element, match
from tokenloom.plans.positions import around
from tokenloom.plans.restrict import Restrictions


def node_lines(corpus: Corpus, word: str, *, window: int = 5, limit: int | None = None, restrictions: Restrictions | None = None) -> DataFrame:
    """PAT7: id, line (array of token, pos, lemma) around each occurrence of a word; with a
    limit the first so many by id (SMP4). One job for all lines."""
    nodes = corpus.where(restrictions).tokens.where(F.col("_token_low") == word.lower()).select("id", F.lit(1).cast("bigint").alias("len"))
    if limit is not None:
        nodes = nodes.orderBy("id").limit(limit)
    lines = around(nodes, corpus.tokens, window, window, ["token", "pos", "lemma"])
    packed = lines.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("offset", "token", "pos", "lemma"))).alias("_w"))
    return packed.select("id", F.transform("_w", lambda x: F.struct(x["token"].alias("token"), x["pos"].alias("pos"), x["lemma"].alias("lemma"))).alias("line"))


def group_by_patterns(
    corpus: Corpus,
    word: str,
    patterns: list[tuple[str, tuple[Element, ...]]],
    *,
    window: int = 5,
    top: int = 50,
    min_freq: int = 1,
    limit: int | None = None,
    restrictions: Restrictions | None = None,
) -> DataFrame:
    """PAT6: label, collocate, match_id, example: the top collocates that occur with the
    word in a pattern, once per pattern, with the first line that shows it. A pattern's
    parse and the list of at most `top` collocates go to the workers; lines stay where
    they are."""
    best = [r["collocate"] for r in collocations(corpus, word, window=window, min_freq=min_freq, limit=top, restrictions=restrictions).select("collocate").distinct().collect()]
    wanted = sorted(b for b in best if b is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"label": [], "collocate": [], "match_id": [], "example": []}
            for key, line in zip(batch.column("id").to_pylist(), batch.column("line").to_pylist()):
                words = [(t["token"] or "", t["pos"], t["lemma"]) for t in line]
                present = {w.lower() for w, _, _ in words}
                for collocate in wanted:
                    if collocate not in present:
                        continue
                    for label, elements in patterns:
                        if match(elements, words, word, collocate)[0]:
                            for k, v in zip(out, (label, collocate, key, " ".join(w for w, _, _ in words))):
                                out[k].append(v)
            types = (pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(out, types)], list(out))

    found = node_lines(corpus, word, window=window, limit=limit, restrictions=restrictions).mapInArrow(run, "label string, collocate string, match_id bigint, example string")
    return found.groupBy("label", "collocate").agg(F.min("match_id").alias("match_id"), F.min_by("example", "match_id").alias("example"))
