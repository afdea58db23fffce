"""Problem 8: evaluation passages inside training texts."""

from __future__ import annotations

import html
import os
import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.fm_index import FMIndex
from tokenloom.session import spread

#: Symbols of the longest phrases that are searched.
PHRASE = 4
#: Symbols of one shard's index.
SHARD = 400_000
#: Characters of all passages of one pass over the corpus; what a task holds of them.
PASS = 100_000_000
#: Phrase hits, and compared symbols, that are worked on at once.
HITS, CELLS = 4_000_000, 2_000_000

# Markup inside a word leaves no gap; other markup does. Fixed values.
_INLINE = re.compile(r"</?(?:b|i|u|em|strong|span|a|sup|sub|font|mark|small)(?:\s[^<>]*)?>", re.I)
_MARKUP = re.compile(r"<[^<>]*>")
_HAN = "々〇぀-ヺー-ヿ㐀-䶿一-鿿豈-﫿"
#: As html.unescape reads references.
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
#: A character and what may compose with it: normalising never reaches beyond.
_CLUSTER = regex.compile(r".[\p{M}\u1160-\u11ff\ud7b0-\ud7fb\uff9e-\uffdc]*", regex.S)
_UNIT = re.compile(f"[{_HAN}]|[^\\W_{_HAN}]+")


def units(text: str) -> list[str]:
    """Words (characters in scripts without spaces) without case, marks and markup."""
    if "<" in text:
        text = _MARKUP.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    return _UNIT.findall(unicodedata.normalize("NFKC", text).lower())


def _pieces(pattern, text: str, change) -> Iterator[tuple[str, int, int]]:
    """(text, start, end): the matches changed, all other characters one by one."""
    at = 0
    for m in pattern.finditer(text):
        yield from ((text[i], i, i + 1) for i in range(at, m.start()))
        yield change(m[0]), m.start(), m.end()
        at = m.end()
    yield from ((text[i], i, i + 1) for i in range(at, len(text)))


def _mapped(pieces: Iterator[tuple[str, int, int]], starts: list[int], ends: list[int]) -> tuple[str, list[int], list[int]]:
    """The joined pieces, with the place each character has in the text as it stands."""
    out, first, last, opened = [], [], [], None
    for new, a, b in pieces:
        start = starts[a] if opened is None else opened
        opened = None if new else start  # what vanishes goes with the character after it
        out.append(new)
        first += [start] * len(new)
        last += [ends[b - 1]] * len(new)
    return "".join(out), first, last


def _unescaped(text: str) -> Iterator[tuple[str, int, int]]:
    for new, a, b in _pieces(_REFERENCE, text, html.unescape):
        # a reference without its semicolon may draw in letters that stay as they are
        kept = len(os.path.commonprefix([new[:0:-1], text[b - 1 : a : -1]])) if b - a > 1 else 0
        yield new[: len(new) - kept], a, b - kept
        yield from ((text[i], i, i + 1) for i in range(b - kept, b))


def unit_spans(text: str) -> list[tuple[int, int]]:
    """Character spans of units(text) in the text as it stands: every step of units()
    done piece by piece, with the places carried along."""
    if "<" not in text and "&" not in text and unicodedata.is_normalized("NFKC", text) and len(text.lower()) == len(text):
        return [m.span() for m in _UNIT.finditer(text.lower())]  # nothing moves
    starts, ends = list(range(len(text))), list(range(1, len(text) + 1))
    if "<" in text:
        text, starts, ends = _mapped(_pieces(_INLINE, text, lambda _: ""), starts, ends)
        text, starts, ends = _mapped(_pieces(_MARKUP, text, lambda _: " "), starts, ends)
    if "&" in text:
        text, starts, ends = _mapped(_unescaped(text), starts, ends)
    if not unicodedata.is_normalized("NFKC", text):
        text, starts, ends = _mapped(_pieces(_CLUSTER, text, lambda c: unicodedata.normalize("NFKC", c)), starts, ends)
    text, starts, ends = _mapped(((c.lower(), i, i + 1) for i, c in enumerate(text)), starts, ends)
    return [(starts[m.start()], ends[m.end() - 1]) for m in _UNIT.finditer(text)]


def allowed(length: int, other: float) -> int:
    """Other words that a stretch may hold; none in one of fewer than four words."""
    return int(np.ceil(other * length - 1e-9)) if length >= 4 else 0


def phrase_filter(n: int, share: float, other: float) -> tuple[int, int]:
    """(symbols of a phrase, whole phrases) that every valid stretch of a passage of n
    units leaves at least: a stretch of m words with k others holds m - q + 1 phrases of
    q words, and each other word spoils at most q of them."""
    half = int(np.ceil(share * n - 1e-9))
    for q in range(PHRASE, 0, -1):
        least = min(m - q + 1 - q * allowed(m, other) for m in range(max(1, half), n + 1))
        if least >= 1:
            return q, least
    return 1, 1


class Items:
    """Phrases of the passages, and where each phrase stands."""

    def __init__(self, rows: list[tuple[int, str]], share: float, other: float):
        cut = [(i, units(p)) for i, p in rows]
        cut = [(i, u) for i, u in cut if len(u) >= PHRASE]
        self.ids, self.units = [i for i, _ in cut], [u for _, u in cut]
        self.share, self.other = share, other
        self.vocabulary = {w: k + 2 for k, w in enumerate(sorted({w for u in self.units for w in u}))}
        self.codes = [np.array([self.vocabulary[w] for w in u], dtype=np.int64) for u in self.units]
        filters = [phrase_filter(len(u), share, other) for u in self.units]
        self.need = np.array([least for _, least in filters], dtype=np.int64)
        self.half = np.array([int(np.ceil(share * len(u) - 1e-9)) for u in self.units], dtype=np.int64)
        #: Other words of a whole passage: by so much the diagonals of one copy may differ.
        self.band = np.array([allowed(len(u), other) for u in self.units], dtype=np.int64)
        self.phrases: list[np.ndarray] = []
        item, place, phrase, known = [], [], [], 0
        for q in sorted({q for q, _ in filters}):
            own = [k for k, (p, _) in enumerate(filters) if p == q]
            grams = np.concatenate([np.lib.stride_tricks.sliding_window_view(self.codes[k], q) for k in own])
            distinct, which = np.unique(grams, axis=0, return_inverse=True)
            sizes = [len(self.codes[k]) - q + 1 for k in own]
            item.append(np.repeat(own, sizes))
            place.append(np.concatenate([np.arange(n) for n in sizes]))
            phrase.append(which.ravel() + known)
            self.phrases.append(distinct)
            known += len(distinct)
        if item:
            item, place, phrase = (np.concatenate(x).astype(np.int64) for x in (item, place, phrase))
            order = np.argsort(item, kind="stable")
            self.item, self.place, self.phrase = item[order], place[order], phrase[order]


def same_order(passage: np.ndarray, doc: np.ndarray, low: int, high: int, half: int, other: float) -> tuple[int, int, int]:
    """Longest stretch of the passage that stands word by word on one of the diagonals
    from low to high, with at most the allowed other words, wherever they are: (its
    words, start and end of its agreeing words in doc)."""
    n, best = len(passage), (0, 0, 0)
    limit = np.array([allowed(m, other) for m in range(n + 1)])
    for diagonal in range(low, high + 1):
        first, last = max(0, -diagonal), min(n, len(doc) - diagonal)
        if last - first < half:
            continue
        agree = doc[diagonal + first : diagonal + last] == passage[first:last]
        if agree.sum() < half - limit[half]:
            continue
        total = np.concatenate([[0], np.cumsum(agree)])
        k = np.arange(len(total))
        size = k[None, :] - k[:, None]
        fits = (size > 0) & (size - (total[None, :] - total[:, None]) <= limit[np.maximum(size, 0)])
        size = np.where(fits, size, 0)
        s, e = np.unravel_index(np.argmax(size), size.shape)
        if size[s, e] > best[0]:
            inside = np.flatnonzero(agree[s:e])
            start = diagonal + first + int(s)
            best = (int(size[s, e]), start + int(inside[0]), start + int(inside[-1]) + 1)
    return best


def stretch(passage: list[str], window: list[str], other: float) -> tuple[int, int, int]:
    """The same where words were put in or left out: longest stretch by the blocks that
    match in order, counted between its first and last agreeing words."""
    m = SequenceMatcher(None, passage, window, autojunk=False)
    a, b = [], []
    for i, j, n in m.get_matching_blocks():
        a += range(i, i + n)
        b += range(j, j + n)
    if not a:
        return 0, 0, 0
    a, b = np.array(a), np.array(b)
    k = np.arange(len(a))
    own, there = a[None, :] - a[:, None] + 1, b[None, :] - b[:, None] + 1
    same = k[None, :] - k[:, None] + 1
    limit = np.array([allowed(m, other) for m in range(len(passage) + 1)])
    fits = (same > 0) & (np.maximum(own, there) - same <= limit[np.maximum(own, 0)])
    own = np.where(fits, own, 0)
    s, t = np.unravel_index(np.argmax(own), own.shape)
    return int(own[s, t]), int(b[s]), int(b[t]) + 1


class Shard:
    """Some documents, their index, and the passages in them."""

    def __init__(self, items: Items, words: list[list[str]]):
        self.items, self.words = items, words
        self.coded = [np.fromiter(map(items.vocabulary.get, w, repeat(1)), dtype=np.int64, count=len(w)) for w in words]
        self.size = np.array([len(c) for c in self.coded], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.concatenate([*self.coded, np.ones(1, np.int64)])
        # each document ends with a symbol that no phrase has; runs of words that no passage has shrink to one
        doc_of = np.repeat(np.arange(len(words)), self.size + 1)
        offset = np.arange(len(doc_of)) - (self.start + np.arange(len(words)))[doc_of]
        symbols = np.ones(len(doc_of), dtype=np.int64)
        symbols[offset < self.size[doc_of]] = self.flat[:-1]
        keep = np.concatenate([[True], (symbols[1:] != 1) | (symbols[:-1] != 1)])
        self.doc_of, self.offset, self.symbols = doc_of[keep], offset[keep], symbols[keep]

    def hits(self) -> tuple[np.ndarray, np.ndarray]:
        """(number of places of each phrase, all places in order of the phrases)."""
        index = FMIndex(self.symbols, len(self.items.vocabulary) + 2)
        counts, places = [], []
        for phrases in self.items.phrases:
            low, high = index.search(phrases)
            n = high - low
            rows = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            counts.append(n)
            places.append(index.locate(rows))
        return np.concatenate(counts), np.concatenate(places)

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document, item, lowest diagonal) wherever enough phrases stand on a band of diagonals."""
        items = self.items
        counts, places = self.hits()
        first = np.cumsum(counts) - counts
        cost = counts[items.phrase]
        # whole items at a time, so that the expanded hits stay bounded
        item_starts = np.flatnonzero(np.concatenate([[True], items.item[1:] != items.item[:-1]]))
        by_item = np.add.reduceat(cost, item_starts)
        part = np.cumsum(by_item) // HITS
        for p in np.unique(part):
            own = np.flatnonzero(part == p)
            low = item_starts[own[0]]
            high = item_starts[own[-1] + 1] if own[-1] + 1 < len(item_starts) else len(items.item)
            n = cost[low:high]
            entry = np.repeat(np.arange(low, high), n)
            at = places[np.repeat(first[items.phrase[low:high]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            doc, item, diagonal = self.doc_of[at], items.item[entry], self.offset[at] - items.place[entry]
            order = np.lexsort((diagonal, item, doc))
            doc, item, diagonal = doc[order], item[order], diagonal[order]
            key = (doc * len(items.ids) + item) * (1 << 32) + diagonal + (1 << 24)
            band = items.band[item]
            good = np.searchsorted(key, key + band, side="right") - np.arange(len(key)) >= items.need[item]
            doc, item, diagonal, band = doc[good], item[good], diagonal[good], band[good]
            bins = np.unique(np.stack([item, doc, diagonal // (band + 1)], axis=1), axis=0)
            if len(bins):
                yield bins[:, 1], bins[:, 0], bins[:, 2] * (items.band[bins[:, 0]] + 1)

    def promising(self, k: int, doc: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Whether enough words of passage k agree on some diagonal from low to low + 2 * band."""
        passage, width = self.items.codes[k], 2 * int(self.items.band[k]) + 1
        least = int(self.items.half[k]) - allowed(int(self.items.half[k]), self.items.other)
        out = np.zeros(len(doc), dtype=bool)
        step = max(1, CELLS // (width * len(passage)))
        for i in range(0, len(doc), step):
            own = slice(i, i + step)
            at = low[own, None, None] + np.arange(width)[None, :, None] + np.arange(len(passage))[None, None, :]
            inside = (at >= 0) & (at < self.size[doc[own], None, None])
            agree = inside & (self.flat[np.where(inside, at + self.start[doc[own], None, None], 0)] == passage)
            out[own] = agree.any(axis=1).sum(axis=1) >= least
        return out

    def found(self) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, item, words, start, end) of every stretch; those of one document
        and item that overlap are one."""
        items = self.items
        for doc, item, low in self.candidates():
            starts = [*np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])), len(item)]
            for a, b in zip(starts[:-1], starts[1:]):
                k = int(item[a])
                passage, band, half = items.units[k], int(items.band[k]), int(items.half[k])
                kept: dict[int, list[tuple[int, int, int]]] = {}
                for i in np.flatnonzero(self.promising(k, doc[a:b], low[a:b])) + a:
                    d, at = int(doc[i]), int(low[i])
                    best = same_order(items.codes[k], self.coded[d], at, at + 2 * band, half, items.other)
                    start = max(0, at - band)
                    moved = stretch(passage, self.words[d][start : at + len(passage) + 3 * band], items.other)
                    if moved[0] > best[0]:
                        best = (moved[0], start + moved[1], start + moved[2])
                    if best[0] >= half:
                        kept.setdefault(d, []).append(best)
                for d, spans in kept.items():
                    end, held = -1, None
                    for size, s, e in sorted(spans, key=lambda x: (x[1], -x[0])):
                        if held is not None and s < end:
                            held = max(held, (size, s, e))
                        else:
                            if held is not None:
                                yield d, k, *held
                            held = (size, s, e)
                        end = max(end, e)
                    yield d, k, *held


def _search(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, words, texts, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            found, known = [], {}
            for d, k, n, start, end in Shard(items, words).found():
                if d not in known:
                    known[d] = unit_spans(texts[d])
                spans = known[d]
                found.append((docs[d], items.ids[k], n, len(items.units[k]), spans[start][0], spans[end - 1][1]))
            columns = list(zip(*found)) if found else [()] * 6
            for held in (docs, words, texts):
                held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _COLUMNS)

        for batch in batches:
            for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                w = units(t)
                if not w:
                    continue
                docs.append(d)
                words.append(w)
                texts.append(t)
                size += len(w)
                if size >= SHARD:
                    yield flush()
                    size = 0
        if docs:
            yield flush()

    return run


_COLUMNS = ["doc_id", "item_id", "matched", "passage", "char_start", "char_end"]


def contained_items(documents: DataFrame, eval_items: DataFrame, *, share: float = 0.5, other: float = 0.15) -> DataFrame:
    """Every document that holds a passage, or an unbroken stretch of at least `share` of
    it in which at most the share `other` of the words differs.

    Method: FM-index per shard of the documents (symbols: words without case, marks and
    markup; characters where a script has no spaces). Phrases of the passages are looked
    up by backward search through wavelet-matrix ranks, their places come from sampled
    suffix positions; enough phrases on a band of diagonals make a candidate, which an
    exact alignment then checks. Length and number of the phrases follow for each
    passage from what a valid stretch leaves at least (phrase_filter), so the filter
    loses none: phrases of four words in long passages, of two in short ones.

    Other words may stand anywhere in a stretch, at its ends too; of m words
    ceil(other * m) may be others, none if m < 4. Words put in or left out count as
    other words; such stretches are found where their matching blocks show them.

    One narrow pass over the documents without any exchange; each shard is indexed once
    for all passages. Passages of more than PASS characters in all are searched in
    several passes. Columns: doc_id, item_id, matched (units of the passage), passage
    (its units), char_start, char_end (of the stretch in the text as it stands, never
    null); one row per occurrence. Null or blank texts and passages give no row, nor do
    passages of fewer than 4 units."""
    usable = eval_items.where(F.col("item_id").isNotNull() & F.col("passage").isNotNull()).select("item_id", "passage").distinct()
    size = usable.agg(F.sum(F.length("passage"))).first()[0] or 0
    texts = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text")
    texts = spread(texts)
    out = documents.sparkSession.createDataFrame([], ", ".join(f"{c} bigint" for c in _COLUMNS))
    n_blocks = -(-size // PASS)
    for b in range(n_blocks):
        block = usable.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b).collect()
        items = Items(sorted((r["item_id"], r["passage"]) for r in block), share, other)
        if items.ids:
            out = out.unionByName(texts.mapInArrow(_search(items), out.schema))
    return out


def removal_spans(documents: DataFrame, eval_items: DataFrame, **options: float) -> DataFrame:
    """Overlapping stretches of a document merged: doc_id, char_start, char_end, items."""

    def merge(batch):
        batch = batch.sort_values(["char_start", "char_end"])
        rows, end = [], None
        for r in batch.itertuples():
            if end is None or r.char_start > end:
                rows.append([r.doc_id, r.char_start, r.char_end, {r.item_id}])
            rows[-1][2] = max(rows[-1][2], r.char_end)
            rows[-1][3].add(r.item_id)
            end = rows[-1][2]
        import pandas as pd

        return pd.DataFrame([(d, a, b, sorted(i)) for d, a, b, i in rows], columns=["doc_id", "char_start", "char_end", "items"])

    found = contained_items(documents, eval_items, **options).select("doc_id", "item_id", "char_start", "char_end").distinct()
    return found.groupBy("doc_id").applyInPandas(merge, "doc_id bigint, char_start bigint, char_end bigint, items array<bigint>")
