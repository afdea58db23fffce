"""Problem 2: sentence boundaries across languages and scripts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.encoding import mend_word
from tokenloom.plans.groups import group_starts, sorted_groups
from tokenloom.session import materialize

#: Order of the language model.
ORDER = 4
#: Ids of a block, and ids of the neighbours read with it.
BLOCK, HALO = 8192, 512
#: Blocks whose texts are decoded together, with the n-grams that they ask for.
PART = 16
#: Occurrences that make a word a symbol of its own: at least so many, and so many in so
#: many tokens of its language.
WORD_COUNT, WORD_TOKENS = 50, 200_000
#: A quotation between straight marks that is still open after so many tokens is taken
#: as unclosed; others are unclosed where the next one opens or the document ends.
QUOTE_SPAN = 400

#: The boundary event, and an unknown place before a text.
S, BEFORE = 1, 2

# Marks that end sentences and marks around quotations. Fixed values.
_ENDERS = regex.compile(r"[.!?…。．！？｡؟।॥]+")
_OPEN, _CLOSE, _TOGGLE = set("“«「『‹"), set("”»」』›"), set('"')
_DE_OPEN, _DE_CLOSE = set("„»‚›"), set("“«‘‹")

_P = np.uint64(0x9E3779B97F4A7C15)


def _shape(word: str) -> str:
    """Class of a word that is no symbol of its own."""
    if regex.search(r"\d", word):
        return "#" + regex.sub(r"\d+", "0", word)
    if not regex.search(r"\p{L}", word):
        return "." + word
    tail = regex.search(r"[^\p{L}\p{M}]*$", word)[0]
    first = regex.search(r"\p{L}", word)[0]
    if regex.match(r"\p{Latin}", first):
        body = word[: len(word) - len(tail)]
        size = "1" if len(body) == 1 else "n"
        case = "U" if body.isupper() and len(body) > 1 else "X" if first.isupper() else "x"
        return "@" + case + size + ("." if "." in body else "") + tail
    if regex.match(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]", first):
        return "@o" + word[-1]
    return "@o" + tail


def _code(symbol: str) -> int:
    return zlib.crc32(symbol.encode("utf-8", "surrogatepass")) + 16


class Symbols:
    """Words to symbols: the word itself if it is frequent in its language, else its shape."""

    def __init__(self, vocabulary: set[tuple[str, str]], quote_span: int = QUOTE_SPAN):
        self.vocabulary = vocabulary
        self.quote_span = quote_span
        self.seen: dict[tuple[str, str], tuple[int, int, int]] = {}

    def __getstate__(self):
        return {"vocabulary": self.vocabulary, "quote_span": self.quote_span, "seen": {}}

    def __call__(self, lang: str, token: str | None) -> tuple[int, int, int]:
        """(symbol, symbol inside a quotation, quote mark: 1 opens, 2 closes, 3 either)."""
        key = (lang, token)
        if key not in self.seen:
            if len(self.seen) > 300_000:
                self.seen.clear()
            word = mend_word(token or "", lang)
            name = word if (lang, word) in self.vocabulary else _shape(word)
            opens, closes = (_DE_OPEN, _DE_CLOSE) if lang == "de" else (_OPEN, _CLOSE)
            mark = 1 if word in opens else 2 if word in closes else 3 if word in _TOGGLE else 0
            inside = "q" + name if _ENDERS.fullmatch(word) else name
            self.seen[key] = (_code(name), _code(inside), mark)
        return self.seen[key]

    def of(self, lang: str, tokens: pa.Array) -> np.ndarray:
        """Symbols of a text's tokens, with what stands inside quotations told apart."""
        coded = tokens.dictionary_encode()
        table = np.array([self(lang, t) for t in coded.dictionary.to_pylist()] + [self(lang, None)], dtype=np.int64).reshape(-1, 3)
        index = np.asarray(pa.compute.fill_null(coded.indices, len(table) - 1))
        symbols, marks = table[index, 0], table[index, 2]
        opened, toggled = -1, False
        spans = []
        for i in np.flatnonzero(marks):
            mark = marks[i]
            if opened >= 0 and toggled and i - opened > self.quote_span:
                opened = -1
            if mark == 1 and not toggled or opened < 0 and mark == 3:
                opened, toggled = i, mark == 3
            elif opened >= 0 and (mark == 2 and not toggled or mark == 3 and toggled):
                spans.append((opened, i))
                opened, toggled = -1, False
        for a, b in spans:
            symbols[a:b] = table[index[a:b], 1]
        return symbols


def _mix(key: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = (key ^ (key >> np.uint64(29))) * _P
        return key + symbol.astype(np.uint64)


def _lang_key(lang: str) -> int:
    return zlib.crc32(lang.encode())


def grams(lang: str, stream: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(order, key of the history, key of the n-gram) at every place of a merged stream."""
    n = len(stream)
    for order in range(1, ORDER + 1):
        key = np.full(n - ORDER + 1, _lang_key(lang), dtype=np.uint64)
        for k in range(order - 1, 0, -1):
            key = _mix(key, stream[ORDER - 1 - k : n - k])
        yield order, key, _mix(key, stream[ORDER - 1 :])


def merged(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The symbols with the boundary event inserted after every sentence."""
    at = np.flatnonzero(ends) + 1
    return np.concatenate([np.full(ORDER - 2, BEFORE), [S], np.insert(symbols, at, S)])


class Model:
    """Interpolated (Witten-Bell) n-gram model over words and boundary events."""

    def __init__(self, counts: dict[str, np.ndarray]):
        """counts: gram_order, history, gram and n of every n-gram of the learned texts."""
        self.orders = []
        for order in range(1, ORDER + 1):
            own = counts["gram_order"] == order
            gram, history, n = counts["gram"][own].view(np.uint64), counts["history"][own].view(np.uint64), counts["n"][own]
            by = np.argsort(gram)
            h, inverse = np.unique(history, return_inverse=True)
            total, kinds = np.bincount(inverse, n, len(h)), np.bincount(inverse, minlength=len(h))
            self.orders.append((gram[by], n[by].astype(np.float32), h, total.astype(np.float32), kinds.astype(np.float32)))
        gram, n, h, total, _ = self.orders[1]
        self.closed = h[(total >= 3) & (self._at(gram, _mix(h, np.full(len(h), S)), n) == 0)]

    @classmethod
    def of(cls, closed: np.ndarray, found: pa.Table | None = None) -> Model:
        """A model of the symbols after which no boundary stands and of some n-grams and
        histories: gram_order, key, n (as n-gram), total and kinds (as history)."""
        model = cls.__new__(cls)
        model.closed, model.orders = closed, []
        if found is not None:
            by = found.sort_by([("gram_order", "ascending")])
            own, key, n, total, kinds = (by.column(c).to_numpy() for c in ("gram_order", "key", "n", "total", "kinds"))
            for order in range(1, ORDER + 1):
                at = np.arange(*np.searchsorted(own, [order, order + 1]))
                at = at[np.argsort(key[at].view(np.uint64))]
                g, h = at[n[at] > 0], at[total[at] > 0]
                model.orders.append((key[g].view(np.uint64), n[g].astype(np.float32), key[h].view(np.uint64), total[h].astype(np.float32), kinds[h].astype(np.float32)))
        return model

    @staticmethod
    def _at(keys: np.ndarray, wanted: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The value of each wanted key, 0 for keys never seen."""
        if not len(keys):
            return np.zeros(len(wanted))
        i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[i] == wanted, values[i], 0.0)

    @staticmethod
    def keys(lang: str, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys of the history and of the n-gram that close each row of windows, by order."""
        for order in range(1, ORDER + 1):
            history = np.full(len(windows), _lang_key(lang), dtype=np.uint64)
            for k in range(order - 1, 0, -1):
                history = _mix(history, windows[:, ORDER - 1 - k])
            yield history, _mix(history, windows[:, -1])

    def probability(self, lang: str, windows: np.ndarray) -> np.ndarray:
        """P(last symbol | the others) of each row of windows (rows of ORDER symbols)."""
        p = np.full(len(windows), 1e-7)
        for (history, key), (gram, n, h, total, kinds) in zip(self.keys(lang, windows), self.orders):
            c, t = self._at(h, history, total), np.maximum(self._at(h, history, kinds), 1.0)
            p = (self._at(gram, key, n) + t * p) / (c + t)
        return p

    def may_end(self, lang: str, symbols: np.ndarray) -> np.ndarray:
        """Symbols after which a boundary was ever seen, or that were themselves hardly seen."""
        distinct, back = np.unique(symbols, return_inverse=True)
        history = _mix(np.full(len(distinct), _lang_key(lang), dtype=np.uint64), distinct)
        return (self._at(self.closed, history, np.ones(len(self.closed))) == 0)[back]


def places(model: Model, lang: str, texts: list[np.ndarray], starts: list[bool], ends: list[bool]) -> tuple:
    """Where some texts may hold boundaries, and what must be known of the model there:
    posterior of all symbols, places, first and last place of a text, words up to the
    next place, windows, and the nine windows of each place by number. Only places after
    which the model knows boundaries are open."""
    k = ORDER - 1
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    flat = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    posterior = np.zeros(len(flat))
    finish = np.cumsum(sizes)
    whole = np.asarray(ends, dtype=bool) & (sizes > 0)
    posterior[finish[whole] - 1] = 1.0
    text_of = np.repeat(np.arange(len(texts)), sizes)
    open_at = np.flatnonzero(model.may_end(lang, flat)) if len(flat) else np.zeros(0, np.int64)
    open_at = open_at[open_at < finish[text_of[open_at]] - 1]
    if not len(open_at):
        none = np.zeros(0, np.int64)
        return posterior, none, none, none, none, np.zeros((0, ORDER), np.int64), np.zeros((9, 0), np.int64)
    # k symbols of padding before each text and k + 1 after it
    place = np.arange(len(flat)) + k + text_of * (2 * k + 1)
    pad = np.full(len(flat) + len(texts) * (2 * k + 1), BEFORE, dtype=np.int64)
    pad[place] = flat
    first_pad = finish - sizes + np.arange(len(texts)) * (2 * k + 1)
    pad[first_pad[np.asarray(starts, dtype=bool)] + k - 1] = S
    pad[(first_pad + k + sizes)[np.asarray(ends, dtype=bool)]] = S
    at, own = place[open_at], text_of[open_at]
    m = len(at)
    first = np.concatenate([[True], own[1:] != own[:-1]])  # first open place of its text
    last = np.concatenate([first[1:], [True]])
    reach = np.where(last, finish[own] - 1 - open_at, np.concatenate([open_at[1:], [0]]) - open_at)
    s = np.full(m, S)
    rows = np.concatenate([
        # words j = 1..3 after the place, without and with the event before them
        *[np.stack([pad[at + j - 3], pad[at + j - 2], pad[at + j - 1], pad[at + j]], axis=1) for j in (1, 2, 3)],
        np.stack([pad[at - 1], pad[at], s, pad[at + 1]], axis=1),
        np.stack([pad[at], s, pad[at + 1], pad[at + 2]], axis=1),
        np.stack([s, pad[at + 1], pad[at + 2], pad[at + 3]], axis=1),
        # the event, and the event at the next open place when this one holds an event and is near
        np.stack([pad[at - 2], pad[at - 1], pad[at], s], axis=1),
        np.stack([pad[at], s, pad[at + 1], s], axis=1),
        np.stack([s, pad[at + 1], pad[at + 2], s], axis=1),
    ])
    key = np.zeros(len(rows), dtype=np.uint64)
    for j in range(ORDER):
        key = _mix(key, rows[:, j])
    _, one, back = np.unique(key, return_index=True, return_inverse=True)
    return posterior, open_at, first, last, reach, rows[one], back.reshape(9, m)


def boundaries(model: Model, lang: str, texts: list[np.ndarray], starts: list[bool], ends: list[bool]) -> np.ndarray:
    """Posterior of a boundary after each symbol of some texts (one after the other), by
    the forward-backward algorithm, run on all texts at once.

    Hidden events: after each symbol a boundary or none. The words between two open
    places give the same probability whatever the events, but for the ORDER-1 words after
    an event. starts and ends tell whether a text begins and ends where its document does."""
    posterior, open_at, first, last, reach, windows, back = places(model, lang, texts, starts, ends)
    m = len(open_at)
    if not m:
        return posterior
    logs = np.log(model.probability(lang, windows))[back]
    keep0 = sum(np.where(reach >= j + 1, logs[j], 0.0) for j in range(3))
    keep1 = sum(np.where(reach >= j + 1, logs[j + 3], 0.0) for j in range(3))
    event0, event1 = logs[6], logs[6].copy()  # event1: given an event at the place before
    for gap in (1, 2):
        near = np.flatnonzero(~last & (reach == gap))
        event1[near + 1] = logs[6 + gap][near]
    # place i of every text at once, the texts in order of their numbers of places
    begin = np.flatnonzero(first)
    counts = np.diff(np.concatenate([begin, [m]]))
    begin = begin[np.argsort(-counts, kind="stable")]
    active = len(counts) - np.searchsorted(np.sort(counts), np.arange(counts.max()), side="right")
    forward, backward = np.zeros((2, m)), np.zeros((2, m))
    forward[1, begin] = event0[begin]
    for i in range(1, len(active)):
        now = begin[: active[i]] + i
        a0, a1 = forward[0, now - 1] + keep0[now - 1], forward[1, now - 1] + keep1[now - 1]
        forward[0, now] = np.logaddexp(a0, a1)
        forward[1, now] = np.logaddexp(a0 + event0[now], a1 + event1[now])
    ending = np.flatnonzero(last)
    # the words after the last open place are all scored, with the text's end if it is known
    backward[0, ending], backward[1, ending] = keep0[ending], keep1[ending]
    for i in range(len(active) - 2, -1, -1):
        now = begin[: active[i + 1]] + i
        b0, b1 = backward[0, now + 1], backward[1, now + 1]
        backward[0, now] = keep0[now] + np.logaddexp(b0, event0[now + 1] + b1)
        backward[1, now] = keep1[now] + np.logaddexp(b0, event1[now + 1] + b1)
    total = forward + backward
    posterior[open_at] = 1 / (1 + np.exp(np.clip(total[0] - total[1], -500, 500)))
    return posterior


def _lay(symbols: Symbols):
    """Rows of a block, sorted, to one row per document in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, ["block", "doc_id"]):
            ids, sent, owned = (table.column(c).to_numpy() for c in ("id", "sent", "owned"))
            numbered = table.column("numbered").to_numpy()
            tokens = table.column("token").combine_chunks()
            starts = [*group_starts(table, ["block", "doc_id"]), table.num_rows]
            langs = table.column("lang").take(pa.array(starts[:-1])).to_pylist()
            out: dict[str, list] = {k: [] for k in ("lang", "numbered", "ids", "codes", "ends", "owned")}
            first: list[int] = []
            for a, b, lang in zip(starts[:-1], starts[1:], langs):
                fresh = np.concatenate([[True], ids[a + 1 : b] != ids[a : b - 1]])
                at = slice(a, b) if fresh.all() else np.flatnonzero(fresh) + a
                own = tokens.slice(a, b - a) if fresh.all() else tokens.take(pa.array(at))
                s = sent[at]
                if not owned[at].any():  # only the halo of a document of another block
                    continue
                first.append(a)
                out["lang"].append(lang or "")
                out["numbered"].append(bool(numbered[at].any()))
                out["ids"].append(ids[at])
                out["codes"].append(symbols.of(lang or "", own))
                out["ends"].append(np.concatenate([s[1:] != s[:-1], [True]]))
                out["owned"].append(owned[at])
            types = (pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays(
                [*[table.column(c).take(pa.array(first, pa.int64())).combine_chunks() for c in ("block", "doc_id")], *[pa.array(out[k], t) for k, t in zip(out, types)]],
                ["block", "doc_id", *out],
            )

    return run


LAID = "block bigint, doc_id bigint, lang string, numbered boolean, ids array<bigint>, codes array<bigint>, ends array<boolean>, owned array<boolean>"


COUNTED = ["gram_order", "history", "gram", "closes", "n"]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram counts of the documents with sentence numbers."""
    held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (_, order), parts in held.items():
            history = np.concatenate([h for h, _ in parts])
            gram, at, n = np.unique(np.concatenate([g for _, g in parts]), return_index=True, return_counts=True)
            history = history[at]
            closes = gram == _mix(history, np.full(len(n), S))
            columns = [np.full(len(n), order, np.int32), history.view(np.int64), gram.view(np.int64), closes, n]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], COUNTED)
        held.clear()

    for batch in batches:
        streams: dict[str, list[np.ndarray]] = {}
        for lang, codes, ends, owned, last in zip(*(batch.column(c) for c in ("lang", "codes", "ends", "owned", "last"))):
            codes, ends, owned = (x.values.to_numpy(zero_copy_only=False) for x in (codes, ends, owned))
            at = np.flatnonzero(owned)
            if len(at):
                ends = ends.copy()
                ends[-1] = last.as_py()
                streams.setdefault(lang.as_py(), []).append(merged(codes[at[0] : at[-1] + 1], ends[at[0] : at[-1] + 1]))
        for lang, parts in streams.items():
            # one long stream a batch: a text begins with its own padding, so its n-grams are its own
            for order, history, gram in grams(lang, np.concatenate(parts)):
                held.setdefault((lang, order), []).append((history, gram))
            size += sum(map(len, parts))
        if size > 1_000_000:
            yield from flush()
            size = 0
    yield from flush()


def _by_language(texts: pa.Table) -> Iterator[tuple]:
    """lang, doc_id, ids, codes, owned, first and last of the texts of each language."""
    texts = texts.combine_chunks()
    langs, docs = texts.column("lang").to_pylist(), texts.column("doc_id").to_numpy()
    column = {c: texts.column(c).chunk(0) for c in ("ids", "codes", "owned")}
    first, last = texts.column("first").to_pylist(), texts.column("last").to_pylist()
    for lang in sorted(set(langs)):
        rows = [i for i, g in enumerate(langs) if g == lang]
        lists = ([column[c][i].values.to_numpy(zero_copy_only=False) for i in rows] for c in ("ids", "codes", "owned"))
        yield lang, docs[rows], *lists, [first[i] for i in rows], [last[i] for i in rows]


def _ask(closed: np.ndarray):
    """The n-grams and histories that the texts of a part ask for."""
    model = Model.of(closed)

    def run(texts: pa.Table) -> pa.Table:
        held: list[list[np.ndarray]] = [[] for _ in range(ORDER)]
        for lang, _, _, codes, _, first, last in _by_language(texts):
            *_, windows, _ = places(model, lang, codes, first, last)
            for own, keys in zip(held, Model.keys(lang, windows)):
                own += keys
        keys = [np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64) for own in held]
        order = np.repeat(np.arange(1, ORDER + 1, dtype=np.int32), [len(k) for k in keys])
        part = np.full(len(order), texts.column("part")[0].as_py())
        return pa.table({"part": part, "gram_order": order, "key": np.concatenate(keys).view(np.int64)})

    return run


def _mark(closed: np.ndarray, threshold: float):
    """The boundaries of the texts of a part, by what is known of all that they asked for."""

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        model = Model.of(closed, found)
        out: list[list[np.ndarray]] = [[], [], []]
        for lang, docs, ids, codes, owned, first, last in _by_language(texts):
            p = boundaries(model, lang, codes, first, last)
            hit = (p >= threshold) & np.concatenate(owned)
            doc = np.repeat(docs, [len(x) for x in ids])
            for own, x in zip(out, (doc, np.concatenate(ids), p)):
                own.append(x[hit])
        return pa.table(dict(zip(("doc_id", "id", "posterior"), map(np.concatenate, out))))

    return run


def _sampled(rows: DataFrame, keys: list[str], totals: DataFrame, labelled: int) -> DataFrame:
    """The rows whose keys hash into the share of their language that makes about
    `labelled` tokens; all rows of a language with fewer."""
    share = totals.select("lang", (F.lit(float(labelled)) / F.col("total")).alias("_share"))
    return rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64(*keys), F.lit(1_000_000)) < F.col("_share") * 1_000_000).drop("_share")


def lay(corpus: DataFrame, labelled: int | None = None, quote_span: int = QUOTE_SPAN) -> DataFrame:
    """One row per document and block of consecutive ids, with the halo of the neighbouring
    blocks: block, doc_id, lang, ids, codes (symbols), ends, owned, first, last, useless.

    One exchange of the token rows, even by block; a document that holds a third of all
    rows spreads over as many blocks as it needs. What must be known of whole documents
    is exchanged as one small row per block and document, and comes back for documents
    of several blocks only."""
    rows = corpus.where(F.col("id").isNotNull() & F.col("doc_id").isNotNull())
    own = F.floor(F.col("id") / BLOCK).cast("bigint")
    words = rows.where(F.col("token").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "lang", "token", own.alias("block"))
    if labelled is not None:
        words = _sampled(words, ["block", "doc_id"], words.groupBy("lang").agg(F.count("*").alias("total")), labelled)
    counted = words.groupBy("lang", "token").agg(F.count("*").alias("n"))
    least = counted.groupBy("lang").agg((F.greatest(F.sum("n"), F.lit(WORD_TOKENS)) * WORD_COUNT).alias("_least"))
    kept = counted.join(F.broadcast(least), "lang").where(F.col("n") * WORD_TOKENS >= F.col("_least")).select("lang", "token").collect()
    symbols = Symbols({(r["lang"], r["token"]) for r in kept}, quote_span)
    near = F.when((F.col("id") % BLOCK < HALO) & (own > 0), F.array(own, own - 1)).when(F.col("id") % BLOCK >= BLOCK - HALO, F.array(own, own + 1)).otherwise(F.array(own))
    spread = rows.select(
        F.explode(near).alias("block"), "doc_id", "id", own.alias("_own"), "lang", "token",
        F.xxhash64("filename", "sent_id").alias("sent"), (F.coalesce("sent_id", F.lit(0)) > 0).alias("numbered"),
    ).select("block", "doc_id", "id", (F.col("_own") == F.col("block")).alias("owned"), "lang", "token", "sent", "numbered")
    laid = materialize(spread.repartition("block").sortWithinPartitions("block", "doc_id", "id").mapInArrow(_lay(symbols), LAID), "sentences-laid")
    low, high = F.array_min("ids"), F.array_max("ids")
    several = (
        laid.select("doc_id", "numbered", low.alias("_low"), high.alias("_high"))
        .groupBy("doc_id")
        .agg(F.bool_or("numbered").alias("_numbered"), F.min("_low").alias("_first"), F.max("_high").alias("_last"), F.count("*").alias("_n"))
        .where(F.col("_n") > 1)
        .drop("_n")
    )
    return laid.join(several, "doc_id", "left").select(
        *laid.columns,
        (~F.coalesce("_numbered", "numbered")).alias("useless"),
        F.coalesce(low == F.col("_first"), F.lit(True)).alias("first"),
        F.coalesce(high == F.col("_last"), F.lit(True)).alias("last"),
    )


def counts(laid: DataFrame, labelled: int | None = None) -> DataFrame:
    """All n-grams of the documents with sentence numbers: gram_order, history, gram (keys),
    closes (its last symbol is the boundary event), n."""
    own = laid.where(~F.col("useless"))
    if labelled is not None:
        own = _sampled(own, ["block", "doc_id"], own.groupBy("lang").agg(F.sum(F.size("codes")).alias("total")), labelled)
    counted = own.mapInArrow(_count, "gram_order int, history bigint, gram bigint, closes boolean, n bigint")
    return counted.groupBy(*COUNTED[:-1]).agg(F.sum("n").alias("n"))


def fit(laid: DataFrame, labelled: int | None = None) -> Model:
    """The whole n-gram model in the driver's memory, which must hold it; sentence_ends
    brings to each part of the texts only what the part asks for."""
    counted = counts(laid, labelled).toArrow()
    return Model({c: counted.column(c).to_numpy() for c in counted.column_names if c != "closes"})


def asked(counted: DataFrame, texts: DataFrame, closed: np.ndarray) -> DataFrame:
    """What is known of the n-grams and histories that each part of the texts asks for:
    part, gram_order, key, n (as n-gram), total and kinds (as history)."""
    both = counted.select("gram_order", F.expr("stack(2, gram, n, 0L, 0L, history, 0L, n, 1L) AS (key, n, total, kinds)"))
    known = both.groupBy("gram_order", "key").agg(*[F.sum(c).alias(c) for c in ("n", "total", "kinds")])
    return texts.groupBy("part").applyInArrow(_ask(closed), "part bigint, gram_order int, key bigint").join(known, ["gram_order", "key"])


def sentence_ends(corpus: DataFrame, *, threshold: float = 0.5, labelled: int | None = None, quote_span: int = QUOTE_SPAN) -> DataFrame:
    """The last token of each sentence of every document without usable sentence numbers.

    Method: a hidden-event n-gram language model over words and boundary events, learned
    from documents with sentence numbers; forward-backward posteriors decide after each
    token whether a boundary stands there. Rare words enter by their shape, wrongly
    decoded ones as what they were, end marks inside quotations as symbols of their own,
    so that quotations keep together. Unpunctuated scripts need nothing else: the model
    knows after which words sentences close.

    It is learned from all of them: words are counted over all tokens and n-grams over all
    documents with sentence numbers. The counts stay distributed; each part of the texts
    (PART blocks) asks for the n-grams at its own open places and gets those by a join. On
    the driver are only the frequent words (by their rate at most 4,000 a language) and
    one number of each symbol after which no boundary stands. Only a caller that sets
    labelled learns from less: about so many tokens of each language, chosen by a hash of
    document and block. Every document without numbers is treated in whole. quote_span:
    tokens after which an open straight quotation mark counts as unclosed. A quotation
    across the border of two blocks is read whole if it is shorter than HALO tokens.

    Columns: doc_id, id, posterior. A document's last token always ends a sentence.
    Documents all of whose rows have sent_id 0 or null are treated, others give no row.
    Repeated rows (same id) count once; rows with null id or doc_id are left out; a null
    token is a symbol of its own; documents with null lang have symbols by shape and a
    model of their own. Without any document to learn from, only last tokens and unseen
    words are looked at."""
    laid = lay(corpus, labelled, quote_span)
    counted = materialize(counts(laid, labelled), "sentences-counts")
    before = counted.where(F.col("gram_order") == 2).groupBy("history").agg(F.sum("n").alias("n"), F.bool_or("closes").alias("closes"))
    shut = before.where((F.col("n") >= 3) & ~F.col("closes")).select("history").toArrow()
    closed = np.sort(shut.column("history").to_numpy().view(np.uint64))
    texts = laid.where("useless").select(F.floor(F.col("block") / PART).cast("bigint").alias("part"), "doc_id", "lang", "ids", "codes", "owned", "first", "last")
    found = asked(counted, texts, closed)
    return texts.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(_mark(closed, threshold), "doc_id bigint, id bigint, posterior double")


def sentence_units(corpus: DataFrame, **options: float) -> DataFrame:
    """Sentences of the documents without sentence numbers: doc_id, sent_no (from 1),
    first_id, last_id. Ids of a document are taken as one run."""
    from pyspark.sql import Window

    ends = materialize(sentence_ends(corpus, **options).select("doc_id", "id"), "sentences-ends")
    own = F.floor(F.col("id") / BLOCK).cast("bigint")
    # numbered in two levels, so that a very long document is not sorted in one task
    sizes = ends.groupBy("doc_id", own.alias("block")).agg(F.count("*").alias("_n"), F.max("id").alias("_high"))
    before = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("doc_id", "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"), F.max("_high").over(before).alias("_last"))
    inner = Window.partitionBy("doc_id", "block").orderBy("id")
    first = corpus.where(F.col("id").isNotNull()).groupBy("doc_id").agg(F.min("id").alias("_first"))
    return (
        ends.withColumn("block", own)
        .join(shifts, ["doc_id", "block"])
        .join(first, "doc_id")
        .select(
            "doc_id",
            (F.col("_shift") + F.row_number().over(inner)).alias("sent_no"),
            F.coalesce(F.lag("id").over(inner) + 1, F.col("_last") + 1, F.col("_first")).alias("first_id"),
            F.col("id").alias("last_id"),
        )
    )
