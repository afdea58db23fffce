"""Problem 1: text that was decoded with the wrong character encoding."""

from __future__ import annotations

import codecs
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.languages import code_of
from tokenloom.session import materialize, spread

#: (encoding the text was written in, encoding it was read in). Fixed values.
STEPS = (
    ("utf-8", "cp1252"),
    ("utf-8", "latin-1"),
    ("utf-8", "mac_roman"),
    ("utf-8", "cp1251"),
    ("utf-8", "cp1250"),
    ("utf-8", "cp437"),
    ("utf-8", "cp932"),
    ("utf-8", "gb18030"),
    ("euc_jp", "cp932"),
    ("cp932", "cp1252"),
    ("euc_jp", "latin-1"),
    ("gb18030", "cp1252"),
    ("big5", "latin-1"),
    ("cp1256", "cp1252"),
    ("cp874", "cp1252"),
    ("cp1251", "cp1252"),
)
#: Chains tried on the words of a language only; the others on all. Fixed values.
ONLY = {
    ("euc_jp", "cp932"): ("ja",), ("cp932", "cp1252"): ("ja",), ("euc_jp", "latin-1"): ("ja",), ("utf-8", "cp932"): ("ja",),
    ("gb18030", "cp1252"): ("zh",), ("big5", "latin-1"): ("zh",), ("utf-8", "gb18030"): ("zh",),
    ("cp1256", "cp1252"): ("ar",), ("cp874", "cp1252"): ("th",), ("cp1251", "cp1252"): ("ru",),
}
#: Scripts in which words of a language are written, next to Latin. Fixed values.
SCRIPTS = {
    "ja": r"\p{Han}\p{Hiragana}\p{Katakana}ー", "zh": r"\p{Han}", "ar": r"\p{Arabic}", "hi": r"\p{Devanagari}", "th": r"\p{Thai}", "ru": r"\p{Cyrillic}",
}

#: What may have happened to a word: one wrong step, or the commonest one twice.
CHAINS = (*((step,) for step in STEPS), (STEPS[0], STEPS[0]))

#: Buckets of the hashed byte bigrams.
BUCKETS = 8192
#: Weight of the outcome's likelihood against that of the text as it stands. Fixed value.
QUALITY = 3.0
#: What it costs (log likelihood) to enter a damaged stretch inside a run. Fixed value.
ENTER = 10.0
#: Labels beside the chains: not damaged, and damaged beyond any way back.
CLEAN, GONE = "clean", "lost"
LOST = "�"
NON_ASCII = r"[^\x00-\x7F]"
MODEL = "label string, bucket int, n bigint"

_CONTROL = regex.compile(r"[\x80-\x9f\p{Co}\p{Cn}�]")
_TAIL = "".join(chr(i) for i in range(0x21, 0x7F) if not chr(i).isalnum())
_TABLES: dict[str, dict[str, int]] = {}


def _table(encoding: str) -> dict[str, int] | None:
    """Character to byte of a one-byte encoding; unassigned bytes are read as controls."""
    if encoding not in _TABLES:
        table = {}
        if encoding in ("cp1252", "latin-1", "mac_roman", "cp1251", "cp1250", "cp437"):
            for b in range(256):
                table[bytes([b]).decode(encoding, "ignore") or chr(b)] = b
        _TABLES[encoding] = table
    return _TABLES[encoding] or None


def _misread(raw: bytes, encoding: str) -> str:
    if _table(encoding) is None:
        return raw.decode(encoding, "replace")
    return "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in raw)


def label_of(chain: tuple) -> str:
    return " ".join(f"{a}>{b}" for a, b in chain)


def garble(text: str, chain: tuple) -> str | None:
    """The text as the chain damages it; null where it cannot or does not."""
    out = text
    for written, read in chain:
        try:
            out = _misread(out.encode(written), read)
        except UnicodeEncodeError:
            return None
    return None if out == text else out


def invert(text: str, chain: tuple) -> str | None:
    """The original of a damaged text, if every step back is strictly possible."""
    out = text
    for written, read in reversed(chain):
        table = _table(read)
        try:
            raw = out.encode(read) if table is None else bytes([table[c] for c in out])
            back = raw.decode(written)
        except (KeyError, UnicodeError):
            return None
        if back == out:
            return None
        out = back
    return None if _CONTROL.search(out) else out


def _may_start(text: str, chain: tuple) -> bool:
    """Whether a damaged character of the chain can begin with these one or two."""
    written, read = chain[-1]
    table = _table(read)
    raw = b""
    for c in text:
        try:
            raw += c.encode(read) if table is None else bytes([table[c]])
        except (KeyError, UnicodeError):
            break
    if not raw or raw[0] < 128:
        return False
    try:
        first = codecs.getincrementaldecoder(written)().decode(raw)
    except UnicodeDecodeError as e:
        return e.start > 0
    return bool(first) or len(raw) > 1 or len(text) > 1


def _buckets(text: str, lang: str | None) -> list[int]:
    """Hashed byte bigrams, the language, and a last one that every word has."""
    raw = b"\x02" + text.encode("utf-8", "surrogatepass") + b"\x03"
    out = [zlib.crc32(raw[i : i + 2]) % BUCKETS for i in range(len(raw) - 1) if raw[i] > 127 or raw[i + 1] > 127]
    return out + [zlib.crc32(b"lang:" + (lang or "").encode()) % BUCKETS, BUCKETS]


def _labels(lang: str | None) -> list[tuple]:
    return [c for c in CHAINS if c[0] not in ONLY or lang in ONLY[c[0]]]


def plausible(text: str, lang: str | None) -> bool:
    """Whether a restored word may be a word of its language."""
    if _CONTROL.search(text):
        return False
    own = SCRIPTS.get(lang or "", "")
    if own and not text.isascii() and regex.fullmatch(r"[\p{Latin}\p{M}\p{S}\p{P}]*", text) and not regex.search(r"[A-Za-z]|^[\p{P}\p{M}]*$", text):
        return False
    # letters of no other script than Latin and the language's own, and not both in one word
    letters = regex.sub(r"[^\p{L}\p{M}]", "", text)
    if regex.search(rf"[^\p{{Latin}}\p{{M}}{own}ªº]", letters):
        return lang not in SCRIPTS and not regex.search(r"\p{Latin}", letters) and lang is None
    return not (own and regex.search(rf"[{own}]", letters) and regex.search(r"\p{Latin}", letters))


def _seems_clean(text: str, lang: str | None) -> bool:
    return not _CONTROL.search(text) and not any((o := invert(text, c)) and plausible(o, lang) for c in _labels(lang))


def _gone(word: str) -> Iterator[str]:
    """The word as it looks when bytes of it are lost: characters replaced, bytes that the
    wrong encoding has no character for, half of a character left."""
    yield regex.sub(NON_ASCII, LOST, word)
    yield word.encode("utf-8", "surrogatepass").decode("cp1252", "replace")
    yield regex.sub(r"[\xc2-\xf4](?=[\x80-\xbf])", "", garble(word, (STEPS[1],)) or "")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bigram counts per label: clean words as they stand, garbled along every chain, and
    with bytes lost."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, word in zip(batch.column("lang").to_pylist(), batch.column("word").to_pylist()):
            if not _seems_clean(word, lang):
                continue
            np.add.at(counts.setdefault(CLEAN, np.zeros(BUCKETS + 1, np.int64)), _buckets(word, lang), 1)
            for chain in _labels(lang):
                if bad := garble(word, chain):
                    np.add.at(counts.setdefault(GONE if LOST in bad else label_of(chain), np.zeros(BUCKETS + 1, np.int64)), _buckets(bad, lang), 1)
            for bad in _gone(word):
                if _CONTROL.search(bad):
                    np.add.at(counts.setdefault(GONE, np.zeros(BUCKETS + 1, np.int64)), _buckets(bad, lang), 1)
    for label, n in counts.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([label] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], ["label", "bucket", "n"])


def fit(words: DataFrame) -> dict[str, np.ndarray]:
    """Log weights of the multinomial classifier, one vector per label: BUCKETS of them for
    the bigrams, a last one for how frequent the label is.

    words(lang, word): all distinct words with a character beyond ASCII, spread over as
    many tasks as the session shuffles to. The model's size is fixed: BUCKETS + 1 numbers for
    each of the labels, whatever the corpus."""
    spread = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = words.repartition(spread, "word").mapInArrow(_count, MODEL).groupBy("label", "bucket").agg(F.sum("n").alias("n")).collect()
    counts: dict[str, np.ndarray] = {}
    for r in rows:
        counts.setdefault(r["label"], np.zeros(BUCKETS + 1))[r["bucket"]] = r["n"]
    return {label: np.append(np.log((n[:-1] + 0.02) / (n[:-1].sum() + 0.02 * BUCKETS)), np.log(n[-1])) for label, n in counts.items()}


class Classifier:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights
        self.seen: dict[tuple[str | None, str], tuple[str, str | None]] = {}

        self.starts: dict[tuple[str | None, str], list[tuple]] = {}
        self.pairs: dict[str, np.ndarray] = {}
        self.like: dict[str, float] = {}

    def __getstate__(self):
        return {"weights": {k: v.astype(np.float32) for k, v in self.weights.items()}, "seen": {}, "starts": {}, "pairs": {}, "like": {}}

    def __call__(self, word: str, lang: str | None) -> tuple[str | None, str | None]:
        """(chains, original): ('', None) for a clean word; original is null where it is lost.

        The chains more likely than clean are taken in order of their likelihood; the
        first that leads strictly back to a word of the language is the prediction. A
        word for which there is none is lost if that label is likelier than clean and
        the word holds what no text has: replacement or control characters."""
        key = (lang, word)
        if key not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[key] = self._predict(word, lang)
        return self.seen[key]

    def _predict(self, word: str, lang: str | None) -> tuple[str, str | None]:
        at = _buckets(word, lang)
        score = {label: float(w[at].sum()) for label, w in self.weights.items()}
        bar = score.get(CLEAN, -np.inf)
        likely = [c for c in _labels(lang) if score.get(label_of(c), -np.inf) > bar]
        for chain in sorted(likely, key=lambda c: -score[label_of(c)]):
            out = invert(word, chain)
            if out is not None and plausible(out, lang):
                return label_of(chain), out
        if score.get(GONE, np.inf) > bar and _CONTROL.search(unicodedata.normalize("NFC", word)):
            return GONE, None
        return "", None

    def _units(self, text: str, at: int, lang: str | None) -> Iterator[tuple[str, int, str]]:
        """(chain, end, original character): the damaged characters that may begin here."""
        key = (lang, text[at : at + 2])
        if key not in self.starts:
            if len(self.starts) > 200_000:
                self.starts.clear()
            known = [c for c in _labels(lang) if label_of(c) in self.weights]
            self.starts[key] = [c for c in known if _may_start(key[1], c)]
        for chain in self.starts[key]:
            for end in range(at + 1, min(len(text), at + 4 ** len(chain) + 2) + 1):
                out = invert(text[at:end], chain)
                if out is not None:
                    if not out.isascii() and (plausible(out, lang) or regex.fullmatch(r"[\u3000-\u303f\uff00-\uffef]+", out)):
                        yield label_of(chain), end, out
                    break

    def _scores(self, label: str, big: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log likelihood under a label of the text before each character."""
        if label not in self.pairs:
            buckets = np.fromiter((zlib.crc32(bytes(divmod(i, 256))) % BUCKETS for i in range(1 << 16)), dtype=np.int64, count=1 << 16)
            own = np.asarray(self.weights[label], dtype=np.float64)[buckets]
            plain = np.arange(1 << 16)
            own[(plain >> 8 < 128) & (plain & 255 < 128)] = 0.0
            self.pairs[label] = own
        return np.concatenate([[0.0], np.cumsum(self.pairs[label][big])])[ends]

    def _quality(self, char: str) -> float:
        """How like clean characters one is: the mean log likelihood of its bigrams."""
        if char not in self.like:
            if len(self.like) > 200_000:
                self.like.clear()
            raw = char.encode("utf-8", "surrogatepass")
            at = [zlib.crc32(raw[i : i + 2]) % BUCKETS for i in range(len(raw) - 1)]
            self.like[char] = float(self.weights[CLEAN][at].mean()) if at else 0.0
        return self.like[char]

    def stretches(self, run: str, lang: str | None) -> list[tuple[str, str | None, str | None]]:
        """The run cut into clean and damaged stretches: (text, chain, original), with
        (text, None, None) for a clean one.

        The likeliest path through the run, each character clean or part of a damaged
        character that a chain leads strictly back; likelihoods are those of the
        classifier, of the text as it stands and of the outcome, and entering a damaged
        stretch costs ENTER."""
        units = {i: found for i, c in enumerate(run) if not c.isascii() and (found := list(self._units(run, i, lang)))}
        if not units or CLEAN not in self.weights:
            return [(run, None, None)]
        sizes = [len(c.encode("utf-8", "surrogatepass")) for c in run]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        raw = np.frombuffer(b"\x02" + run.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
        big = raw[:-1] * 256 + raw[1:]
        labels = {CLEAN, *(label for found in units.values() for label, _, _ in found)}
        score = {label: self._scores(label, big, ends).tolist() for label in labels}
        # per place: label to (likelihood, place before, label before, restored text)
        best: list[dict[str, tuple]] = [{} for _ in range(len(run) + 1)]
        best[0][CLEAN] = (0.0, 0, CLEAN, "")
        for i, c in enumerate(run):
            here = best[i]
            if not here:
                continue
            top = max(here, key=lambda label: here[label][0])

            def reach(end, label, value, before, out):
                value += score[label][end] - score[label][i] + QUALITY * self._quality(out)
                if label not in best[end] or value > best[end][label][0]:
                    best[end][label] = (value, i, before, out)

            reach(i + 1, CLEAN, here[top][0], top, c)
            if c.isascii():
                for label in here:
                    if label != CLEAN:
                        reach(i + 1, label, here[label][0], label, c)
            for label, end, out in units.get(i, ()):
                reach(end, label, here[top][0] - ENTER, top, out)
                if label in here and here[label][0] > here[top][0] - ENTER:
                    reach(end, label, here[label][0], label, out)
        at, steps = len(run), []
        label = max(best[at], key=lambda label: best[at][label][0])
        while at:
            _, before, previous, out = best[at][label]
            steps.append((before, at, label, out))
            at, label = before, previous
        out: list[tuple[str, str | None, str | None]] = []
        for same, group in groupby(reversed(steps), key=lambda step: step[2]):
            group = list(group)
            text, original = run[group[0][0] : group[-1][1]], "".join(step[3] for step in group)
            # a stretch counts only if the classifier takes it for damaged by itself too,
            # and dashes, dots and quotation marks alone are written so in clean texts
            sure = same != CLEAN and not regex.fullmatch("[–—…“”‘’]+", text) and self(text, lang)[1] is not None
            out.append((text, same, original) if sure else (text, None, None))
        # letters with marks and without, beside clean Latin letters, are a Latin word
        for k, (text, chain, original) in enumerate(out):
            if chain and regex.search(r"[A-Za-z]", text) and regex.fullmatch(r"\p{Latin}+", text):
                left = out[k - 1][0][-1:] if k and not out[k - 1][1] else ""
                right = out[k + 1][0][:1] if k + 1 < len(out) and not out[k + 1][1] else ""
                if regex.search(r"\p{Latin}", left + right + original):
                    out[k] = (text, None, None)
        return out

    def mend(self, run: str, lang: str | None) -> tuple[str, int, int]:
        """(text, damaged stretches, restored ones) of a run without white space: restored
        as one word if a chain fits all of it, else stretch by stretch."""
        tail = len(run) - len(run.rstrip(_TAIL))
        word = run[: len(run) - tail]
        chain, original = self(word, lang)
        if original is not None:
            return original + run[len(word) :], 1, 1
        damaged = restored = 0
        parts = []
        for text, chain, back in self.stretches(run, lang):
            if chain:
                damaged, restored = damaged + 1, restored + 1
            elif self(text, lang)[0] == GONE:
                damaged += 1
            parts.append(text if back is None else back)
        return "".join(parts), damaged, restored



def guesses(lost: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, token, guess) of the lost tokens that agree with exactly one clean word of
    their language in all characters but those beyond ASCII."""
    blurred = F.regexp_replace("word", NON_ASCII, LOST)
    return (
        words.where(~F.col("word").contains(LOST))
        .select("lang", "word", blurred.alias("token"))
        .join(lost, ["lang", "token"], "left_semi")
        .groupBy("lang", "token")
        .agg(F.max("word").alias("guess"), F.count("*").alias("n"))
        .where(F.col("n") == 1)
        .drop("n")
    )


def words_of(corpus: DataFrame) -> DataFrame:
    return corpus.where(F.col("token").rlike(NON_ASCII)).select("lang", F.col("token").alias("word")).distinct()


def damaged_tokens(corpus: DataFrame, model: Classifier | None = None) -> DataFrame:
    """Token rows whose token was decoded wrongly, with the original where it can be had.

    Method: a multinomial classifier on hashed bigrams of the UTF-8 bytes, fitted on all
    distinct clean words of the corpus and on the same words garbled along each known
    chain of encodings or with bytes lost, predicts the chain (one wrong decoding or
    two); the chain is inverted, every step strictly, and the outcome must be written in
    the language's script, else the next likely chain is tried. Tokens predicted as
    'lost' hold the replacement character or control characters; for
    those the one clean word of the same language that agrees in all other characters is
    taken where there is exactly one (how = 'vocabulary').

    Columns: id, token, original (null if lost), token_low (the original in lower case),
    lemma (restored where it was made from the token, else as stored), chain, how
    ('inverted', 'vocabulary' or null). Once per id. Rows with null id or token, and
    tokens of ASCII only, are never damaged. An empty table gives an empty result."""
    model = model or Classifier(fit(words_of(corpus)))
    rows = spread(corpus.where(F.col("id").isNotNull() & F.col("token").rlike(NON_ASCII)).select("id", "lang", "token", "lemma"))
    schema = "id bigint, lang string, token string, lemma string, chain string, original string"

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [model(w, g) for w, g in zip(batch.column("token").to_pylist(), batch.column("lang").to_pylist())]
            hit = pa.array([bool(c) for c, _ in marks], pa.bool_())
            out = batch.append_column("chain", pa.array([c for c, _ in marks], pa.string()))
            yield out.append_column("original", pa.array([o for _, o in marks], pa.string())).filter(hit)

    found = materialize(rows.mapInArrow(mark, schema).distinct(), "encoding-found")
    lost = found.where(F.col("chain") == GONE).select("lang", "token").distinct()
    damaged = found.select("lang", F.col("token").alias("word")).distinct()
    vocabulary = guesses(lost, words_of(corpus).join(lost.select("lang").distinct(), "lang", "left_semi").join(damaged, ["lang", "word"], "left_anti"))
    joined = found.join(vocabulary, ["lang", "token"], "left")
    original = F.coalesce("original", "guess")
    return joined.select(
        "id",
        "token",
        original.alias("original"),
        F.lower(original).alias("token_low"),
        F.when(F.col("lemma") == F.col("token"), original)
        .when(F.lower("lemma") == F.lower("token"), F.lower(original))
        .otherwise(F.col("lemma"))
        .alias("lemma"),
        "chain",
        F.when(F.col("original").isNotNull(), "inverted").when(F.col("guess").isNotNull(), "vocabulary").alias("how"),
    )


def repaired_documents(documents: DataFrame, corpus: DataFrame) -> DataFrame:
    """Texts with damaged words, repaired word by word: doc_id, n_damaged, n_restored
    (stretches), text. Words are cut at ASCII white space only (a no-break space may be
    part of the damage). A word that no chain fits as a whole, as in scripts without
    spaces, is cut into its clean and damaged stretches, and each of these is restored by
    itself. Words with lost characters are restored like tokens are: by the one clean
    word of the corpus, of the same language, that agrees in all other characters.

    The model is fitted on the corpus. Texts without damage, null and blank texts give no
    row; a language that is null or unknown is treated as Latin-written."""
    words = materialize(words_of(corpus), "encoding-words")
    model = Classifier(fit(words))
    rows = spread(documents.where(F.col("text").rlike(NON_ASCII)).select("doc_id", "lang", "text"))

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("doc_id", "lang", "n_damaged", "n_restored", "parts", "lost")}
            for doc, lang, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "text"))):
                code = code_of(lang)
                parts, damaged, restored, lost = regex.split(r"([ \t\r\n]+)", text), 0, 0, []
                # white space and clean words go together, words with lost characters stand alone
                joined = [""]
                for part in parts:
                    if not part.isascii():
                        part, bad, good = model.mend(part, code)
                        damaged, restored = damaged + bad, restored + good
                        if LOST in part:
                            core = part.strip(_TAIL + "“”„«»‘’‹›")
                            left, right = part.split(core, 1) if core else (part, "")
                            joined[-1] += left
                            lost.append(core)
                            joined += [core, right]
                            continue
                    joined[-1] += part
                if damaged:
                    for k, v in zip(out, (doc, code, damaged, restored, joined, sorted(set(lost)))):
                        out[k].append(v)
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(out, types)], list(out))

    schema = "doc_id bigint, lang string, n_damaged bigint, n_restored bigint, parts array<string>, lost array<string>"
    mended = materialize(rows.mapInArrow(mend, schema).withColumn("_row", F.monotonically_increasing_id()), "encoding-documents")
    lost = mended.select("_row", "lang", F.explode("lost").alias("token"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model(w, g)[0] == "" for w, g in zip(batch.column("word").to_pylist(), batch.column("lang").to_pylist())], pa.bool_()))

    known = words.join(lost.select("lang").distinct(), "lang", "left_semi").mapInArrow(clean, words.schema)
    found = lost.join(guesses(lost.select("lang", "token").distinct(), known), ["lang", "token"])
    by_row = found.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("token", "guess"))).alias("_guess"))
    # every second part is a word with lost characters
    said = F.transform("parts", lambda part, i: F.when(i % 2 == 1, F.coalesce(F.try_element_at("_guess", part), part)).otherwise(part))
    guessed = F.size(F.filter("parts", lambda part, i: (i % 2 == 1) & F.try_element_at("_guess", part).isNotNull()))
    none = F.col("_guess").isNull()
    return mended.join(by_row, "_row", "left").select(
        "doc_id",
        "n_damaged",
        F.when(none, F.col("n_restored")).otherwise(F.col("n_restored") + guessed).alias("n_restored"),
        F.array_join(F.when(none, F.col("parts")).otherwise(said), "").alias("text"),
    )


def mend_word(word: str, lang: str | None) -> str:
    """The likely original of a word without any fitted model: the first chain that
    inverts strictly into the language's script; the word itself where none does."""
    if word.isascii():
        return word
    for chain in (CHAINS[-1], *CHAINS[:-1]):
        if (chain[0] not in ONLY or lang in ONLY[chain[0]]) and (out := invert(word, chain)) is not None and plausible(out, lang):
            return out
    return word
