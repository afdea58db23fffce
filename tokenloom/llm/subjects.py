"""Problem 4: subject areas of documents."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.encoding import mend_word
from tokenloom.llm.languages import code_of
from tokenloom.session import materialize

GENERAL = "General"
#: Final particles that close Thai sentences. Fixed values.
THAI_ENDS = {"ค่ะ", "คะ", "ครับ", "นะคะ", "นะครับ"}

#: Buckets of the hashed terms, dimensions of the embedding, passes of subspace iteration
#: and of centroid refinement.
BUCKETS, DIMENSIONS, SVD_PASSES, REFINEMENTS = 1 << 16, 16, 3, 3
#: Cosine from which a document helps to refine a centroid, and from which a sentence
#: is about a subject; share of sentences from which a document is.
REFINE_COSINE, SENTENCE_COSINE, SENTENCE_SHARE = 0.4, 0.5, 0.25
#: Weight of the language against all languages when one must be told by its terms.
OWN = 0.9

_MARKUP = regex.compile(r"<[^<>]*>|&[a-z]+;")
_END = re.compile(r"[.!?…؟]+[\"'”’»)\]]*\s+|[。！？｡।॥]+[」』”’»）)]*\s*|\n\s*")
_ASCII_WORD = re.compile(r"[a-z]+")
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_RUN = regex.compile(r"[\p{Han}\p{Katakana}ー]+")
_ODD = regex.compile(r"[\x80-ɏˆ˜Ѐ-ӿ‘-⋿｡-ﾟ]")


def script_of(text: str) -> str | None:
    """The language that a script alone tells."""
    for pattern, lang in ((r"[\p{Hiragana}\p{Katakana}]", "ja"), (r"\p{Han}", "zh"), (r"\p{Thai}", "th"), (r"\p{Devanagari}", "hi"), (r"\p{Arabic}", "ar")):
        if regex.search(pattern, text):
            return lang
    return None


def sentences_of(text: str) -> list[str]:
    """Parts of a text by its marks and line ends; a mark before a small letter ends nothing."""
    out, start = [], 0
    for m in _END.finditer(text):
        if text[m.start()] in ".!?…؟" and text[m.end() : m.end() + 1].islower():
            continue
        out.append(text[start : m.end()])
        start = m.end()
    out.append(text[start:])
    return out


class Terms:
    """Sentences of a text as lists of terms: lower-cased words; in Chinese and Japanese
    the pairs of neighbours in each run of Han characters and katakana. Wrongly decoded
    words are mended."""

    def __init__(self) -> None:
        self.mended: dict[tuple[str, str | None], str] = {}

    def _mend(self, text: str, lang: str | None) -> str:
        if text.isascii() or not _ODD.search(text):
            return text
        parts = regex.split(r"([ \t\r\n]+)", text)
        for i in range(0, len(parts), 2):
            word = parts[i]
            if word and not word.isascii() and _ODD.search(word):
                key = (word, lang)
                if key not in self.mended:
                    if len(self.mended) > 100_000:
                        self.mended.clear()
                    core = word.rstrip(".,;:!?)\"'")
                    self.mended[key] = mend_word(core, lang) + word[len(core) :]
                parts[i] = self.mended[key]
        return "".join(parts)

    def __call__(self, text: str, lang: str | None) -> list[list[str]]:
        text = _MARKUP.sub(" ", self._mend(text, lang))
        out = []
        for part in sentences_of(text):
            if part.isascii() and lang not in ("ja", "zh", "th"):
                if words := _ASCII_WORD.findall(part.lower()):
                    out.append(words)
                continue
            if not _WORD.search(part):
                continue
            if lang in ("ja", "zh"):
                out.append([run[i : i + 2] for run in _RUN.findall(part) for i in range(max(1, len(run) - 1))])
            elif lang == "th":
                sentence: list[str] = []
                for word in part.split():
                    sentence.append(word.lower())
                    if word in THAI_ENDS:
                        out.append(sentence)
                        sentence = []
                if sentence:
                    out.append(sentence)
            else:
                out.append(_WORD.findall(part.lower()))
        return out


def bucket_of(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % BUCKETS


CUT = "doc_id bigint, lang string, label string, n_sentences int, sentence array<int>, term array<int>"
ENCODED = CUT + ", distinct array<int>, weight array<float>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to sentences of hashed terms."""
    terms, buckets = Terms(), {}
    for batch in batches:
        langs, flat, places, sizes = [], [], [], []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            code = code_of(lang) or script_of(text)
            found = terms(text, code)
            own = []
            for sentence in found:
                for word in sentence:
                    if word not in buckets:
                        if len(buckets) > 500_000:
                            buckets.clear()
                        buckets[word] = bucket_of(word)
                    own.append(buckets[word])
            langs.append(code)
            flat.append(np.array(own, dtype=np.int32))
            places.append(np.repeat(np.arange(len(found), dtype=np.int32), [len(s) for s in found]))
            sizes.append(len(found))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(langs, pa.string()), batch.column("label"), pa.array(sizes, pa.int32()), pa.array(places, pa.list_(pa.int32())), pa.array(flat, pa.list_(pa.int32()))],
            ["doc_id", "lang", "label", "n_sentences", "sentence", "term"],
        )


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and the row of each value."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)


def _to_lists(values: np.ndarray, row: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def _by_language(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[tuple[str | None, pa.RecordBatch]]:
    """Parts of the batches of one language each."""
    for batch in batches:
        groups: dict[str | None, list[int]] = {}
        for i, g in enumerate(batch.column("lang").to_pylist()):
            groups.setdefault(g, []).append(i)
        for g, at in groups.items():
            for k in range(0, len(at), rows):
                yield g, batch.take(pa.array(at[k : k + rows]))


def _group_sums(values: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct groups in order and the sums of their rows; group is sorted."""
    if not len(group):
        return group, values[:0]
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    return group[starts], np.add.reduceat(values, starts, axis=0)


def _spread(found: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    out = np.zeros((n, found[1].shape[1]), dtype=np.float64)
    out[found[0]] = found[1]
    return out


class Sparse:
    """Term weights of some documents by bucket, and products with them; no dense block."""

    def __init__(self, batch: pa.RecordBatch):
        self.n = batch.num_rows
        self.bucket, self.row = _lists(batch.column("distinct"))
        self.weight = batch.column("weight").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        self.labels = batch.column("label").to_pylist()

    def times(self, q: np.ndarray) -> np.ndarray:
        return _spread(_group_sums(self.weight[:, None] * q[self.bucket], self.row), self.n)

    def transposed_times(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, sums), and in a last row numbered BUCKETS the sum of y."""
        order = np.argsort(self.bucket, kind="stable")
        at, sums = _group_sums(self.weight[order, None] * y[self.row[order]], self.bucket[order].astype(np.int64))
        return np.append(at, BUCKETS), np.concatenate([sums, y.sum(0)[None, :]])


def _summed(df: DataFrame, width: int, work: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[str, np.ndarray, np.ndarray]]]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Sums over all rows of one array per language: work yields (language, row numbers,
    rows of `width` numbers), and so does the result, in order of the row numbers. Rows
    are added up in each task before the exchange and by it; the driver gets at most
    BUCKETS + 1 rows a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                at = np.concatenate([a for a, _ in parts])
                order = np.argsort(at, kind="stable")
                at, sums = _group_sums(np.concatenate([v for _, v in parts])[order], at[order])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), *(pa.array(sums[:, k].astype(np.float64)) for k in range(width))], names)
            held.clear()

        for lang, at, values in work(batches):
            held.setdefault(lang, []).append((at, values))
            size += len(at)
            if size > 2_000_000 // width:
                yield from flush()
                size = 0
        yield from flush()

    names = ["lang", "at", *(f"s{k}" for k in range(width))]
    rows = df.mapInArrow(run, "lang string, at int, " + ", ".join(f"{c} double" for c in names[2:]))
    t = rows.groupBy("lang", "at").agg(*[F.sum(c).alias(c) for c in names[2:]]).toArrow()
    langs, at = np.array(t.column("lang").to_pylist(), dtype=object), t.column("at").to_numpy()
    values = np.stack([t.column(c).to_numpy() for c in names[2:]], axis=1) if len(at) else np.zeros((0, width))
    order = np.argsort(at, kind="stable")
    langs, at, values = langs[order], at[order], values[order]
    return {lang: (at[langs == lang], values[langs == lang]) for lang in sorted(set(langs))}


class Compact:
    """An array by bucket that travels without its empty rows."""

    def __init__(self, at: np.ndarray, rows: np.ndarray):
        self.at, self.rows = at, rows.astype(np.float32)
        self._array: np.ndarray | None = None

    def __getstate__(self):
        return {"at": self.at, "rows": self.rows, "_array": None}

    @property
    def array(self) -> np.ndarray:
        if self._array is None:
            self._array = np.zeros((BUCKETS + 1, self.rows.shape[1]), dtype=np.float32)
            self._array[self.at] = self.rows
        return self._array


class Weights:
    """Documents by bucket and language: inverse document frequencies, and the language
    of a text without one."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        """counts: documents of each bucket, and of the language in the last row."""
        self.df = {g: Compact(*c) for g, c in counts.items()}
        everywhere = np.zeros(BUCKETS)
        for at, n in counts.values():
            everywhere[at[:-1]] += n[:-1, 0]
        known = np.flatnonzero(everywhere)
        self.all = Compact(known, everywhere[known, None] / max(1.0, everywhere.sum()))

    def idf(self, lang: str) -> np.ndarray:
        df = self.df[lang].array[:, 0].astype(np.float64)
        return np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    def language(self, buckets: np.ndarray) -> str | None:
        """The language that makes the terms likeliest; null where no term is known."""
        own = np.unique(buckets)
        base = self.all.array[own, 0]
        own, base = own[base > 0], base[base > 0]
        if not len(own):
            return None
        score = {}
        for g in sorted(self.df):
            df = self.df[g].array[:-1, 0]
            score[g] = float(np.log(OWN * df[own] / max(1.0, df.sum()) + (1 - OWN) * base).sum())
        return max(score, key=score.get)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    for lang, batch in _by_language(batches):
        if lang is not None:
            term, row = _lists(batch.column("term"))
            at, n = np.unique(np.unique(row.astype(np.int64) * BUCKETS + term) % BUCKETS, return_counts=True)
            yield lang, np.append(at, BUCKETS), np.append(n, batch.num_rows)[:, None]


def _encode(weights: Weights):
    """The normed tf-idf weights of each document, and a language for those without."""

    def part(lang: str | None, batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        term, row = _lists(batch.column("term"))
        if lang in weights.df:
            key, count = np.unique(row.astype(np.int64) * BUCKETS + term, return_counts=True)
            at, distinct = key // BUCKETS, key % BUCKETS
            weight = (1 + np.log(count)) * idf[lang][distinct]
            weight = weight / np.maximum(np.sqrt(np.bincount(at, weight**2, minlength=n)), 1e-9)[at]
        else:
            at = distinct = np.zeros(0, np.int64)
            weight = np.zeros(0)
        lists = [_to_lists(distinct.astype(np.int32), at, n, pa.int32()), _to_lists(weight.astype(np.float32), at, n, pa.float32())]
        own = [batch.column(c) for c in ("label", "n_sentences", "sentence", "term")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([lang] * n, pa.string()), *own, *lists], ["doc_id", "lang", "label", "n_sentences", "sentence", "term", "distinct", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, batch in _by_language(batches):
            if lang in weights.df and lang not in idf:
                idf[lang] = weights.idf(lang)
            if lang is not None:
                yield part(lang, batch)
                continue
            told: dict[str | None, list[int]] = {}
            for i, terms in enumerate(batch.column("term")):
                told.setdefault(weights.language(terms.values.to_numpy()), []).append(i)
            for g, at in told.items():
                if g is not None and g not in idf:
                    idf[g] = weights.idf(g)
                yield part(g, batch.take(pa.array(at)))

    idf: dict[str, np.ndarray] = {}
    return run


def _orthonormal(a: np.ndarray) -> np.ndarray:
    """A basis of the columns; columns of zeros where there are fewer rows than columns."""
    out = np.zeros_like(a)
    q = np.linalg.qr(a)[0]
    out[:, : q.shape[1]] = q
    return out


def _unit(a: np.ndarray) -> np.ndarray:
    return a / np.maximum(np.linalg.norm(a, axis=-1, keepdims=True), 1e-12)


class Space:
    """Of each language: projection of terms, mean document in it, centroids of the
    subjects, and the weight of each term in a sentence."""

    def __init__(self, subjects: list[str]):
        self.subjects = subjects
        self.basis: dict[str, Compact] = {}
        self.shift: dict[str, np.ndarray] = {}
        self.centroids: dict[str, np.ndarray] = {}
        self.weight: dict[str, Compact] = {}


def _one_hot(labels: list, subjects: list[str]) -> np.ndarray:
    """By document: 1 in the column of its label and, for all, in a last column."""
    at = {t: i for i, t in enumerate(subjects)}
    out = np.zeros((len(labels), len(subjects) + 1))
    out[:, -1] = 1
    for i, label in enumerate(labels):
        if label in at:
            out[i, at[label]] = 1
    return out


def fit(encoded: DataFrame, weights: Weights, subjects: list[str]) -> Space:
    """Truncated singular value decomposition by subspace iteration, then centroids seeded
    by the labels and refined on all documents, then the weights of the terms."""
    space = Space(subjects)
    m = len(subjects)
    width = max(m, DIMENSIONS)

    def parts(batches):
        for lang, batch in _by_language(batches):
            if lang is not None:
                yield lang, Sparse(batch)

    def seeds(batches):  # sums by subject and of all; the last row holds their numbers
        for lang, x in parts(batches):
            yield lang, *x.transposed_times(_one_hot(x.labels, subjects))

    mean: dict[str, np.ndarray] = {}  # of the buckets that the language has
    for lang, (at, sums) in _summed(encoded, m + 1, seeds).items():
        n = sums[-1]
        mean[lang] = sums[:-1, m] / max(1.0, n[m])
        own = (sums[:-1, :m] / np.maximum(n[:m], 1) - mean[lang][:, None]) * (n[:m] > 0)
        extra = np.random.default_rng(7).standard_normal((len(own), width - m))
        space.basis[lang] = Compact(at[:-1], _orthonormal(np.concatenate([own, extra * 1e-3], axis=1)))

    def shifts() -> dict[str, np.ndarray]:
        return {g: mean[g] @ q.rows for g, q in space.basis.items()}

    for _ in range(SVD_PASSES):
        basis, shift = space.basis, shifts()

        def step(batches, basis=basis, shift=shift):  # of the centred matrix, without centring it
            for lang, x in parts(batches):
                yield lang, *x.transposed_times(x.times(basis[lang].array) - shift[lang])

        space.basis = {}
        for lang, (at, sums) in _summed(encoded, width, step).items():
            own, q = basis[lang].at, basis[lang].rows.astype(np.float64)
            z = np.zeros(q.shape)
            z[np.searchsorted(own, at[:-1])] = sums[:-1]
            z -= np.outer(mean[lang], sums[-1])
            # Rayleigh-Ritz: singular vectors in order of their values
            values, turn = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
            space.basis[lang] = Compact(own, _orthonormal(z @ turn[:, np.argsort(-values)]))
    basis, space.shift = space.basis, shifts()
    shift = space.shift

    def embed(batches):
        for lang, x in parts(batches):
            y = _unit(x.times(basis[lang].array) - shift[lang]).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * x.n), pa.array(x.labels, pa.string()), _to_lists(y.ravel(), np.repeat(np.arange(x.n), width), x.n, pa.float32())], ["lang", "label", "vector"]
            )

    vectors = materialize(encoded.mapInArrow(embed, "lang string, label string, vector array<float>"), "subjects-vectors")

    def sums_by_subject(current=None):
        def run(batches):
            for lang, batch in _by_language(batches):
                y = batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64)
                if current is None:
                    h = _one_hot(batch.column("label").to_pylist(), subjects)[:, :m]
                else:
                    cosine = y @ current[lang].T
                    h = (cosine.argmax(1)[:, None] == np.arange(m)) & (cosine > REFINE_COSINE)
                yield lang, np.arange(m), h.T @ y

        out = {}
        for g, (at, sums) in _summed(vectors, width, run).items():
            out[g] = np.zeros((m, width))
            out[g][at] = sums
        return out

    space.centroids = {g: _unit(c) for g, c in sums_by_subject().items()}
    for _ in range(REFINEMENTS):
        held = space.centroids
        # a subject that lost all its documents keeps its seed
        space.centroids = {g: np.where(np.linalg.norm(c, axis=1, keepdims=True) > 0, _unit(c), held[g]) for g, c in sums_by_subject(held).items()}
    for lang, c in space.centroids.items():
        # a term says as much as its own vector lies by a subject's centroid
        near = np.maximum(0, (_unit(basis[lang].rows) @ c.T).max(1, initial=0))
        space.weight[lang] = Compact(basis[lang].at, (weights.idf(lang)[basis[lang].at] * near**2)[:, None])
    return space


def _assign(space: Space, share: float):
    m = len(space.subjects)
    general = space.subjects.index(GENERAL) if GENERAL in space.subjects else -1

    def said(lang: str, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(document, subject) of each sentence that is about one."""
        sizes = batch.column("n_sentences").to_numpy().astype(np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        term, row = _lists(batch.column("term"))
        sentence = batch.column("sentence").flatten().to_numpy(zero_copy_only=False).astype(np.int64) + first[row]
        at, vectors = _group_sums(space.weight[lang].array[term] * space.basis[lang].array[term], sentence)
        cosine = _unit(vectors) @ space.centroids[lang].T
        best = cosine.argmax(1) if len(cosine) else np.zeros(0, np.int64)
        ok = (cosine.max(1, initial=-1) > SENTENCE_COSINE) & (best != general)
        return np.repeat(np.arange(len(sizes)), sizes)[at[ok]], best[ok]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, batch in _by_language(batches):
            n = batch.num_rows
            sizes = batch.column("n_sentences").to_numpy()
            counts = np.zeros((n, max(2, m)))
            if lang in space.weight:
                np.add.at(counts, said(lang, batch), 1)
            shares = counts / np.maximum(1, sizes)[:, None]
            order = np.argsort(-shares, axis=1, kind="stable")[:, :2]
            best = np.take_along_axis(shares, order, axis=1)
            row, place = np.nonzero((best >= share) & (best > 0))
            none = np.setdiff1d(np.arange(n), row)
            topics = [space.subjects[j] for j in order[row, place]] + [GENERAL] * len(none)
            rows = np.concatenate([row, none])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows)), pa.array(topics, pa.string()), pa.array(np.concatenate([best[row, place], np.zeros(len(none))])), pa.array(sizes[rows], pa.int32())],
                ["doc_id", "topic", "share", "n_sentences"],
            )

    return run


def labels_of(corpus: DataFrame, topic_list: DataFrame) -> DataFrame:
    """(doc_id, label): the spelling of topic_list that most labelled rows of a document mean."""
    names = topic_list.where(F.col("topic").isNotNull()).select(F.lower(F.trim("topic")).alias("_key"), F.col("topic").alias("label")).distinct()
    counted = (
        corpus.where(F.col("topic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id", F.lower(F.trim("topic")).alias("_key"))
        .agg(F.count("*").alias("n"))
        .join(names, "_key")
    )
    return counted.groupBy("doc_id").agg(F.max_by("label", F.struct("n", "label")).alias("label"))


def document_subjects(documents: DataFrame, corpus: DataFrame, topic_list: DataFrame, *, share: float = SENTENCE_SHARE) -> DataFrame:
    """One or two subject areas of every document.

    Method: documents are embedded per language by tf-idf weights of hashed terms and
    truncated singular value decomposition (subspace iteration over all documents);
    centroids are seeded by the documents labelled in corpus.topic and refined on all
    documents by cosine, which outvotes wrong labels. Subjects are assigned by cosine to
    those centroids: each sentence is embedded in the same space (a term weighs by its
    inverse document frequency and the square of its own cosine to the nearest
    centroid) and has the subject of the nearest centroid from SENTENCE_COSINE on. A
    subject counts from `share` of the sentences (the splitter leaves fragments, so that
    a third of the true sentences is a little less here); the two largest are kept;
    without any the document is General.

    No term is left out and nothing depends on the size of the collection: terms are
    hashed into BUCKETS, so what reaches the driver and the tasks has at most BUCKETS
    rows of DIMENSIONS numbers a language.

    Columns: doc_id, topic (as in topic_list), share, n_sentences. Null and blank texts
    and null ids give no row; texts without any word are General; a null or unknown
    language is told by script or by its terms; repeated rows give a row each. The
    subjects number as many as topic_list has rows; without labels in a language all its
    documents are General."""
    subjects = sorted(r["topic"] for r in topic_list.where(F.col("topic").isNotNull()).select("topic").distinct().collect())
    texts = documents.where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"\S")).select("doc_id", "lang", "text")
    labelled = texts.join(labels_of(corpus, topic_list), "doc_id", "left").select("doc_id", "lang", "text", "label")
    cut = materialize(labelled.mapInArrow(_cut, CUT), "subjects-cut")
    weights = Weights(_summed(cut.select("lang", "term"), 1, _document_counts))
    encoded = materialize(cut.mapInArrow(_encode(weights), ENCODED), "subjects-encoded")
    space = fit(encoded.where(F.col("lang").isNotNull()).select("lang", "label", "distinct", "weight"), weights, subjects)
    return encoded.mapInArrow(_assign(space, share), "doc_id bigint, topic string, share double, n_sentences int")


def subject_shares(found: DataFrame) -> DataFrame:
    """Documents by subject; a document with two subjects counts half for each."""
    weighted = found.withColumn("_w", F.lit(1.0) / F.count("*").over(Window.partitionBy("doc_id")))
    return weighted.groupBy("topic").agg(F.count("*").alias("documents"), F.round(F.sum("_w"), 6).alias("weight"))
