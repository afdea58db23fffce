"""Problem 9: splitting oversized texts at natural boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.tokens import encoding, ship_vocabulary, token_lengths
from tokenloom.session import spread

#: Natural boundaries, strongest first: blank line, line end, sentence end, clause mark,
#: white space. A cut lies after the match. Fixed values.
BOUNDARIES = (
    r"\n[ \t]*\n\s*",
    r"\n\s*",
    r"[.!?…؟।॥]+[\"'”’»)\]]*\s+|[。！？｡]+[」』”’）]*\s*",
    r"[,;:،؛]\s+|[、，；：]\s*",
    r"\s+",
)
#: A stronger boundary is preferred while it leaves at least this share of the limit.
FILL = (0.5, 0.6, 0.7, 0.8, 0.25)


class Offsets:
    """Prefix sums of the token lengths of a text, and its boundaries as token numbers."""

    def __init__(self, text: str, vocabulary: str):
        self.text, self.raw = text, text.encode("utf-8", "surrogatepass")
        self.ends = np.concatenate([[0], np.cumsum(token_lengths(text, vocabulary))])
        starts = np.frombuffer(self.raw, np.uint8)
        self.char_at = np.flatnonzero((starts & 0xC0) != 0x80)  # byte offset of each character
        whole = np.ones(len(self.raw) + 1, dtype=bool)
        whole[:-1] = (starts & 0xC0) != 0x80
        self.whole = whole[self.ends]  # a token may end inside a character

    @property
    def n(self) -> int:
        return len(self.ends) - 1

    def boundaries(self) -> list[np.ndarray]:
        """Sorted token numbers at which each kind of boundary lies (the token that holds
        the boundary is complete)."""
        found = []
        byte_of = np.concatenate([self.char_at, [len(self.raw)]])
        for pattern in BOUNDARIES:
            chars = np.fromiter((m.end() for m in regex.finditer(pattern, self.text)), dtype=np.int64)
            at = byte_of[chars]
            i = np.searchsorted(self.ends, at)
            exact = self.ends[i] == at
            # a token that begins with the white space before a word: cut before it
            before = np.maximum(i - 1, 0)
            spaced = ~exact & (at - self.ends[before] <= 1)
            found.append(np.unique(np.concatenate([i[exact], before[spaced]])))
        return found

    def whole_before(self, i: int, low: int) -> int:
        """The last place at or before token i, after low, that is a character boundary."""
        while i > low and not self.whole[i]:
            i -= 1
        return i

    def piece(self, i: int, j: int) -> str:
        return self.raw[self.ends[i] : self.ends[j]].decode("utf-8", "surrogatepass")

    def char(self, i: int) -> int:
        return int(np.searchsorted(self.char_at, self.ends[i]))


def split(text: str, limit: int, overlap: int, vocabulary: str, natural: bool = True) -> list[tuple[int, int, int, str]]:
    """(first character, end character, tokens, cut kind) of the pieces; one if it fits.

    Every piece has at most limit tokens, counted on the piece itself."""
    o = Offsets(text, vocabulary)
    if o.n <= limit:
        return [(0, len(text), o.n, "end")]
    overlap = min(overlap, limit // 2)
    marks = o.boundaries() if natural else []
    names = ("paragraph", "line", "sentence", "clause", "space")
    pieces, start, past = [], 0, 0  # past: where the piece before ended
    while True:
        top, kind = start + limit, "hard"
        while True:
            if top >= o.n:
                end, kind = o.n, "end"
            else:
                end, kind = 0, "hard"
                for own, name, fill in zip(marks, names, FILL):
                    at = int(np.searchsorted(own, top, side="right")) - 1
                    if at >= 0 and own[at] > max(start + fill * limit, past):
                        end, kind = int(own[at]), name
                        end = o.whole_before(end, start)
                        break
                else:  # else the last boundary of any kind that leaves room for the overlap
                    for own, name in zip(marks, names):
                        at = int(np.searchsorted(own, top, side="right")) - 1
                        if at >= 0 and own[at] > max(start + overlap, past, end) and o.whole[own[at]]:
                            end, kind = int(own[at]), name
                if end <= start:
                    end, kind = o.whole_before(top, start), "hard"
                if end <= start:  # one character of more tokens than the limit
                    end = top
                    while end < o.n and not o.whole[end]:
                        end += 1
            size = len(encoding(vocabulary).encode_ordinary(o.piece(start, end)))
            if size <= limit or end - start <= 1 or top - start <= limit // 2:
                break
            top -= max(1, size - limit)  # the tokenizer cuts the piece otherwise than the whole
        if end <= past:  # the overlap leaves no room for anything new
            start = past
            continue
        pieces.append((o.char(start), o.char(end), size, kind))
        past = end
        if end >= o.n:
            return pieces
        # exactly overlap tokens back, or one or two more where that would cut a character
        back = o.whole_before(end - overlap, start) if overlap else end
        start = max(back, start + 1) if back > start else end


def _pieces(limit_name: str, limit: int, overlap: int, vocabulary: str, natural: bool = True):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("limit_name", "max_tokens", "doc_id", "piece", "char_start", "char_end", "n_tokens", "cut", "text")}
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                pieces = split(text, limit, overlap, vocabulary, natural)
                if len(pieces) < 2:
                    continue
                for i, (a, b, n, cut) in enumerate(pieces):
                    for k, v in zip(out, (limit_name, limit, doc, i + 1, a, b, n, cut, text[a:b])):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[k], t) for k, t in zip(out, (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
                list(out),
            )

    return run


PIECES = "limit_name string, max_tokens int, doc_id bigint, piece int, char_start bigint, char_end bigint, n_tokens bigint, cut string, text string"


def hard_pieces(documents: DataFrame, capacity: int, vocabulary: str) -> DataFrame:
    """(doc_id, piece, n_tokens) of texts above a capacity, without overlap."""
    return documents.select("doc_id", "text").mapInArrow(_pieces("", capacity, 0, vocabulary), PIECES).select("doc_id", "piece", "n_tokens")


def split_documents(
    documents: DataFrame,
    size_limits: DataFrame,
    *,
    vocabulary: str,
    limit_name: str | None = None,
) -> DataFrame:
    """Pieces of the texts that exceed a limit of size_limits (purpose 'split').

    Method: prefix sums of token lengths against sorted arrays of natural boundaries;
    binary search for the last boundary under the limit (paragraph, line, sentence,
    clause, space, each first only while the piece stays well filled, then the last of
    any kind), one step back by overlap_tokens (to a whole character) for the next
    start, a hard cut where no boundary lies in reach. Each
    piece is counted again by itself and stays within the limit.

    One narrow pass without any exchange: a text of at most max_tokens bytes cannot
    exceed the limit (a token has at least one byte), so it is passed over before any
    tokenizing. Columns: limit_name, max_tokens, doc_id, piece (from 1), char_start,
    char_end (in characters), n_tokens, cut, text. Texts within the limit give no row.
    vocabulary: rank file of the public tokenizer, readable on the driver; it is shipped
    to the executors. Null texts give no row; null overlap counts as 0; overlap above half of the limit
    is taken as half of it. Limits with null or non-positive max_tokens are ignored."""
    chosen = size_limits.where((F.col("purpose") == "split") & (F.col("max_tokens") > 0))
    if limit_name is not None:
        chosen = chosen.where(F.col("limit_name") == limit_name)
    limits = chosen.select("limit_name", "max_tokens", "overlap_tokens").distinct().collect()
    spark = documents.sparkSession
    ship_vocabulary(spark, vocabulary)
    out = spark.createDataFrame([], PIECES)
    for r in sorted(limits, key=lambda r: str(r["limit_name"])):
        long = spread(documents.where(F.octet_length("text") > r["max_tokens"]).select("doc_id", "text"))
        out = out.unionByName(
            long.mapInArrow(_pieces(r["limit_name"], r["max_tokens"], max(0, r["overlap_tokens"] or 0), vocabulary), PIECES)
        )
    return out
