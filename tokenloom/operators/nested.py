"""Problem 6: deeply nested records as related flat tables.

Every element and token of a tree gets interval labels by one depth-first traversal:
pre (pre-order number) and post (post-order number), both from 1 within the record. A
holds B exactly when pre(A) < pre(B) and post(A) > post(B). All parent-child links of the
flat tables follow from these labels alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from json.decoder import scanstring
from xml.parsers import expat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names by table, compared without letter case. Fixed values.
TEXT_TAGS = ("text",)
SENTENCE_TAGS = ("s", "sent", "u")
SPAN_TAGS = ("pn",)

NODE_SCHEMA = (
    "record_id bigint, filename string, fmt string, kind string, no bigint, tag string, pre bigint, post bigint, depth bigint, "
    "parent_pre bigint, text_no bigint, sent_no bigint, pn_no bigint, first_token_no bigint, n_tokens bigint, "
    "attrs map<string,string>, token string, pos string, lemma string"
)
_MAP = pa.map_(pa.string(), pa.string())


class Tree:
    """Nodes of one record in pre-order, labelled while they open and close."""

    def __init__(self) -> None:
        self.tag, self.depth, self.post = [], [], []
        self.attrs, self.token = [], []
        self._open: list[int] = []
        self._closed = 0

    def open(self, tag: str, attrs: dict | None = None, token: tuple | None = None) -> None:
        self.tag.append(tag)
        self.attrs.append(attrs or {})
        self.token.append(token)
        self.depth.append(len(self._open))
        self.post.append(0)
        self._open.append(len(self.tag) - 1)

    def close(self) -> None:
        self._closed += 1
        self.post[self._open.pop()] = self._closed

    def leaf(self, token: str, pos: str | None, lemma: str | None) -> None:
        self.open("", None, (token, pos or None, lemma or None))
        self.close()


def _xml(body: str) -> Tree:
    """Raises expat.ExpatError for a body that is not well-formed."""
    tree = Tree()
    parser = expat.ParserCreate()
    parser.buffer_text = True
    word: list = []  # of an open <w>: its attributes and text
    text: list[str] = []

    def lines() -> None:
        for line in "".join(text).split("\n"):
            token, _, rest = line.strip("\r").partition("\t")
            if token.strip():
                pos, _, lemma = rest.partition("\t")
                tree.leaf(token.strip(), pos.strip(), lemma.partition("\t")[0].strip())
        text.clear()

    def start(tag: str, attrs: dict) -> None:
        lines()
        if tag.lower() == "w":
            word.append((attrs, []))
        else:
            tree.open(tag, attrs)

    def end(tag: str) -> None:
        if tag.lower() == "w":
            attrs, parts = word.pop()
            if token := "".join(parts).strip():
                tree.leaf(token, attrs.get("pos") or attrs.get("type"), attrs.get("lemma"))
        else:
            lines()
            tree.close()

    parser.StartElementHandler = start
    parser.EndElementHandler = end
    parser.CharacterDataHandler = lambda data: (word[-1][1] if word else text).append(data)
    parser.Parse(regex.sub(r"^\s*<\?xml[^>]*\?>", "", body).encode("utf-8", "surrogatepass"), True)
    return tree


_SPACE = regex.compile(r"[ \t\r\n]*")
_ATOM = regex.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null")


def _loads_deep(body: str):
    """json.loads without recursion, for trees nested deeper than its stack allows."""
    stack: list = []
    at = _SPACE.match(body).end()
    while True:
        ch = body[at : at + 1]
        if ch in ("{", "["):
            stack.append({} if ch == "{" else [])
            at = _SPACE.match(body, at + 1).end()
            if body[at : at + 1] != ("}" if ch == "{" else "]"):
                if ch == "{":
                    at = _key(body, at, stack)
                continue
            value, at = stack.pop(), at + 1
        elif ch == '"':
            value, at = scanstring(body, at + 1, True)
        elif m := _ATOM.match(body, at):
            value, at = json.loads(m[0]), m.end()
        else:
            raise ValueError("not well-formed")
        while True:  # the value is complete: put it in its place
            at = _SPACE.match(body, at).end()
            if not stack:
                if at != len(body):
                    raise ValueError("not well-formed")
                return value
            top = stack[-1]
            if isinstance(top, tuple):
                stack.pop()
                stack[-1][top[0]] = value
                top = stack[-1]
            else:
                top.append(value)
            ch = body[at : at + 1]
            at = _SPACE.match(body, at + 1).end()
            if ch == ",":
                if isinstance(top, dict):
                    at = _key(body, at, stack)
                break
            if ch != ("}" if isinstance(top, dict) else "]"):
                raise ValueError("not well-formed")
            value = stack.pop()


def _key(body: str, at: int, stack: list) -> int:
    if body[at : at + 1] != '"':
        raise ValueError("not well-formed")
    key, at = scanstring(body, at + 1, True)
    at = _SPACE.match(body, at).end()
    if body[at : at + 1] != ":":
        raise ValueError("not well-formed")
    stack.append((key,))
    return _SPACE.match(body, at + 1).end()


def _loads(body: str):
    try:
        return json.loads(body)
    except RecursionError:
        return _loads_deep(body)


def _children(value) -> list:
    """A list of children, whether given in an array, bare, or not at all."""
    return value if isinstance(value, list) else [] if value is None else [value]


def _text(value) -> str | None:
    return None if value is None or isinstance(value, (dict, list)) else str(value)


def _json(body: str, keyed: bool) -> Tree:
    """Raises ValueError for a body that is not well-formed."""
    tree = Tree()
    stack = [iter(_children(_loads(body)))]
    while stack:
        item = next(stack[-1], None) if not isinstance(stack[-1], str) else None
        if item is None:
            if isinstance(stack[-1], str):
                stack.pop()
                tree.close()
                continue
            nxt = next(stack[-1], stack)  # a null child, or the end
            if nxt is stack:
                stack.pop()
                continue
            item = nxt
        if not isinstance(item, dict):
            continue
        if "token" in item and not isinstance(item["token"], (dict, list)):
            if (token := (_text(item["token"]) or "").strip()) != "":
                tree.leaf(token, _text(item.get("pos")), _text(item.get("lemma")))
            continue
        if keyed:
            elements = [(k, v) for k, v in item.items() if not k.startswith("@")]
            later = []
            for tag, value in elements:
                if isinstance(value, dict) and ("items" in value or not value or all(k.startswith("@") for k in value)):
                    attrs = {k[1:]: _text(v) for k, v in value.items() if k.startswith("@")}
                    later.append((tag, attrs, _children(value.get("items"))))
                else:
                    later.append((tag, {}, _children(value)))
        else:
            attrs = item.get("attrs")
            later = [(_text(item.get("tag")) or "", {k: _text(v) for k, v in attrs.items()} if isinstance(attrs, dict) else {}, _children(item.get("children")))]
        if len(later) == 1:
            tag, attrs, children = later[0]
            tree.open(tag, attrs)
            stack += ["close", iter(children)]
        else:  # several elements in one object: one after the other
            stack.append(iter([{tag: {"items": children} | {"@" + k: v for k, v in attrs.items()}} for tag, attrs, children in later]))
    return tree


def parse(fmt: str | None, body: str | None) -> Tree | None:
    """The labelled tree of a body; null when it is missing or not well-formed."""
    if body is None:
        return None
    try:
        if fmt == "xml":
            return _xml(body)
        return _json(body, keyed=fmt == "json_keyed")
    except (expat.ExpatError, ValueError):
        return None


def enclosing(pre: np.ndarray, post: np.ndarray, size: np.ndarray, is_parent: np.ndarray) -> np.ndarray:
    """Row of the nearest enclosing parent of every node, by interval containment; -1
    where there is none. Rows must be in pre-order; size counts the nodes of subtrees."""
    out = np.full(len(pre), -1, dtype=np.int64)
    parents = np.flatnonzero(is_parent & (size > 1))
    if size[parents].sum() <= 64 * len(pre):
        for i in parents:  # inner parents come later and take their part of the interval
            out[i + 1 : i + size[i]] = i
        return out
    held: list[int] = []  # very deep trees: one pass over the nodes
    for i in range(len(pre)):
        while held and post[held[-1]] < post[i]:
            held.pop()
        if held:
            out[i] = held[-1]
        if is_parent[i]:
            held.append(i)
    return out


def _rows(tree: Tree) -> dict[str, list]:
    n = len(tree.tag)
    pre, post, depth = np.arange(1, n + 1), np.array(tree.post, dtype=np.int64), np.array(tree.depth, dtype=np.int64)
    low = [t.lower() for t in tree.tag]
    is_token = np.array([t is not None for t in tree.token], dtype=bool)
    tokens_before = np.concatenate([[0], np.cumsum(is_token)])
    size = post - pre + depth + 1  # nodes of the subtree, from the labels alone
    n_tokens = tokens_before[pre - 1 + size] - tokens_before[pre - 1]
    kind = np.where(is_token, "token", "element").astype(object)
    numbers = {"token": is_token}
    for name, tags in (("text", TEXT_TAGS), ("sentence", SENTENCE_TAGS), ("pn", SPAN_TAGS)):
        own = np.array([t in tags for t in low], dtype=bool) & ~is_token
        if name == "pn":
            own &= n_tokens > 0
        numbers[name] = own
        kind[own] = name
    no = np.zeros(n, dtype=np.int64)
    links = {}
    for name, own in numbers.items():
        no[own] = np.arange(1, own.sum() + 1)
        if name != "token":
            at = enclosing(pre, post, size, own)
            links[name] = np.where(at >= 0, np.cumsum(own)[at], 0)
    rest = kind == "element"
    no[rest] = np.arange(1, rest.sum() + 1)
    return {
        "kind": kind.tolist(), "no": no, "tag": [None if t else g for t, g in zip(is_token, tree.tag)], "pre": pre, "post": post, "depth": depth,
        "parent_pre": enclosing(pre, post, size, np.ones(n, dtype=bool)) + 1, "text_no": links["text"], "sent_no": links["sentence"], "pn_no": links["pn"],
        "first_token_no": tokens_before[pre - 1] + 1, "n_tokens": n_tokens, "attrs": [list(a.items()) for a in tree.attrs],
        "token": [t and t[0] for t in tree.token], "pos": [t and t[1] for t in tree.token], "lemma": [t and t[2] for t in tree.token],
    }


_FIELDS = [
    ("record_id", pa.int64()), ("filename", pa.string()), ("fmt", pa.string()), ("kind", pa.string()), ("no", pa.int64()), ("tag", pa.string()), ("pre", pa.int64()),
    ("post", pa.int64()), ("depth", pa.int64()), ("parent_pre", pa.int64()), ("text_no", pa.int64()), ("sent_no", pa.int64()), ("pn_no", pa.int64()),
    ("first_token_no", pa.int64()), ("n_tokens", pa.int64()), ("attrs", _MAP), ("token", pa.string()), ("pos", pa.string()), ("lemma", pa.string()),
]


def _node_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {k: [] for k, _ in _FIELDS}

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(held[k], t) for k, t in _FIELDS], [k for k, _ in _FIELDS])
        for v in held.values():
            v.clear()
        return out

    for batch in batches:
        for record, filename, fmt, body in zip(*(batch.column(c).to_pylist() for c in ("record_id", "filename", "fmt", "body"))):
            tree = parse(fmt, body)
            if tree is None or not tree.tag:
                continue
            rows = _rows(tree)
            n = len(rows["kind"])
            held["record_id"] += [record] * n
            held["filename"] += [filename] * n
            held["fmt"] += [fmt] * n
            for k, v in rows.items():
                held[k] += v.tolist() if isinstance(v, np.ndarray) else v
            if len(held["kind"]) >= 20_000:
                yield flush()
    if held["kind"]:
        yield flush()


def distinct_records(raw_records: DataFrame) -> DataFrame:
    """Each record_id once: the earliest delivery, of equally early ones the one with the
    least digest. Combined before the exchange, so a record delivered very often does not
    meet in one task. Records without id are left out."""
    body = F.struct("filename", "fmt", "body")
    order = F.struct("received_at", F.sha2("body", 256), "fmt", "filename")
    return (
        raw_records.where(F.col("record_id").isNotNull())
        .groupBy("record_id")
        .agg(F.min_by(body, order).alias("_r"))
        .select("record_id", "_r.filename", "_r.fmt", "_r.body")
    )


def nodes(raw_records: DataFrame) -> DataFrame:
    """All elements and tokens of the records' trees, flat, with interval labels and links.

    kind is 'text', 'sentence', 'pn' (with a token inside), 'token' or 'element' (any
    other). no counts from 1 within record and kind in document order. text_no, sent_no
    and pn_no are the nearest enclosing node of that kind, 0 if none; parent_pre is the
    direct parent's pre, 0 for a root. first_token_no and n_tokens tell the tokens below.

    A token without text is no token; null or empty optional parts are read as missing;
    a bare child counts as an array of one; element names compare without letter case. A
    body that is null or not well-formed gives no row. Trees may be of any depth (no
    recursion). Other columns of the table are ignored; an empty table gives none."""
    return distinct_records(raw_records).mapInArrow(_node_batches, NODE_SCHEMA)


def spans(raw_records: DataFrame) -> DataFrame:
    """One row per PN element with a token inside: record_id, sent_no, pn_no,
    parent_pn_no (0 if none), first_token_no, n_tokens."""
    return (
        nodes(raw_records)
        .where(F.col("kind") == "pn")
        .select("record_id", "sent_no", F.col("no").alias("pn_no"), F.col("pn_no").alias("parent_pn_no"), "first_token_no", "n_tokens")
    )


def texts(raw_records: DataFrame) -> DataFrame:
    """One row per text element with its attributes."""
    return nodes(raw_records).where(F.col("kind") == "text").select(
        "record_id", "filename", F.col("no").alias("text_no"), "pre", "post", "first_token_no", "n_tokens", F.to_json("attrs").alias("attrs")
    )


def sentences(raw_records: DataFrame) -> DataFrame:
    """One row per s, sent or u element, linked to its text."""
    return nodes(raw_records).where(F.col("kind") == "sentence").select(
        "record_id", F.col("no").alias("sent_no"), "text_no", "tag", "pre", "post", "first_token_no", "n_tokens", F.to_json("attrs").alias("attrs")
    )


def tokens(raw_records: DataFrame) -> DataFrame:
    """One row per token, linked to its text, sentence and innermost PN."""
    return nodes(raw_records).where(F.col("kind") == "token").select(
        "record_id", F.col("no").alias("token_no"), "text_no", "sent_no", "pn_no", "pre", "post", "token", "pos", "lemma"
    )
