"""Collocation patterns: parser and matcher (PAT1-PAT5, Q28, Q29).

A pattern is a run of elements: <> the node, # the collocate, * any or no token, + one
token, _TAG a tag, [lemma] a lemma, anything else a word; (x) makes x optional. Before
the first anchor it must fit the end of what precedes, between the anchors all of it,
after the last one the beginning of what follows.
"""

from __future__ import annotations

from dataclasses import dataclass


class PatternError(ValueError):
    pass


@dataclass(frozen=True)
class Element:
    """kind: node, collocate, star, plus, pos, lemma or word."""

    kind: str
    value: str = ""
    optional: bool = False


def _element(text: str) -> Element:
    optional = len(text) > 2 and text.startswith("(") and text.endswith(")")
    body = text[1:-1] if optional else text
    named = {"<>": "node", "#": "collocate", "*": "star", "+": "plus"}
    if body in named:
        return Element(named[body], "", optional)
    if body.startswith("_") and len(body) > 1:
        return Element("pos", body[1:], optional)
    if body.startswith("[") and body.endswith("]") and len(body) > 2:
        return Element("lemma", body[1:-1].lower(), optional)
    return Element("word", body.lower(), optional)


def parse_pattern(text: str) -> tuple[Element, ...]:
    elements = tuple(_element(t) for t in text.split())
    if not elements:
        raise PatternError("the pattern is empty")
    for kind, sign in (("node", "<>"), ("collocate", "#")):
        if sum(e.kind == kind for e in elements) != 1:
            raise PatternError(f"the pattern needs exactly one {sign}")
    return elements


def parse_definitions(text: str) -> tuple[list[tuple[str, tuple[Element, ...]]], list[str]]:
    """PAT1: (label, pattern) of each 'label : pattern' line, and the errors by line.
    Blank lines and comments, lines that begin with # and hold no colon, are passed over."""
    found, errors = [], []
    for number, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or (line.startswith("#") and ":" not in line):
            continue
        label, colon, pattern = line.partition(":")
        if not colon:
            errors.append(f"line {number}: ':' is missing")
        elif not label.strip():
            errors.append(f"line {number}: the label is empty")
        else:
            try:
                found.append((label.strip(), parse_pattern(pattern)))
            except PatternError as e:
                errors.append(f"line {number}: {e}")
    return found, errors


#: A line is a list of (token, pos, lemma).
Line = list[tuple[str, str | None, str | None]]


def _fits(e: Element, token: tuple) -> bool:
    word, pos, lemma = token
    if e.kind in ("star", "plus"):
        return True
    if e.kind == "pos":
        return pos == e.value
    if e.kind == "lemma":
        return (lemma or "").lower() == e.value
    return word.lower() == e.value


def _consume(elements: tuple[Element, ...], line: Line, whole: bool) -> bool:
    """Whether the elements fit the beginning of the line, or all of it.

    An optional element takes a token that fits and is not tried without it (Q29); a star
    may take one token or none. At the line's end only optional elements may be left."""
    places = {0}
    for e in elements:
        after = set()
        for i in places:
            if e.kind == "star":
                after.add(i)
                if i < len(line):
                    after.add(i + 1)
            elif i < len(line) and _fits(e, line[i]):
                after.add(i + 1)
            elif e.optional:
                after.add(i)
        places = after
        if not places:
            return False
    return len(line) in places if whole else True


def match(elements: tuple[Element, ...], line: Line, node: str, collocate: str) -> tuple[bool, int, int]:
    """PAT3: (found, place of the node, place of the collocate), the first pair that fits;
    (False, -1, -1) else. Every occurrence of node and collocate is tried."""
    at = [k for k, e in enumerate(elements) if e.kind in ("node", "collocate")]
    node_first = elements[at[0]].kind == "node"
    before, between, after = elements[: at[0]], elements[at[0] + 1 : at[1]], elements[at[1] + 1 :]
    nodes = [i for i, t in enumerate(line) if t[0].lower() == node.lower()]
    others = [i for i, t in enumerate(line) if t[0].lower() == collocate.lower()]
    for n in nodes:
        for c in others:
            first, second = (n, c) if node_first else (c, n)
            if first >= second:
                continue
            if (
                _consume(before[::-1], line[:first][::-1], False)
                and _consume(between, line[first + 1 : second], True)
                and _consume(after, line[second + 1 :], False)
            ):
                return True, n, c
    return False, -1, -1
