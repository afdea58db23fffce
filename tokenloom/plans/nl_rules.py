"""Plain-language queries by rules, on the driver (PRD18, Q21, Q22).

A sentence is read into pieces (terms and marks); phrases of pieces are then dropped,
turned into wildcards, put in order by the connectors between them, and tagged."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

#: Parts of speech in plain words, and their tags. Fixed values.
POS_WORDS = {
    "noun": "NN",
    "verb": "VB",
    "adjective": "JJ",
    "adverb": "RB",
    "preposition": "IN",
    "determiner": "DT",
    "pronoun": "PRP",
    "conjunction": "CC",
    "modal": "MD",
    "particle": "RP",
    "interjection": "UH",
}
#: Further words of tag definitions that name a part of speech. Fixed values.
MORE_POS_TERMS = ("article", "auxiliary", "numeral", "quantifier")
#: Words of command that are no part of a query; "the" goes even as a search word. Fixed values.
COMMANDS = ("find", "search for", "search", "concordance of", "query", "look up", "examples of", "the word", "the")
#: What a word may be said to begin with, end with or contain, and the wildcard. Fixed values.
WILDCARDS = {
    "beginning with": "{}*",
    "begins with": "{}*",
    "starting with": "{}*",
    "starts with": "{}*",
    "start with": "{}*",
    "ending with": "*{}",
    "ends with": "*{}",
    "end with": "*{}",
    "containing": "*{}*",
    "contains": "*{}*",
    "contain": "*{}*",
}
#: Words that stand for any token. Fixed values.
ANY = ("any word", "anything", "any")
#: Connectors by precedence, and whether the term after them comes later in the text. Fixed values.
CONNECTORS = {
    "followed by": True,
    "preceded by": False,
    "before": True,
    "after": False,
    "following": False,
    "and": True,
    "preceding": True,
}
#: Second connectors of a run of three terms, after "followed by". Fixed values.
CHAINS = ("followed by", "and")
ARTICLES = ("a", "an", "the")
#: What each front end takes besides the query. Fixed values.
MODULES = {
    "concordance": ("query", {"window": 5, "pos_filter": "", "sort_order": "Node"}),
    "collocation": ("node_word", {"window": 5, "min_freq": 3, "pos_filter": "", "lemma_filter": "", "token_filter": ""}),
    "ngram": ("search_term", {"n_size": 2, "min_freq": 3}),
    "dictionary": ("word", {}),
    "distribution": ("search_term", {"metric": "Relative Frequency (Density %)"}),
}


@dataclass(frozen=True)
class Piece:
    """A term or a run of marks; glued tells that no white space stands before it."""

    text: str
    glued: bool = False

    @property
    def low(self) -> str:
        return self.text.lower()

    @property
    def is_term(self) -> bool:
        return bool(re.fullmatch(r"[\w*\[\]]+", self.text))


def read(text: str) -> list[Piece]:
    return [Piece(m[2], not m[1] and m.start() > 0) for m in re.finditer(r"(\s*)([\w*\[\]]+|[^\w\s*\[\]]+)", text)]


def write(pieces: list[Piece]) -> str:
    return "".join(("" if p.glued or i == 0 else " ") + p.text for i, p in enumerate(pieces))


def _phrase_at(pieces: list[Piece], at: int, phrases: list[list[str]]) -> int:
    """Pieces that the longest phrase standing at a place takes, 0 for none."""
    fits = [len(p) for p in phrases if [x.low for x in pieces[at : at + len(p)]] == p]
    return max(fits, default=0)


def _rewrite(pieces: list[Piece], phrases: list[str], change: Callable[[str, list[Piece]], tuple[list[Piece], int]]) -> list[Piece]:
    """Replace every phrase: change gets it and the pieces after it, and gives the pieces
    to put there and how many of those after it they take up."""
    split = [p.split() for p in phrases]
    out, at = [], 0
    while at < len(pieces):
        n = _phrase_at(pieces, at, split)
        if n == 0:
            out.append(pieces[at])
            at += 1
            continue
        said = " ".join(p.low for p in pieces[at : at + n])
        new, taken = change(said, pieces[at + n :])
        out += new
        at += n + taken
    return out


def _wildcard(said: str, after: list[Piece]) -> tuple[list[Piece], int]:
    words = said.removeprefix("words ").removeprefix("word ")
    if not after or not re.fullmatch(r"\w+", after[0].text):
        return [Piece(w) for w in said.split()], 0
    return [Piece(WILDCARDS[words].format(after[0].text))], 1


def _in_order(pieces: list[Piece]) -> list[Piece]:
    """The terms that a connector joins, in the order of the text and lower case; all
    pieces as they are if there is none."""
    links: dict[int, tuple[str, int]] = {}  # place of a connector: its words, place of the term after it
    for at in range(1, len(pieces)):
        for name in CONNECTORS:
            words = name.split()
            if [p.low for p in pieces[at : at + len(words)]] == words and pieces[at - 1].is_term:
                after = at + len(words)
                if after + 1 < len(pieces) and pieces[after].low in ARTICLES and pieces[after + 1].is_term:
                    after += 1
                if after < len(pieces) and pieces[after].is_term:
                    links[at] = (name, after)
    for second in CHAINS:
        for at, (name, middle) in sorted(links.items()):
            if name == "followed by" and links.get(middle + 1, ("", 0))[0] == second:
                return [Piece(pieces[k].low) for k in (at - 1, middle, links[middle + 1][1])]
    for name, later in CONNECTORS.items():
        for at, (own, after) in sorted(links.items()):
            if own == name:
                return [Piece(pieces[k].low) for k in ((at - 1, after) if later else (after, at - 1))]
    return pieces


def tag_phrases(definitions: dict[str, str] | None) -> dict[str, str]:
    """Phrases in plain words and their tags. Definitions {tag: definition} replace the
    built-in words: the parts of speech named in a definition, or else all of it."""
    if not definitions:
        pairs = [(word, tag) for word, tag in POS_WORDS.items()]
        return {form: tag for word, tag in pairs for form in (word, word + "s")}
    known = {*POS_WORDS, *MORE_POS_TERMS}
    out: dict[str, str] = {}
    for tag, definition in definitions.items():
        whole = " ".join((definition or "").lower().split())
        named = known.intersection(re.findall(r"[^\s,/-]+", whole))
        if whole:
            out |= {form: tag for word in named for form in (word, word + "s")} or {whole: tag}
    return out


def parse(text: str, module: str = "concordance", definitions: dict[str, str] | None = None) -> dict:
    """The query that a plain sentence asks for, with the module's other fields. Raises
    ValueError for an unknown module."""
    if module.lower() not in MODULES:
        raise ValueError(f"unknown module: {module}")
    tags = tag_phrases(definitions)
    pieces = read(re.sub("[\"']", "", text))
    pieces = _rewrite(pieces, list(COMMANDS), lambda said, after: ([], 0))
    pieces = _rewrite(pieces, [head + w for head in ("", "word ", "words ") for w in WILDCARDS], _wildcard)
    pieces = _rewrite(pieces, list(ANY), lambda said, after: ([Piece("*")], 0))
    pieces = _in_order(pieces)
    pieces = _rewrite(pieces, list(tags), lambda said, after: ([Piece("_" + tags[said])], 0))
    field, rest = MODULES[module.lower()]
    return {field: write(pieces), **rest}
