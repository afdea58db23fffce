"""The token-pattern query language: terms, parsed on the driver, compiled to Columns.

A query is a run of terms parted by white space; `<tag ...>` is one term. Terms: word,
wo*d, [lemma], _POS, _A|B*, token_POS, <tag attr="value*">. PRD1-PRD7, PRD16, Q9-Q12,
Q36, Q37.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Term:
    """kind: word, lemma, pos, token_pos, tag or any_of."""

    kind: str
    value: str = ""
    pos: str = ""
    attrs: tuple[tuple[str, str], ...] = field(default=())


_SPLIT = re.compile(r"<[^>]+>|\S+")


def split_query(query: str) -> list[str]:
    return _SPLIT.findall(query.strip())


def _attributes(text: str) -> tuple[tuple[str, str], ...]:
    """Names and quoted values in the text of a tag. What has no quoted value says nothing."""
    out, at = [], 0
    while (equals := text.find("=", at)) >= 0:
        at = equals + 1
        quote = text[at : at + 1]
        end = text.find(quote, at + 1) if quote in ("'", '"') else -1
        name = re.split(r"\W", text[:equals])[-1]
        if end > 0:
            if name:
                out.append((name.lower(), text[at + 1 : end]))
            at = end + 1
    return tuple(out)


def parse_tag(text: str) -> Term:
    inside = text.strip("<>").strip()
    name = re.match(r"[\w\-]+", inside)
    return Term("tag", name[0].lower() if name else "", attrs=_attributes(inside))


def parse_term(text: str, *, keep_affixes: bool = False, alternatives: bool = False) -> Term:
    """One term. keep_affixes: text around [lemma] joins the lemma pattern (collocation).
    alternatives: (a|b) is a list of words (statistics)."""
    if text.startswith("<") and text.endswith(">"):
        return parse_tag(text)
    if alternatives and text.startswith("(") and text.endswith(")") and "|" in text:
        return Term("any_of", "|".join(w.strip().lower() for w in text[1:-1].split("|") if w.strip()))
    if m := re.search(r"\[([^\]]*)\]", text):
        value = text[: m.start()] + m[1] + text[m.end() :] if keep_affixes else m[1]
        return Term("lemma", value.lower())
    if "_" in text and not text.startswith("_"):
        token, pos = text.rsplit("_", 1)
        if token and pos:
            return Term("token_pos", token.lower(), pos)
    if m := re.fullmatch(r"_([A-Za-z0-9*|\-]+)", text):
        return Term("pos", m[1])
    return Term("word", text.lower())


def parse_query(query: str, **options: bool) -> list[Term]:
    terms = [parse_term(t, **options) for t in split_query(query)]
    if not terms:
        raise ValueError("the query is empty")
    return terms


def glob_regex(pattern: str, wild: str = "*", alternation: bool = False) -> str:
    """Anchored regular expression of a pattern with wildcards; alternatives are grouped (Q36)."""
    parts = pattern.split("|") if alternation else [pattern]
    out = []
    for part in parts:
        out.append("".join(".*" if c in wild else re.escape(c) for c in part))
    return "^(" + "|".join(out) + r")\z"


def glob(column: Column, pattern: str, alternation: bool = False) -> Column:
    """Match of a pattern. Plain patterns and those with wildcards at the edges only stay
    free of regular expressions, so that prefixes reach the scan."""
    if alternation and "|" in pattern:
        if "*" not in pattern:
            return column.isin(*pattern.split("|"))
        return column.rlike(glob_regex(pattern, alternation=True))
    if "*" not in pattern:
        return column == pattern
    inner = pattern.strip("*")
    if inner and "*" not in inner:
        if pattern.startswith("*") and pattern.endswith("*"):
            return column.contains(inner)
        return column.endswith(inner) if pattern.startswith("*") else column.startswith(inner)
    return column.rlike(glob_regex(pattern))


def compile_term(term: Term, *, raw: bool = False, alternation: bool = False) -> Column:
    """Predicate of a term on one token row. In raw mode (an untagged corpus) lemma and
    POS terms say nothing and match every row, and token_POS looks at the token only (Q10)."""
    low = F.col("_token_low")
    if term.kind == "word":
        return glob(low, term.value, alternation)
    if term.kind == "any_of":
        return low.isin(*term.value.split("|"))
    if term.kind == "lemma":
        return F.lit(True) if raw else glob(F.lower("lemma"), term.value, alternation)
    if term.kind == "pos":
        return F.lit(True) if raw else glob(F.col("pos"), term.pos or term.value, alternation=True)
    if term.kind == "token_pos":
        token = glob(low, term.value, alternation)
        return token if raw else token & glob(F.col("pos"), term.pos, alternation=True)
    if term.kind == "tag":
        found = F.col(f"in_{term.value}_start")
        return reduce(lambda c, a: c & glob(F.col(f"{term.value}_{a[0]}"), a[1]), term.attrs, found)
    raise ValueError(f"unknown kind of term: {term.kind}")


def term_length(term: Term) -> Column:
    return F.col(f"{term.value}_len").cast("bigint") if term.kind == "tag" else F.lit(1).cast("bigint")


# n-gram slots -------------------------------------------------------------------------

_BASIS = {"t": "_token_low", "token": "_token_low", "p": "pos", "pos": "pos", "l": "lemma", "lemma": "lemma"}


def basis_column(basis: str) -> str:
    return _BASIS[basis]


def slot_predicate(pattern: str | list[str], token: Column, pos: Column, lemma: Column, basis: str = "t", raw: bool = False) -> Column:
    """Filter of one n-gram slot: parts joined by ';', a leading '-' negates, wildcards
    '*', '%' and '_'; a list means one of these POS tags. POS compares without case, token
    patterns as typed (PRD16)."""
    if isinstance(pattern, (list, tuple)):
        return pos.isin(*pattern)
    tests = []
    for part in (p.strip() for p in pattern.split(";")):
        negated = part.startswith("-") and len(part) > 1
        body = part[1:] if negated else part
        if not body:
            continue
        tests.append(_slot_test(body, token, pos, lemma, basis, raw, negated))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _wild(pattern: str, alternation: bool = False) -> str:
    parts = pattern.split("|") if alternation else [pattern]
    made = ["".join(".*" if c in "*%" else "." if c == "_" else re.escape(c) for c in p) for p in parts]
    return "^(" + "|".join(made) + r")\z"


def _slot_test(body: str, token: Column, pos: Column, lemma: Column, basis: str, raw: bool, negated: bool) -> Column:
    flip = (lambda c: ~c) if negated else (lambda c: c)
    bracket = re.search(r"\[([^\]]*)\]", body)
    if not bracket and "_" in body and not body.startswith("_") and not raw:
        t, p = body.rsplit("_", 1)
        if t and p:
            # a negated pair asks for neither
            return flip(token.rlike(_wild(t))) & flip(pos.rlike("(?i)" + _wild(p, True)))
    if bracket and not raw:
        return flip(F.lower(lemma).rlike(_wild(bracket[1].lower())))
    if body.startswith("_") and not raw:
        return flip(pos.rlike("(?i)" + _wild(body[1:], True)))
    column = {"_token_low": token, "pos": pos, "lemma": lemma}[basis_column(basis)]
    return flip(column.rlike(_wild(body)))
