"""Token filters: over token arrays inside the JVM, and over Python lists. Inputs are never changed."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.model import Token

# The default English stop words.
ENGLISH_STOP_WORDS = "a an and are as at be by for from has he in is it its of on that the to was were will with".split()


class TokenFilter:
    def apply(self, tokens: list[Token]) -> list[Token]:
        raise NotImplementedError

    def column(self, tokens: Column) -> Column:
        raise NotImplementedError


def _with_term(t: Column, term: Column) -> Column:
    return t.withField("term", term)


def lower(term: Column) -> Column:
    """Lower case character by character: no final sigma, no two-character result."""
    return F.lower(F.translate(term, "Σİ", "σi"))


def lower_text(s: str) -> str:
    return s.lower() if s.isascii() else "".join("i" if c == "İ" else "σ" if c == "Σ" else c.lower() for c in s)


class LowercaseFilter(TokenFilter):
    def apply(self, tokens: list[Token]) -> list[Token]:
        return [t._replace(term=lower_text(t.term)) for t in tokens]

    def column(self, tokens: Column) -> Column:
        return F.transform(tokens, lambda t: _with_term(t, lower(t["term"])))


class StopWordFilter(TokenFilter):
    """Drops exact terms; the others keep their positions."""

    def __init__(self, words: Iterable[str] = ENGLISH_STOP_WORDS):
        self.words = frozenset(words)

    def apply(self, tokens: list[Token]) -> list[Token]:
        return [t for t in tokens if t.term not in self.words]

    def column(self, tokens: Column) -> Column:
        return F.filter(tokens, lambda t: ~t["term"].isin(sorted(self.words))) if self.words else tokens


# Endings in the order in which they are tried, the byte length
# that a term must exceed, and what takes the ending's place.
ENDINGS = (("ing", 5, ""), ("ied", 4, "y"), ("ed", 4, ""), ("es", 4, ""), ("s", 3, ""))


def stem(term: Column) -> Column:
    """The first ending that applies is taken off; after ``ing`` a doubled last ASCII letter is single; ``ss`` stays."""
    size = F.octet_length(term)
    out = None
    for end, least, put in ENDINGS:
        cut = F.concat(F.substring(term, F.lit(1), F.length(term) - len(end)), F.lit(put)) if put else F.substring(term, F.lit(1), F.length(term) - len(end))
        if end == "ing":
            cut = F.regexp_replace(cut, r"([\x00-\x7F])\1\z", "$1")
        hit = (size > least) & term.endswith(end)
        if end == "s":
            hit = hit & ~term.endswith("ss")
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(term)


def stem_text(s: str) -> str:
    size = len(s.encode())
    for end, least, put in ENDINGS:
        if size > least and s.endswith(end) and not (end == "s" and s.endswith("ss")):
            cut = s[: -len(end)]
            if end == "ing" and len(cut) > 1 and cut[-1] == cut[-2] and cut[-1].isascii():
                cut = cut[:-1]
            return cut + put
    return s


class StemmerFilter(TokenFilter):
    def apply(self, tokens: list[Token]) -> list[Token]:
        return [t._replace(term=stem_text(t.term)) for t in tokens]

    def column(self, tokens: Column) -> Column:
        return F.transform(tokens, lambda t: _with_term(t, stem(t["term"])))
