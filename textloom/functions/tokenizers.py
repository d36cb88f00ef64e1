"""Tokenizers: each as a native column and as a scanner of one Python string.

``column(text)`` gives ``ARRAY<STRUCT<term, position, type>>`` inside the JVM;
``scan(text)`` gives the same tokens with byte offsets on the driver or in an
Arrow batch. Null and empty texts have no tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType

from textloom.functions import patterns as P
from textloom.model import TOKEN, Token

_NUMBER = regex.compile(r"[\p{Nd}.,+\-]+")
_HAN = regex.compile(r"\p{Han}")


def _tokens(text: str, pieces: Iterable[tuple[int, int, str]]) -> list[Token]:
    """Tokens from code-point spans in order; bytes are counted once, from left to right."""
    if text.isascii():
        return [Token(text[a:b], i, a, b, kind) for i, (a, b, kind) in enumerate(pieces)]
    out, at, byte = [], 0, 0
    for i, (a, b, kind) in enumerate(pieces):
        byte += len(text[at:a].encode())
        term = text[a:b]
        end = byte + len(term.encode())
        out.append(Token(term, i, byte, end, kind))
        at, byte = b, end
    return out


class Tokenizer:
    """Base: a native pattern where there is one, else an Arrow function over ``scan``."""

    def scan(self, text: str) -> list[Token]:
        raise NotImplementedError

    def column(self, text: Column, types: bool = False) -> Column:
        return term_arrays(self.scan, text, types)

    def full(self, text: Column) -> Column:
        """``ARRAY<STRUCT<term, position, start_offset, end_offset, type>>`` by Arrow batches."""
        return token_arrays(self.scan, text)


def token_arrays(scan: Callable[[str], list[Token]], text: Column) -> Column:
    """Column of the tokens that ``scan`` finds; the arrays of a batch are built from flat lists."""
    kind = to_arrow_type(TOKEN)

    def run(texts: pa.Array) -> pa.Array:
        ends, flat, null = [0], [], []
        for t in texts.to_pylist():
            null.append(t is None)
            if t:
                flat += scan(t)
            ends.append(len(flat))
        columns = [
            pa.array([t.term for t in flat], pa.string()),
            pa.array([t.position for t in flat], pa.int32()),
            pa.array([t.start_offset for t in flat], pa.int32()),
            pa.array([t.end_offset for t in flat], pa.int32()),
            pa.array([t.type for t in flat], pa.string()),
        ]
        values = pa.StructArray.from_arrays(columns, fields=list(kind))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array(null))

    return F.arrow_udf(run, ArrayType(TOKEN), F.ArrowUDFType.SCALAR)(text)


def term_arrays(scan: Callable[[str], list[Token]], text: Column, types: bool) -> Column:
    """Like :func:`token_arrays`, without offsets and, unless asked for, types."""
    kind = "array<struct<term:string,position:int" + (",type:string>>" if types else ">>")
    names = ["term", "position", *(["type"] if types else [])]

    def run(texts: pa.Array) -> pa.Array:
        ends, null = [0], []
        terms: list[str] = []
        kinds: list[str] = []
        for t in texts.to_pylist():
            null.append(t is None)
            if t:
                found = scan(t)
                terms += [x[0] for x in found]
                if types:
                    kinds += [x[4] for x in found]
            ends.append(len(terms))
        sizes = np.diff(ends)
        position = np.arange(len(terms), dtype=np.int32) - np.repeat(np.array(ends[:-1], np.int32), sizes)
        columns = [pa.array(terms, pa.string()), pa.array(position), *([pa.array(kinds, pa.string())] if types else [])]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names), mask=pa.array(null))

    return F.arrow_udf(run, kind, F.ArrowUDFType.SCALAR)(text)


def _struct(term: Column, position: Column, kind: Column | None) -> Column:
    cols = [term.alias("term"), position.cast("int").alias("position")]
    return F.struct(*cols, kind.alias("type")) if kind is not None else F.struct(*cols)


class WhitespaceTokenizer(Tokenizer):
    """Runs of visible characters, punctuation kept."""

    _rx = regex.compile(P.whitespace(P.WHITE_SPACE_PY))

    def scan(self, text: str) -> list[Token]:
        return _tokens(text, ((*m.span(), "word") for m in self._rx.finditer(text)))

    def column(self, text: Column, types: bool = False) -> Column:
        found = F.regexp_extract_all(text, F.lit(P.whitespace()), F.lit(0))
        return F.transform(found, lambda t, i: _struct(t, i, F.lit("word") if types else None))


class SimpleTokenizer(Tokenizer):
    """Runs of letters and decimal digits."""

    _rx = regex.compile(P.simple())

    def scan(self, text: str) -> list[Token]:
        return _tokens(text, ((*m.span(), "word") for m in self._rx.finditer(text)))

    def column(self, text: Column, types: bool = False) -> Column:
        found = F.regexp_extract_all(text, F.lit(P.simple()), F.lit(0))
        return F.transform(found, lambda t, i: _struct(t, i, F.lit("word") if types else None))


class StandardTokenizer(Tokenizer):
    """URLs, runs of word characters with inner ``. _ + - @``, and every other visible character alone."""

    _rx = regex.compile(P.standard(P.WHITE_SPACE_PY, groups=True))

    def scan(self, text: str) -> list[Token]:
        def pieces():
            for m in self._rx.finditer(text):
                if m.lastindex == 1:
                    kind = "url"
                elif m.lastindex == 3:
                    kind = "symbol"
                else:
                    run = m.group()
                    kind = "email" if "@" in run else "number" if _NUMBER.fullmatch(run) else "word"
                yield (*m.span(), kind)

        return _tokens(text, pieces())

    def column(self, text: Column, types: bool = False) -> Column:
        if not types:
            found = F.regexp_extract_all(text, F.lit(P.standard()), F.lit(0))
            return F.transform(found, lambda t, i: _struct(t, i, None))
        rx = F.lit(P.standard(groups=True))
        # which alternative matched shows in the groups: a bare "www" may be a URL or a word
        both = F.arrays_zip(F.regexp_extract_all(text, rx, F.lit(0)).alias("t"), F.regexp_extract_all(text, rx, F.lit(1)).alias("u"), F.regexp_extract_all(text, rx, F.lit(2)).alias("w"))

        def one(x: Column, i: Column) -> Column:
            kind = (
                F.when(x["u"] != "", "url")
                .when(x["w"] == "", "symbol")
                .when(F.contains(x["w"], F.lit("@")), "email")
                .when(x["w"].rlike(r"^[\p{Nd}.,+\-]+$"), "number")
                .otherwise("word")
            )
            return _struct(x["t"], i, kind)

        return F.transform(both, one)


class _HanRuns(Tokenizer):
    """Common part of the Chinese tokenizers: what is between runs of Han signs."""

    _rx = regex.compile(rf"(\p{{Han}}+)|((?:(?!\p{{Han}})[\p{{L}}\p{{Nd}}])+)|([^\p{{P}}{P.WHITE_SPACE_PY}])", regex.DOTALL)


class DictionaryTokenizer(Tokenizer):
    """Maximum matching against a word list: ``forward``, ``reverse`` or ``both``.

    A forward match begins on a Han sign and may run into other characters; a
    reverse match ends on one. Signs without a word stand alone; runs of other
    letters and digits are words; other visible characters except punctuation
    are symbols. ``both`` takes the cutting with fewer tokens, then the one with
    fewer single-character tokens, then the forward one.
    """

    def __init__(self, words: Iterable[str] = (), mode: str = "forward"):
        if mode not in ("forward", "reverse", "both"):
            raise ValueError(f"unknown mode {mode!r}")
        self.words = frozenset(w for w in words if w)
        self.mode = mode
        self._ahead, self._back = self._pattern(self.words), self._pattern(w[::-1] for w in self.words)

    @staticmethod
    def _pattern(words: Iterable[str]) -> regex.Pattern:
        """Longest word from a Han sign on, else the sign; a run of other letters and digits; any other visible character."""
        listed = sorted((w for w in words if _HAN.match(w)), key=len, reverse=True)
        return regex.compile(rf"(\L<words>|\p{{Han}})|((?:(?!\p{{Han}})[\p{{L}}\p{{Nd}}])+)|([^\p{{P}}{P.WHITE_SPACE_PY}])", regex.DOTALL, words=listed or ["\0\0"])

    def _forward(self, text: str) -> list[tuple[int, int, str]]:
        return [(*m.span(), _HAN_KINDS[m.lastindex]) for m in self._ahead.finditer(text)]

    def _reverse(self, text: str) -> list[tuple[int, int, str]]:
        """Forward matching of the reversed words on the reversed text, mirrored."""
        n = len(text)
        return [(n - m.end(), n - m.start(), _HAN_KINDS[m.lastindex]) for m in self._back.finditer(text[::-1])][::-1]

    def scan(self, text: str) -> list[Token]:
        if self.mode == "forward":
            return _tokens(text, self._forward(text))
        back = self._reverse(text)
        if self.mode == "reverse":
            return _tokens(text, back)
        ahead = self._forward(text)
        cost = lambda cut: (len(cut), sum(b - a == 1 for a, b, _ in cut))
        return _tokens(text, back if ahead != back and cost(back) < cost(ahead) else ahead)

    def _matched(self, text: Column, back: bool) -> Column:
        """Terms of one direction as an array, by one expression of the JVM; backwards on the reversed text."""
        words = sorted((w[::-1] if back else w for w in self.words), key=len, reverse=True)
        han = "|".join([*(_quoted(w) for w in words if _HAN.match(w)), r"\p{IsHan}"])
        rx = rf"(?s)(?:{han})|(?:(?!\p{{IsHan}})[\p{{L}}\p{{Nd}}])+|[^\p{{P}}{P.WHITE_SPACE}]"
        found = F.regexp_extract_all(F.reverse(text) if back else text, F.lit(rx), F.lit(0))
        return F.transform(F.reverse(found), lambda t: F.reverse(t)) if back else found

    def column(self, text: Column, types: bool = False) -> Column:
        """Native with a list of at most ``NATIVE_WORDS`` words."""
        if len(self.words) > NATIVE_WORDS:
            return super().column(text, types)
        kind = lambda t: F.when(t.rlike(r"\p{IsHan}"), "han").when(t.rlike(r"^[\p{L}\p{Nd}]"), "word").otherwise("symbol")
        shown = lambda terms: F.transform(terms, lambda t, i: _struct(t, i, kind(t) if types else None))
        if self.mode != "both":
            return shown(self._matched(text, self.mode == "reverse"))
        # both cuttings are made once and compared inside a one-element array, whose only value is then taken
        both = F.array(F.struct(self._matched(text, False).alias("f"), self._matched(text, True).alias("r")))
        cost = lambda terms: F.struct(F.size(terms), F.size(F.filter(terms, lambda t: F.length(t) == 1)))
        best = F.transform(both, lambda x: F.when(cost(x["r"]) < cost(x["f"]), x["r"]).otherwise(x["f"]))[0]
        return shown(best)


_HAN_KINDS = {1: "han", 2: "word", 3: "symbol"}

#: Longest word list that is compiled into one expression of the JVM.
NATIVE_WORDS = 2000


def _quoted(word: str) -> str:
    return r"\Q" + word.replace(r"\E", r"\E\\E\Q") + r"\E"


class HmmTokenizer(_HanRuns):
    """Words of each maximal Han run by the best path of a hidden Markov model; other runs as in the dictionary tokenizer."""

    def __init__(self, model=None):
        from textloom.functions.hmm import HmmModel

        self.model = model or HmmModel()
        self._known: dict[str, list[str]] = {}
        self._ends: dict[int, list[int]] = {}

    def _words(self, run: str) -> list[str]:
        """Words of a Han run; short runs recur and are remembered, up to a bound."""
        if not self.model.emission:
            # all signs alike: the best path depends on the length alone
            ends = self._ends.get(len(run))
            if ends is None:
                ends = self._ends[len(run)] = [0, *accumulate(map(len, self.model.segment(run)))]
            return [run[a:b] for a, b in zip(ends, ends[1:])]
        got = self._known.get(run)
        if got is None:
            got = self.model.segment(run)
            if len(run) <= 32:
                if len(self._known) >= 50_000:
                    self._known.clear()
                self._known[run] = got
        return got

    def scan(self, text: str) -> list[Token]:
        def pieces():
            for m in self._rx.finditer(text):
                if m.lastindex == 1:
                    at = m.start()
                    for w in self._words(m.group()):
                        yield at, at + len(w), "han"
                        at += len(w)
                else:
                    yield (*m.span(), "word" if m.lastindex == 2 else "symbol")

        return _tokens(text, pieces())
