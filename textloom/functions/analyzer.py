"""Analysis chains."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.filters import LowercaseFilter, StopWordFilter, TokenFilter
from textloom.functions.tokenizers import StandardTokenizer, Tokenizer, token_arrays
from textloom.model import Token


class Analyzer:
    """A tokenizer and filters applied in order. No tokenizer gives no tokens; a filter that is None is skipped."""

    def __init__(self, tokenizer: Tokenizer | None, filters: Sequence[TokenFilter | None] = ()):
        self.tokenizer = tokenizer
        self.filters = tuple(f for f in filters if f is not None)

    def analyze(self, text: str) -> list[Token]:
        """Tokens of one short text, on the driver."""
        tokens = self.tokenizer.scan(text) if self.tokenizer else []
        for f in self.filters:
            tokens = f.apply(tokens)
        return tokens

    def column(self, text: Column, types: bool = False) -> Column:
        """``ARRAY<STRUCT<term, position[, type]>>``; native where the tokenizer is."""
        if not self.tokenizer:
            empty = F.array().cast("array<struct<term:string,position:int" + (",type:string>>" if types else ">>"))
            return empty
        tokens = self.tokenizer.column(text, types)
        for f in self.filters:
            tokens = f.column(tokens)
        return tokens

    def full(self, text: Column) -> Column:
        """Tokens with byte offsets, by Arrow batches."""
        return token_arrays(self.analyze, text)

    def stream(self, text: str) -> "TokenStream":
        return TokenStream(self, text)


class TokenStream:
    """Cursor over the tokens of one text: ``next`` moves, ``token`` is None outside, ``reset`` starts on a new text."""

    def __init__(self, analyzer: Analyzer, text: str):
        self._analyzer = analyzer
        self.reset(text)

    def reset(self, text: str) -> None:
        self._tokens = self._analyzer.analyze(text)
        self._at = -1

    def next(self) -> bool:
        self._at = min(self._at + 1, len(self._tokens))
        return self._at < len(self._tokens)

    @property
    def token(self) -> Token | None:
        return self._tokens[self._at] if 0 <= self._at < len(self._tokens) else None

    def __iter__(self) -> Iterator[Token]:
        while self.next():
            yield self.token


def standard_analyzer() -> Analyzer:
    """Standard tokenizer, lower case, English stop words; no stemmer."""
    return Analyzer(StandardTokenizer(), [LowercaseFilter(), StopWordFilter()])


def field_tokens(documents: DataFrame, analyzer_of, fields: Sequence[str] = (), types: bool = False) -> DataFrame:
    """``id, field, tokens`` for every field of every document; fields with null values are absent.

    ``analyzer_of(field)`` gives the analyzer; ``fields`` names those with one
    of their own, all others share the default.
    """
    flat = documents.select("id", F.explode("fields").alias("field", "text")).where(F.col("text").isNotNull())
    tokens = analyzer_of(None).column(F.col("text"), types)
    case = None
    for f in fields:
        own = analyzer_of(f).column(F.col("text"), types)
        case = F.when(F.col("field") == f, own) if case is None else case.when(F.col("field") == f, own)
    return flat.select("id", "field", (case.otherwise(tokens) if case is not None else tokens).alias("tokens"))
