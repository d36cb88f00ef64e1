"""The query tree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Query:
    """Base of all nodes. Leaves of other makes derive from :class:`TermsQuery`."""


class TermsQuery(Query):
    """A leaf of the user's own: which terms of the dictionary it stands for, and with what weight.

    ``field`` names its field. ``matching`` gets the dictionary of that field,
    ``field, term, df``, and returns its choice with a column ``weight``; the
    score of a document is the sum of the weighted scores of the terms chosen.
    ``scan`` may say in a condition on ``term`` alone what of the postings has
    to be read at most, so that it is pushed into their scan.
    """

    field: str

    def matching(self, terms: DataFrame) -> DataFrame:
        raise NotImplementedError

    def scan(self) -> Column:
        return F.lit(True)


@dataclass(frozen=True)
class TermQuery(Query):
    """Exactly this term, not analysed. An empty field or term matches nothing."""

    field: str
    term: str


@dataclass(frozen=True)
class MatchQuery(Query):
    """The distinct analysed terms of a text: any of them, or all with ``operator='and'``."""

    field: str
    text: str
    operator: str = "or"


@dataclass(frozen=True)
class PhraseQuery(Query):
    """The analysed terms in order, at the distances they have in the text, up to ``slop`` positions further apart in sum."""

    field: str
    text: str
    slop: int = 0


@dataclass(frozen=True)
class PrefixQuery(Query):
    """All terms that begin with the first analysed token, or with the text as it stands where it has none."""

    field: str
    prefix: str


@dataclass(frozen=True)
class FuzzyQuery(Query):
    """All terms within an edit distance of the first analysed token; 0 or less means 1, more than 3 means 3."""

    field: str
    term: str
    max_edits: int = 1

    @property
    def edits(self) -> int:
        return 1 if self.max_edits <= 0 else min(self.max_edits, 3)


@dataclass(frozen=True)
class BooleanQuery(Query):
    """All of ``must``, none of ``must_not``; ``should`` adds score, and is needed where there is no ``must``.

    With ``must_not`` alone all other documents match, with score 0. Nothing at
    all matches nothing.
    """

    must: tuple[Query, ...] = ()
    should: tuple[Query, ...] = ()
    must_not: tuple[Query, ...] = ()

    def __post_init__(self):
        for name in ("must", "should", "must_not"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
