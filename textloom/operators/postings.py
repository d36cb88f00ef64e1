"""Set operations and cursors over posting lists ``id, tf, positions`` of one term."""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.model import Posting


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` whose id occurs in ``right``."""
    return left.join(right.select("id").distinct(), "id", "left_semi")


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both; where an id is in both, the row of ``left``."""
    return left.unionByName(right.join(left.select("id"), "id", "left_anti"))


def skip_to(postings: DataFrame, target: str) -> DataFrame:
    """Postings from the first id not below ``target`` on, in order of id; the filter reaches the scan."""
    return postings.where(F.col("id") >= target).orderBy("id")


class SortedCursor:
    """Forward cursor over sorted keys: ``next`` steps, ``skip_to`` jumps to the first key not below the target, or stays."""

    def __init__(self, keys: Sequence[str]):
        self._keys = sorted(keys)
        self._at = -1

    def next(self) -> bool:
        self._at = min(self._at + 1, len(self._keys))
        return self.valid

    @property
    def valid(self) -> bool:
        return 0 <= self._at < len(self._keys)

    @property
    def key(self) -> str | None:
        return self._keys[self._at] if self.valid else None

    def skip_to(self, target: str) -> bool:
        self._at = bisect.bisect_left(self._keys, target, max(self._at, 0))
        return self.valid


class PostingCursor(SortedCursor):
    """The same over postings, by document id."""

    def __init__(self, postings: Sequence[Posting]):
        self._by_id = {p.doc_id: p for p in postings}
        super().__init__(list(self._by_id))

    @property
    def posting(self) -> Posting | None:
        return self._by_id[self.key] if self.valid else None

    def __iter__(self) -> Iterator[Posting]:
        while self.next():
            yield self.posting
