"""Okapi BM25 as a column and as a plain function."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class Scorer:
    """How much a term says about a document. ``name`` begins an explanation."""

    name = "score"

    def column(self, tf: Column, df: Column, n: float, dl: Column, avgdl: Column) -> Column:
        """From the term's frequency in the document, the documents with it, all documents, the field's length and its mean length."""
        raise NotImplementedError


@dataclass(frozen=True)
class BM25(Scorer):
    """``k1`` not above 0 counts as 1.2, ``b`` outside 0..1 as 0.75."""

    k1: float = 1.2
    b: float = 0.75
    name = "BM25"

    def params(self) -> tuple[float, float]:
        return (self.k1 if self.k1 > 0 else 1.2), (self.b if 0 <= self.b <= 1 else 0.75)

    def score(self, tf: float, df: float, n: float, dl: float, avgdl: float) -> float:
        if tf <= 0 or df <= 0 or n <= 0:
            return 0.0
        k1, b = self.params()
        avgdl = avgdl if avgdl > 0 else 1.0
        idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
        return idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * dl / avgdl))

    def column(self, tf: Column, df: Column, n: float, dl: Column, avgdl: Column) -> Column:
        """As ``score``; ``n`` and the statistics are literals of the opened index."""
        k1, b = self.params()
        avgdl = F.when(avgdl > 0, avgdl).otherwise(F.lit(1.0))
        idf = F.ln(F.lit(1.0) + (F.lit(float(n)) - df + F.lit(0.5)) / (df + F.lit(0.5)))
        s = idf * (tf * F.lit(k1 + 1)) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * dl / avgdl))
        return F.when((tf > 0) & (df > 0) & F.lit(n > 0), s).otherwise(F.lit(0.0))
