"""Highlighted fragments of a text."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.analyzer import Analyzer
from textloom.model import FRAGMENTS

# HTML escapes.
_ESCAPES = {"&": "&amp;", "'": "&#39;", "<": "&lt;", ">": "&gt;", '"': "&#34;"}


@dataclass(frozen=True)
class HighlightOptions:
    """Tags, fragment size in bytes, number of fragments; only the text is escaped, never the tags.

    Empty tags and sizes below 1 mean the defaults.
    """

    pre_tag: str = "<em>"
    post_tag: str = "</em>"
    fragment_size: int = 160
    max_fragments: int = 1
    escape_html: bool = True

    @classmethod
    def unset(cls) -> "HighlightOptions":
        """Options of which nothing is set: default tags and sizes, but no escapes."""
        return cls("", "", 0, 0, False)

    def filled(self) -> "HighlightOptions":
        return replace(
            self,
            pre_tag=self.pre_tag or "<em>",
            post_tag=self.post_tag or "</em>",
            fragment_size=self.fragment_size if self.fragment_size > 0 else 160,
            max_fragments=self.max_fragments if self.max_fragments > 0 else 1,
        )


def _on_sign(raw: bytes, at: int, step: int) -> int:
    """Move ``at`` by ``step`` until it lies on the first byte of a character or at an end."""
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += step
    return at


def _window(size: int, total: int, first: int, last: int) -> tuple[int, int]:
    """A window of ``size`` bytes around the matches: centred, then moved inside the text, never cutting them."""
    start = max(0, first - max(0, size - (last - first)) // 2)
    end = max(start + size, last)
    return (max(0, total - size), total) if end > total else (start, end)


def highlight(analyzer: Analyzer, text: str | None, terms: Iterable[str], options: HighlightOptions = HighlightOptions()) -> list[dict]:
    """``[{text, start, end}]`` of the fragments around the tokens that are among the analysed ``terms``.

    Offsets are UTF-8 bytes. Matches at most a fragment apart share a fragment.
    No text, no terms or no match give no fragments.
    """
    wanted = {t.term for term in terms for t in analyzer.analyze(term)}
    if not text or not wanted:
        return []
    o = options.filled()
    found = sorted((t.start_offset, t.end_offset) for t in analyzer.analyze(text) if t.term in wanted)
    groups: list[list[int]] = []
    for a, b in found:
        if groups and a - groups[-1][1] <= o.fragment_size:
            groups[-1][1] = b
        else:
            groups.append([a, b])
    raw = text.encode()

    def show(a: int, b: int) -> str:
        s = raw[a:b].decode()
        return "".join(_ESCAPES.get(c, c) for c in s) if o.escape_html else s

    out = []
    for first, last in groups[: o.max_fragments]:
        start, end = _window(o.fragment_size, len(raw), first, last)
        start, end = _on_sign(raw, start, -1), _on_sign(raw, end, 1)
        parts, at = [], start
        for a, b in found:
            if a >= at and b <= end:
                parts += [show(at, a), o.pre_tag, show(a, b), o.post_tag]
                at = b
        parts.append(show(at, end))
        out.append({"text": "".join(parts), "start": start, "end": end})
    return out


def highlight_column(analyzer: Analyzer, text: Column, terms: list[str], options: HighlightOptions = HighlightOptions()) -> Column:
    """``ARRAY<STRUCT<text, start, end>>`` by Arrow batches; meant for the few texts of a result page."""

    @F.pandas_udf(FRAGMENTS)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: highlight(analyzer, t, terms, options) if isinstance(t, str) else [])

    return run(text)
