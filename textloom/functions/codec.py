"""Compact bytes of a posting, JSON of metadata, and path-safe key components."""

from __future__ import annotations

import base64
import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.model import CorruptIndexError, CorruptPostingError, Posting

_U32, _U64 = (1 << 32) - 1, (1 << 64) - 1


def _uvarint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def uvarint(self, most: int) -> int:
        value = shift = 0
        while self.at < len(self.data) and shift < 70:
            byte = self.data[self.at]
            self.at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                if value > most:
                    raise CorruptPostingError("number too large")
                return value
            shift += 7
        raise CorruptPostingError("number cut short")

    def take(self, n: int) -> bytes:
        if n > len(self.data) - self.at:
            raise CorruptPostingError("bytes cut short")
        self.at += n
        return self.data[self.at - n : self.at]


def encode_posting(p: Posting) -> bytes:
    """Length and bytes of the id, frequency, count, then the first position and the steps to each next one, all as varints."""
    name = p.doc_id.encode()
    steps = [b - a for a, b in zip((0, *p.positions), p.positions)]
    return b"".join([_uvarint(len(name)), name, *map(_uvarint, (p.frequency, len(p.positions), *steps))])


def decode_posting(data: bytes) -> Posting:
    """Inverse of :func:`encode_posting`; anything cut short, too large, left over or inconsistent is an error."""
    r = _Reader(bytes(data))
    try:
        name = r.take(r.uvarint(_U64)).decode()
    except UnicodeDecodeError as e:
        raise CorruptPostingError("id is not UTF-8") from e
    tf, count = r.uvarint(_U32), r.uvarint(_U32)
    # a position takes a byte at least, so a wrong count is found before memory is taken for it
    if count > len(r.data) - r.at or tf != count:
        raise CorruptPostingError("count does not fit")
    at, positions = 0, []
    for _ in range(count):
        at += r.uvarint(_U64)
        if at > _U32:
            raise CorruptPostingError("position too large")
        positions.append(at)
    if r.at != len(r.data):
        raise CorruptPostingError("bytes left over")
    return Posting(name, tuple(positions))


def encode_postings(doc_id: Column, positions: Column) -> Column:
    @F.pandas_udf("binary")
    def run(i: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([encode_posting(Posting(a, tuple(int(x) for x in b))) for a, b in zip(i, p)])

    return run(doc_id, positions)


def decode_postings(data: Column) -> Column:
    @F.pandas_udf("struct<id:string,tf:int,positions:array<int>>")
    def run(d: pd.Series) -> pd.DataFrame:
        got = [decode_posting(x) for x in d]
        return pd.DataFrame({"id": [g.doc_id for g in got], "tf": [g.frequency for g in got], "positions": [list(g.positions) for g in got]})

    return run(data)


def to_json(value: Any) -> bytes:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode()


def from_json(data: bytes) -> Any:
    try:
        return json.loads(data)
    except ValueError as e:
        raise CorruptIndexError("metadata is not JSON") from e


def key_part(text: str) -> str:
    """One component of a path-like key: base64 with URL-safe signs and no padding."""
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def key_part_text(part: str) -> str:
    try:
        return base64.b64decode(part + "=" * (-len(part) % 4), altchars=b"-_", validate=True).decode()
    except ValueError as e:
        raise CorruptIndexError(f"bad key component {part!r}") from e


def key_parts(text: Column) -> Column:
    """Column form of :func:`key_part`."""
    return F.rtrim(F.translate(F.base64(F.encode(text, "UTF-8")), "+/\n\r", "-_"), F.lit("="))
