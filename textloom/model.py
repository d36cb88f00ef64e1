"""Errors, value types and table schemas."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import types as T


class TextloomError(Exception):
    """Base of all errors raised here."""


class InvalidDocumentError(TextloomError):
    """An id is blank, a document has no fields, or a field name is blank."""


class DocumentMissingError(TextloomError):
    """No document has this id."""


class CorruptIndexError(TextloomError):
    """Stored metadata cannot be read."""


class InvalidQueryError(TextloomError):
    """A query string does not follow the grammar."""


class CorruptPostingError(TextloomError):
    """Encoded bytes are no posting."""


class KeyNotFoundError(TextloomError):
    """A store has no such key."""


class StoreClosedError(TextloomError):
    """The store was closed."""


class Token(NamedTuple):
    """One token; offsets are UTF-8 bytes, the end being exclusive."""

    term: str
    position: int
    start_offset: int
    end_offset: int
    type: str


@dataclass(frozen=True)
class Posting:
    """Occurrences of a term in one document, positions ascending."""

    doc_id: str
    positions: tuple[int, ...]

    def __post_init__(self):
        object.__setattr__(self, "positions", tuple(sorted(self.positions)))

    @property
    def frequency(self) -> int:
        return len(self.positions)


TOKEN = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("start_offset", T.IntegerType()),
        T.StructField("end_offset", T.IntegerType()),
        T.StructField("type", T.StringType()),
    ]
)
DOCUMENTS = T.StructType([T.StructField("id", T.StringType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType()))])
POSTINGS = "field string, term string, id string, tf int, positions array<int>, dl int"
TERMS = "field string, term string, df bigint, total_tf bigint"
DOCLEN = "id string, field string, len int"
STATS = "document_count bigint, total_field_length map<string,bigint>"
FRAGMENTS = T.ArrayType(
    T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
)
