"""From documents to the tables of an index."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.analyzer import Analyzer, field_tokens
from textloom.functions.patterns import WHITE_SPACE
from textloom.runtime import materialize

BLANK = f"^[{WHITE_SPACE}]*$"


@dataclass
class IndexTables:
    """``documents``, ``postings`` (with the length ``dl`` of their field), ``terms``, ``doclen`` and the one-row ``stats``."""

    documents: DataFrame
    postings: DataFrame
    terms: DataFrame
    doclen: DataFrame
    stats: DataFrame

    NAMES = ("documents", "postings", "terms", "doclen", "stats")

    def items(self):
        return [(n, getattr(self, n)) for n in self.NAMES]


def _invalid() -> Column:
    blank_name = F.exists(F.map_keys("fields"), lambda k: k.rlike(BLANK))
    bad = F.col("id").isNull() | F.col("id").rlike(BLANK) | F.col("fields").isNull() | (F.size("fields") == 0) | blank_name
    return F.coalesce(bad, F.lit(True))


def invalid_documents(documents: DataFrame) -> DataFrame:
    """Documents with a blank or null id, without fields, or with a blank field name."""
    return documents.where(_invalid())


def valid_documents(documents: DataFrame) -> DataFrame:
    """All other documents."""
    return documents.where(~_invalid())


def postings_of(tokens: DataFrame, sort: bool = False) -> DataFrame:
    """``field, term, id, tf, positions, dl`` from ``id, field, tokens``.

    The length counts all tokens, those with an empty term included, which get
    no posting. With ``sort`` the one exchange is by ranges of (field, term,
    id), which is the order in which the table is written, and the grouping
    needs no other; a term that holds most rows spans many ranges.
    """
    flat = tokens.select("id", "field", F.size("tokens").alias("dl"), F.explode("tokens").alias("t"))
    flat = flat.select("field", F.col("t.term").alias("term"), "id", F.col("t.position").alias("position"), "dl").where(F.col("term") != "")
    if sort:
        flat = flat.repartitionByRange("field", "term", "id")
    grouped = flat.groupBy("field", "term", "id").agg(
        F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"), F.first("dl").alias("dl")
    )
    return grouped.sortWithinPartitions("field", "term", "id") if sort else grouped


def terms_of(postings: DataFrame) -> DataFrame:
    """``field, term, df, total_tf``; a hot term is summed inside each partition first."""
    return postings.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("total_tf"))


def stats_of(documents: DataFrame, doclen: DataFrame) -> DataFrame:
    """One row: the number of documents and the total length of each field."""
    per = doclen.groupBy("field").agg(F.sum("len").cast("long").alias("total"))
    total = per.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "total")))).alias("total_field_length"))
    return documents.agg(F.count("*").alias("document_count")).crossJoin(total)


def last_of(documents: DataFrame, order: str) -> DataFrame:
    """``id, fields`` of each id's last row in ``order``; of equal ones the one with the greatest entries."""
    # a map has no order of its own, so it travels as sorted entries
    rows = documents.select("id", F.col(order).alias("o"), F.array_sort(F.map_entries("fields")).alias("e"))
    last = rows.groupBy("id").agg(F.max(F.struct("o", "e")).alias("d"))
    return last.select("id", F.map_from_entries("d.e").alias("fields"))


def build(documents: DataFrame, analyzer_of: Callable[[str | None], Analyzer], fields: Sequence[str] = (), sort: bool = False, write: str = "") -> IndexTables:
    """All tables of ``documents(id, fields)``, whose ids are distinct and valid.

    With ``write``, a prefix of names, texts are analysed once: their tokens
    are written first and all else is derived from written tables.
    """
    if not write:
        tokens = field_tokens(documents, analyzer_of, fields)
        doclen = tokens.select("id", "field", F.size("tokens").alias("len"))
        postings = postings_of(tokens, sort)
        return IndexTables(documents, postings, terms_of(postings), doclen, stats_of(documents, doclen))
    documents = materialize(documents, f"{write}-documents")
    tokens = materialize(field_tokens(documents, analyzer_of, fields), f"{write}-tokens")
    doclen = materialize(tokens.select("id", "field", F.size("tokens").alias("len")), f"{write}-doclen")
    postings = materialize(postings_of(tokens, sort), f"{write}-postings")
    terms = terms_of(postings)
    if sort:
        terms = terms.repartitionByRange("field", "term").sortWithinPartitions("field", "term")
    terms = materialize(terms, f"{write}-terms")
    return IndexTables(documents, postings, terms, doclen, materialize(stats_of(documents, doclen), f"{write}-stats"))
