"""The index: readers, search, facets, highlighting and maintenance."""

from __future__ import annotations


from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.analyzer import Analyzer, standard_analyzer
from textloom.functions.highlight import HighlightOptions, highlight_column
from textloom.functions.scoring import BM25, Scorer
from textloom.model import DocumentMissingError, InvalidDocumentError
from textloom.operators.index_tables import BLANK, IndexTables, build, invalid_documents, last_of, terms_of
from textloom.plans.ast import Query, TermQuery
from textloom.plans.compiler import HITS, Plan
from textloom.plans.parser import parse


@dataclass(frozen=True)
class IndexConfig:
    """Default analyzer, analyzers of single fields, and the scorer. Analyzers are not stored with an index."""

    analyzer: Analyzer = field(default_factory=standard_analyzer)
    field_analyzers: dict[str, Analyzer] = field(default_factory=dict)
    bm25: Scorer = BM25()

    def with_analyzer(self, analyzer: Analyzer | None) -> "IndexConfig":
        return replace(self, analyzer=analyzer) if analyzer else self

    def with_field_analyzer(self, name: str, analyzer: Analyzer | None) -> "IndexConfig":
        return replace(self, field_analyzers=self.field_analyzers | {name: analyzer}) if analyzer and name.strip() else self

    def with_bm25(self, k1: float, b: float) -> "IndexConfig":
        return replace(self, bm25=BM25(k1, b))

    def with_scorer(self, scorer: Scorer) -> "IndexConfig":
        """Another way to score; anything that has the two parts of :class:`Scorer`."""
        return replace(self, bm25=scorer)

    def of(self, name: str | None) -> Analyzer:
        return self.field_analyzers.get(name, self.analyzer)


class SearchIndex:
    """A read-only snapshot of an index. Every write gives a new snapshot; a query sees one snapshot only."""

    def __init__(self, tables: IndexTables, config: IndexConfig | None = None):
        self.tables, self.config = tables, config or IndexConfig()
        self._numbers: tuple[int, dict[str, int]] | None = None

    @classmethod
    def of_documents(cls, documents: DataFrame, config: IndexConfig | None = None, sort: bool = False) -> "SearchIndex":
        """Index ``documents(id, fields)`` of distinct ids. Fields with null values are absent."""
        config = config or IndexConfig()
        return cls(build(documents, config.of, sorted(config.field_analyzers), sort), config)

    @classmethod
    def written(cls, documents: DataFrame, config: IndexConfig | None = None) -> "SearchIndex":
        """Like :meth:`of_documents`, sorted, with every text analysed once and every table in the shared folder."""
        config = config or IndexConfig()
        return cls(build(documents, config.of, sorted(config.field_analyzers), True, "index"), config)

    # ---- readers

    def document(self, doc_id: str) -> dict[str, str]:
        rows = self.tables.documents.where(F.col("id") == doc_id).take(1)
        if not rows:
            raise DocumentMissingError(doc_id)
        return dict(rows[0]["fields"])

    def metadata(self, doc_id: str) -> dict[str, int]:
        """Length of each field of a document."""
        self.document(doc_id)
        return {r["field"]: r["len"] for r in self.tables.doclen.where(F.col("id") == doc_id).collect()}

    def stats(self) -> tuple[int, dict[str, int]]:
        """Number of documents and total length per field; read once per snapshot."""
        if self._numbers is None:
            rows = self.tables.stats.take(1)
            self._numbers = (rows[0]["document_count"], dict(rows[0]["total_field_length"] or {})) if rows else (0, {})
        return self._numbers

    def term_info(self, name: str, term: str) -> tuple[int, int]:
        """Document frequency and total frequency, zeros for an unknown term."""
        rows = self.tables.terms.where((F.col("field") == name) & (F.col("term") == term)).take(1)
        return (rows[0]["df"], rows[0]["total_tf"]) if rows else (0, 0)

    def postings(self, name: str, term: str) -> DataFrame:
        """``id, tf, positions`` of a term, in order of id."""
        p = self.tables.postings.where((F.col("field") == name) & (F.col("term") == term))
        return p.select("id", "tf", "positions").orderBy("id")

    def terms(self, name: str, prefix: str = "") -> DataFrame:
        """``term, df, total_tf`` of the terms of a field that begin with ``prefix``, in byte order."""
        t = self.tables.terms.where((F.col("field") == name) & F.col("term").startswith(prefix))
        return t.select("term", "df", "total_tf").orderBy("term")

    def all_ids(self) -> DataFrame:
        return self.tables.documents.select("id").orderBy("id")

    # ---- search

    def hits(self, query: Query | None) -> DataFrame:
        """``id, score`` of all matches of a tree, in no order."""
        if query is None:
            return self._spark.createDataFrame([], "id string, score double")
        n, totals = self.stats()
        return Plan(self.tables, self.config.of, n, totals, self.config.bm25).hits(query)

    def search(self, query: Query | None, limit: int = 0, digits: int | None = None) -> DataFrame:
        """``id, score, explanation``: by score descending, then id; a limit of 0 or less means all.

        The explanation is filled for a single term query only. ``digits``
        rounds scores before they are ordered.
        """
        if query is None:
            return self._spark.createDataFrame([], HITS)
        rows = self.hits(query)
        if digits is not None:
            rows = rows.withColumn("score", F.round("score", digits))
        if isinstance(query, TermQuery) and query.field and query.term:
            tf = self.tables.postings.where((F.col("field") == query.field) & (F.col("term") == query.term)).select("id", "tf")
            text = F.concat(F.lit(f"{self.config.bm25.name}({query.field}:{query.term}, tf="), F.col("tf"), F.lit(")"))
            rows = rows.join(tf, "id").select("id", "score", text.alias("explanation"))
        else:
            rows = rows.select("id", "score", F.lit("").alias("explanation"))
        ordered = rows.orderBy(F.desc("score"), "id")
        return ordered.limit(limit) if limit > 0 else ordered

    def search_string(self, expression: str, default_field: str, limit: int = 0, digits: int | None = None) -> DataFrame:
        return self.search(parse(expression, default_field), limit, digits)

    def facet(self, query: Query | None, name: str, limit: int = 0) -> DataFrame:
        """``value, count`` of a stored field over all hits: by count descending, then value. Absent values do not count, empty ones do."""
        value = F.col("fields").getItem(name)
        docs = self.tables.documents.select("id", value.alias("value")).where(F.col("value").isNotNull())
        counts = docs.join(self.hits(query).select("id"), "id", "left_semi").groupBy("value").agg(F.count("*").alias("count"))
        ordered = counts.orderBy(F.desc("count"), "value")
        return ordered.limit(limit) if limit > 0 else ordered

    def highlight(self, hits: DataFrame, name: str, terms: list[str], options: HighlightOptions = HighlightOptions()) -> DataFrame:
        """``id, fragments`` for the documents of ``hits`` (normally one result page)."""
        docs = self.tables.documents.select("id", F.col("fields").getItem(name).alias("text"))
        some = docs.join(hits.select("id"), "id", "left_semi")
        return some.select("id", highlight_column(self.config.of(name), F.col("text"), terms, options).alias("fragments"))

    # ---- maintenance

    def add_batch(self, documents: DataFrame, order: str | None = None) -> "SearchIndex":
        """A snapshot with ``documents(id, fields)`` added or put in place of those with their ids.

        All documents are validated first; one that is invalid leaves everything
        as it is. Of several with one id the last in ``order`` stays (of equal
        ones the one whose entries are the greatest, nulls coming first).
        Without an order no id may repeat: rows of a table have none of their
        own, so a repeated id is refused. Only the new documents are analysed,
        and only the touched part of the dictionary is counted again.
        """
        fresh = fresh_tables(documents, order, self.config)
        return self._merged(fresh.documents.select("id"), fresh)

    def delete(self, *ids: str) -> "SearchIndex":
        """A snapshot without the documents; a blank or unknown id is an error and changes nothing."""
        return self.delete_all(self._spark.createDataFrame([(i,) for i in ids], "id string"))

    def delete_all(self, ids: DataFrame) -> "SearchIndex":
        """``delete`` of the ids of a table, of any number; repeated ones count once."""
        gone = ids.select("id").distinct()
        if not gone.where(F.col("id").isNull() | F.col("id").rlike(BLANK)).isEmpty():
            raise InvalidDocumentError("blank id")
        missing = gone.join(self.tables.documents.select("id"), "id", "left_anti").take(1)
        if missing:
            raise DocumentMissingError(missing[0]["id"])
        return self._merged(gone, None)

    def _merged(self, gone: DataFrame, fresh: IndexTables | None) -> "SearchIndex":
        t = self.tables
        ids = gone.select("id").distinct()
        keep = lambda df: df.join(ids, "id", "left_anti")
        add = lambda old, name: old.unionByName(getattr(fresh, name)) if fresh else old
        # the dictionary changes by what the removed postings held and the new ones hold
        lost = terms_of(t.postings.join(ids, "id", "left_semi")).select("field", "term", (-F.col("df")).alias("df"), (-F.col("total_tf")).alias("total_tf"))
        changes = t.terms.unionByName(lost)
        if fresh:
            changes = changes.unionByName(fresh.terms)
        terms = changes.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("total_tf").alias("total_tf")).where(F.col("df") > 0)
        documents, doclen, postings = (add(keep(getattr(t, n)), n) for n in ("documents", "doclen", "postings"))
        from textloom.operators.index_tables import stats_of

        return SearchIndex(IndexTables(documents, postings, terms, doclen, stats_of(documents, doclen)), self.config)

    def rebuild(self) -> "SearchIndex":
        """A snapshot derived anew from the stored documents with the present analyzers."""
        return SearchIndex.of_documents(self.tables.documents, self.config)

    def check(self) -> DataFrame:
        """One row ``documents, terms, postings, problems``, the last being the number of rows of :meth:`problems`."""
        t = self.tables
        n = t.doclen.select("id").distinct().agg(F.count("*").alias("documents"))
        one = n.crossJoin(t.terms.agg(F.count("*").alias("terms"))).crossJoin(t.postings.agg(F.count("*").alias("postings")))
        return one.crossJoin(self.problems().agg(F.count("*").alias("problems")))

    def problems(self) -> DataFrame:
        """A row ``kind, field, term, counted, found`` for each thing that does not agree, in no order.

        Kind ``term``: the document frequency of a dictionary entry and its
        postings. Kind ``documents``: the number of documents in the statistics
        and the documents that have lengths. A sound index gives no rows.
        """
        t = self.tables
        real = t.postings.groupBy("field", "term").agg(F.count("*").alias("n"))
        both = t.terms.select("field", "term", "df").join(real, ["field", "term"], "left")
        terms = both.select(F.lit("term").alias("kind"), "field", "term", F.col("df").alias("counted"), F.coalesce("n", F.lit(0)).alias("found"))
        n = t.doclen.select("id").distinct().agg(F.count("*").alias("found"))
        none = F.lit(None).cast("string")
        count = t.stats.crossJoin(n).select(F.lit("documents").alias("kind"), none.alias("field"), none.alias("term"), F.col("document_count").alias("counted"), "found")
        return terms.unionByName(count).where(~F.col("counted").eqNullSafe(F.col("found")))

    def cached(self) -> "SearchIndex":
        for _, df in self.tables.items():
            df.cache()
        return self

    def close(self) -> None:
        for _, df in self.tables.items():
            df.unpersist()

    @property
    def _spark(self) -> SparkSession:
        return self.tables.documents.sparkSession


def fresh_tables(documents: DataFrame, order: str | None, config: IndexConfig) -> IndexTables:
    """Tables of a batch, written; see :meth:`SearchIndex.add_batch` for what is refused and which of equal ids counts."""
    if not invalid_documents(documents).isEmpty():
        raise InvalidDocumentError("a document has a blank id, no fields or a blank field name")
    new = documents.select("id", "fields")
    if order:
        new = last_of(documents, order)
    elif twice := new.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("id").take(1):
        raise InvalidDocumentError(f"id {twice[0]['id']!r} repeats; name the column that orders its rows")
    return build(new, config.of, sorted(config.field_analyzers), write="new")


def new_index(spark: SparkSession, config: IndexConfig | None = None) -> SearchIndex:
    """An empty index."""
    return SearchIndex.of_documents(spark.createDataFrame([], "id string, fields map<string,string>"), config)


def add(index: SearchIndex, doc_id: str, fields: dict[str, str]) -> SearchIndex:
    """``add_batch`` of one document."""
    return index.add_batch(index._spark.createDataFrame([(doc_id, fields)], "id string, fields map<string,string>"))


__all__ = ["BLANK", "IndexConfig", "SearchIndex", "add", "fresh_tables", "new_index"]
