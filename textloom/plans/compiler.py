"""A query tree as one DataFrame plan: one scan of the postings, one exchange.

Every leaf becomes a few term rows; the postings of all of them are read once,
scored, and grouped by document with one conditional sum per leaf; the Boolean
tree is then a column expression over those sums, in which null means that the
leaf does not match.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.analyzer import Analyzer
from textloom.functions.scoring import BM25
from textloom.operators.index_tables import IndexTables
from textloom.plans.ast import BooleanQuery, FuzzyQuery, MatchQuery, PhraseQuery, PrefixQuery, Query, TermQuery, TermsQuery

#: Score of a phrase relative to the sum of its terms.
PHRASE_BOOST = 1.5

#: Up to so many terms, what a fuzzy leaf finds in the dictionary becomes literals, which prune the scan of the
#: postings. Beyond, the expansion stays a join.
FUZZY_LITERALS = 4096

HITS = "id string, score double, explanation string"


@dataclass
class _Leaf:
    number: int
    #: Static term rows (slot, term, weight), or none for an expansion over the dictionary.
    field: str
    terms: list[tuple[int, str, float]] = field(default_factory=list)
    expand: Callable[[DataFrame], DataFrame] | None = None
    scan: Column | None = None
    needed: int = 0
    gaps: list[int] = field(default_factory=list)
    slop: int = 0
    phrase: bool = False

    @property
    def empty(self) -> bool:
        return not self.terms and self.expand is None


class Plan:
    """Compiles one tree for one index."""

    def __init__(self, tables: IndexTables, analyzer_of: Callable[[str | None], Analyzer], n: int, totals: dict[str, int], bm25: BM25):
        self.tables, self.analyzer_of, self.n, self.totals, self.bm25 = tables, analyzer_of, n, totals, bm25
        self.leaves: list[_Leaf] = []

    # ---- leaves

    def _leaf(self, q: Query) -> int:
        if not hasattr(q, "field"):
            raise TypeError(f"not a query: {q!r}")
        number = len(self.leaves)
        leaf = _Leaf(number, q.field)
        self.leaves.append(leaf)
        if isinstance(q, TermsQuery):
            leaf.expand, leaf.scan = q.matching, q.scan()
            return number
        if isinstance(q, TermQuery):
            if q.field and q.term:
                leaf.terms = [(0, q.term, 1.0)]
            return number
        text = q.text if isinstance(q, (MatchQuery, PhraseQuery)) else q.prefix if isinstance(q, PrefixQuery) else q.term
        tokens = self.analyzer_of(q.field).analyze(text)
        if isinstance(q, MatchQuery):
            distinct = list(dict.fromkeys(t.term for t in tokens))
            leaf.terms = [(i, t, 1.0) for i, t in enumerate(distinct)]
            leaf.needed = len(distinct) if q.operator == "and" else 0
        elif isinstance(q, PhraseQuery):
            leaf.terms = [(i, t.term, PHRASE_BOOST) for i, t in enumerate(tokens)]
            leaf.gaps = [max(1, b.position - a.position) for a, b in zip(tokens, tokens[1:])]
            leaf.slop, leaf.phrase, leaf.needed = q.slop, True, len(tokens)
        elif isinstance(q, PrefixQuery):
            start = tokens[0].term if tokens else q.prefix
            leaf.scan = F.col("term").startswith(start)
            leaf.expand = lambda terms: terms.where(F.col("term").startswith(start)).withColumn("weight", F.lit(1.0))
        elif isinstance(q, FuzzyQuery):
            if tokens:
                expand = self._fuzzy(tokens[0].term, q.edits)
                dictionary = self.tables.terms.select("field", "term", "df").where(F.col("field") == q.field)
                near = expand(dictionary).select("term", "weight").limit(FUZZY_LITERALS + 1).collect()
                if len(near) <= FUZZY_LITERALS:
                    leaf.terms = [(0, r["term"], r["weight"]) for r in near]
                else:
                    leaf.expand, leaf.scan = expand, self._near(tokens[0].term, q.edits)
        else:
            raise TypeError(f"not a query: {q!r}")
        return number

    @staticmethod
    def _near(word: str, edits: int) -> Column:
        size = F.char_length("term")
        return size.between(len(word) - edits, len(word) + edits)

    def _fuzzy(self, word: str, edits: int) -> Callable[[DataFrame], DataFrame]:
        def expand(terms: DataFrame) -> DataFrame:
            distance = F.levenshtein(F.col("term"), F.lit(word), edits)
            near = terms.where(self._near(word, edits)).withColumn("_d", distance).where("_d >= 0")
            return near.withColumn("weight", F.lit(1.0) / (F.col("_d") + 1)).drop("_d")

        return expand

    # ---- tree

    def _tree(self, q: Query) -> Callable[[Callable[[int], Column]], Column]:
        """The score of a node as a function of the scores of the leaves."""
        if not isinstance(q, BooleanQuery):
            k = self._leaf(q)
            return lambda leaf: leaf(k)
        must, should, never = ([self._tree(c) for c in part] for part in (q.must, q.should, q.must_not))

        def node(leaf: Callable[[int], Column]) -> Column:
            m, s, n = ([f(leaf) for f in part] for part in (must, should, never))
            total = F.lit(0.0)
            for x in m:
                total = total + x
            for x in s:
                total = total + F.coalesce(x, F.lit(0.0))
            hit = F.lit(bool(m or s or n))
            for x in m:
                hit = hit & x.isNotNull()
            if not m and s:
                some = F.lit(False)
                for x in s:
                    some = some | x.isNotNull()
                hit = hit & some
            for x in n:
                hit = hit & x.isNull()
            return F.when(hit, total)

        return node

    @staticmethod
    def _needs_all(q: Query) -> bool:
        """Whether a document without any term of the query can match."""
        if not isinstance(q, BooleanQuery):
            return False
        if q.must:
            hit = all(map(Plan._needs_all, q.must))
        elif q.should:
            hit = any(map(Plan._needs_all, q.should))
        else:
            hit = bool(q.must_not)
        return hit and not any(map(Plan._needs_all, q.must_not))

    # ---- rows

    def _matched_terms(self, spark) -> DataFrame:
        """``leaf, slot, field, term, weight, df`` of all dictionary terms that the leaves ask for."""
        parts = []
        static = [(f.number, slot, f.field, term, w) for f in self.leaves for slot, term, w in f.terms]
        dictionary = self.tables.terms.select("field", "term", "df")
        if static:
            rows = self._literals(spark, static)
            some = dictionary.where(self._pairs([(r[2], r[3]) for r in static]))
            # as many rows as the query has terms
            parts.append(some.join(F.broadcast(rows), ["field", "term"]).select("leaf", "slot", "field", "term", "weight", "df"))
        for leaf in self.leaves:
            if leaf.expand:
                found = leaf.expand(dictionary.where(F.col("field") == leaf.field))
                parts.append(found.select(F.lit(leaf.number).alias("leaf"), F.lit(0).alias("slot"), "field", "term", "weight", "df"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @staticmethod
    def _literals(spark, static: list[tuple[int, int, str, str, float]]) -> DataFrame:
        """The static term rows: a constant of the plan where they are few, else a local table."""
        names = ("leaf", "slot", "field", "term", "weight")
        if len(static) > 64:
            return spark.createDataFrame(static, "leaf int, slot int, field string, term string, weight double")
        return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in static])))

    @staticmethod
    def _pairs(pairs: list[tuple[str, str]]) -> Column:
        """``field`` and ``term`` among the pairs, in a form that reaches the scan."""
        by: dict[str, set[str]] = {}
        for f, t in pairs:
            by.setdefault(f, set()).add(t)
        cond = None
        for f, ts in sorted(by.items()):
            c = (F.col("field") == f) & F.col("term").isin(sorted(ts))
            cond = c if cond is None else cond | c
        return cond

    def _scan(self) -> DataFrame:
        cond = None
        static = [(f.field, t) for f in self.leaves for _, t, _ in f.terms]
        if static:
            cond = self._pairs(static)
        for leaf in self.leaves:
            if leaf.expand:
                c = (F.col("field") == leaf.field) & leaf.scan
                cond = c if cond is None else cond | c
        return self.tables.postings.where(cond)

    def hits(self, q: Query) -> DataFrame:
        """``id, score`` of all matching documents, in no order."""
        tree = self._tree(q)
        spark = self.tables.documents.sparkSession
        live = [leaf for leaf in self.leaves if not leaf.empty]
        scores: dict[int, Column] = {leaf.number: F.lit(None).cast("double") for leaf in self.leaves}
        grouped = None
        if live:
            phrases = [leaf for leaf in live if leaf.phrase and len(leaf.terms) > 1]
            cols = ["field", "term", "id", "tf", "dl", *(["positions"] if phrases else [])]
            rows = self._scan().select(*cols).join(self._matched_terms(spark), ["field", "term"])
            s = F.col("weight") * self.bm25.column(F.col("tf"), F.col("df"), self.n, F.col("dl"), self._mean_length())
            aggs = []
            for leaf in live:
                on = F.col("leaf") == leaf.number
                aggs.append(F.sum(F.when(on, s)).alias(f"s{leaf.number}"))
                if leaf.needed > 1:
                    aggs.append(F.count(F.when(on, 1)).alias(f"c{leaf.number}"))
                if leaf in phrases:
                    aggs += [F.max(F.when(on & (F.col("slot") == slot), F.col("positions"))).alias(f"p{leaf.number}_{slot}") for slot, _, _ in leaf.terms]
            grouped = rows.groupBy("id").agg(*aggs)
            for leaf in live:
                value = F.col(f"s{leaf.number}")
                if leaf.needed > 1:
                    value = F.when(F.col(f"c{leaf.number}") == leaf.needed, value)
                if leaf in phrases:
                    value = F.when(self._in_order(leaf), value)
                scores[leaf.number] = value
        if self._needs_all(q):
            ids = self.tables.documents.select("id")
            grouped = ids if grouped is None else ids.join(grouped, "id", "left")
        if grouped is None:
            return spark.createDataFrame([], "id string, score double")
        return grouped.select("id", tree(scores.__getitem__).alias("score")).where(F.col("score").isNotNull())

    def _mean_length(self) -> Column:
        """Mean length of the row's field over all documents, those without it included."""
        case = None
        for f in sorted({leaf.field for leaf in self.leaves}):
            value = F.lit(self.totals.get(f, 0) / self.n if self.n else 0.0)
            case = F.when(F.col("field") == f, value) if case is None else case.when(F.col("field") == f, value)
        return case

    @staticmethod
    def _in_order(leaf: _Leaf) -> Column:
        """Some start whose greedily earliest continuation is at most ``slop`` positions longer than the phrase."""
        places = [F.col(f"p{leaf.number}_{slot}") for slot, _, _ in leaf.terms]
        span = sum(leaf.gaps)
        if leaf.slop == 0:
            # every other term at its exact distance
            offsets, at = [], 0
            for g in leaf.gaps:
                at += g
                offsets.append(at)

            def exact(start: Column) -> Column:
                ok = F.lit(True)
                for p, o in zip(places[1:], offsets):
                    ok = ok & F.array_contains(p, start + o)
                return ok

            return F.coalesce(F.exists(places[0], exact), F.lit(False))
        steps = F.array(*[F.struct(F.lit(g).alias("gap"), p.alias("at")) for g, p in zip(leaf.gaps, places[1:])])

        def reach(start: Column) -> Column:
            end = F.aggregate(steps, start, lambda acc, x: F.array_min(F.filter(x["at"], lambda q: q >= acc + x["gap"])))
            return F.coalesce(end - start - span <= leaf.slop, F.lit(False))

        return F.coalesce(F.exists(places[0], reach), F.lit(False))
