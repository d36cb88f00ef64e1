import random

import pytest

from textloom import BM25, BooleanQuery, FuzzyQuery, IndexConfig, MatchQuery, PhraseQuery, PrefixQuery, SearchIndex, SimpleTokenizer, Analyzer, TermQuery, parse, standard_analyzer
from textloom.model import InvalidQueryError

CORPUS = {
    "go": {"title": "Learning Go", "content": "Go is a fast programming language", "category": "book"},
    "db": {"title": "Distributed Database", "content": "A distributed database system is reliable", "category": "book"},
    "web": {"title": "Golang Web", "content": "Build a distributed system with golang", "category": "article"},
}
DOC = "id string, fields map<string,string>"


def index_of(spark, docs, config=None):
    return SearchIndex.of_documents(spark.createDataFrame(list(docs.items()), DOC), config)


@pytest.fixture(scope="module")
def three(spark):
    return index_of(spark, CORPUS).cached()


def scores(df):
    return {r["id"]: round(r["score"], 6) for r in df.collect()}


C = "content"
CASES = [
    (TermQuery(C, "distributed"), {"db": 0.470004, "web": 0.470004}),
    (MatchQuery(C, "distributed golang", "and"), {"web": 1.450833}),
    (MatchQuery(C, "distributed golang"), {"web": 1.450833, "db": 0.470004}),
    (PhraseQuery(C, "distributed system"), {"web": 1.410011}),
    (PhraseQuery(C, "distributed system", 1), {"db": 1.410011, "web": 1.410011}),
    (PrefixQuery("title", "go"), {"go": 0.980829, "web": 0.980829}),
    (FuzzyQuery(C, "gloang", 2), {"web": 0.326943}),
    (BooleanQuery(must=[TermQuery(C, "distributed")], must_not=[TermQuery(C, "database")]), {"web": 0.470004}),
    (BooleanQuery(), {}),
    (TermQuery("", "x"), {}),
    (TermQuery(C, ""), {}),
    (MatchQuery(C, "the is a"), {}),
    (PhraseQuery(C, "is"), {}),
    (FuzzyQuery(C, "is"), {}),
    (PhraseQuery(C, "golang"), {"web": round(1.5 * 0.980829, 6)}),
    (PrefixQuery(C, "A"), {}),
]


@pytest.mark.parametrize("query,want", CASES)
def test_cases(three, query, want):
    got = scores(three.search(query))
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=2e-6)


def test_strings(three):
    assert scores(three.search_string('content:"distributed system" OR title:database', C)) == {"web": 1.410011, "db": 0.980829}
    assert scores(three.search_string("content:distributed AND NOT content:database", C)) == {"web": 0.470004}
    assert scores(three.search_string("  ", C)) == {}
    assert set(scores(three.search_string("NOT NOT distributed", C)).values()) == {0.0}


def test_order_limit_explanation(three):
    rows = three.search(TermQuery(C, "distributed")).collect()
    assert [r["id"] for r in rows] == ["db", "web"]
    assert rows[0]["explanation"] == "BM25(content:distributed, tf=1)"
    assert [r["id"] for r in three.search(TermQuery(C, "distributed"), 1).collect()] == ["db"]
    assert three.search(BooleanQuery(should=[TermQuery(C, "go")])).first()["explanation"] == ""
    assert three.search(None).count() == 0


def test_readers(three):
    assert three.stats() == (3, {"title": 6, "content": 12, "category": 3})
    assert three.term_info(C, "distributed") == (2, 2) and three.term_info(C, "nothing") == (0, 0)
    assert three.metadata("go") == {"title": 2, "content": 4, "category": 1}
    assert [r["term"] for r in three.terms("title", "go").collect()] == ["go", "golang"]
    assert [r["id"] for r in three.all_ids().collect()] == ["db", "go", "web"]
    assert [tuple(r) for r in three.postings(C, "system").collect()] == [("db", 1, [3]), ("web", 1, [3])]


def test_facet_and_highlight(three):
    assert [tuple(r) for r in three.facet(MatchQuery(C, "distributed"), "category").collect()] == [("article", 1), ("book", 1)]
    assert three.facet(MatchQuery(C, "distributed"), "absent").count() == 0
    best = three.search(TermQuery(C, "distributed"), 1)
    got = three.highlight(best, C, ["Distributed"]).collect()
    assert got[0]["fragments"][0]["text"] == "A <em>distributed</em> database system is reliable"


def test_gap(spark):
    i = index_of(spark, {"gap": {C: "go is fast"}, "adjacent": {C: "go fast"}})
    assert scores(i.search(PhraseQuery(C, "go is fast"))).keys() == {"gap"}
    assert scores(i.search(PhraseQuery(C, "go fast"))).keys() == {"adjacent"}
    assert scores(i.search(PhraseQuery(C, "go fast", 1))) == {"gap": 0.546965, "adjacent": 0.546965}


def test_bm25():
    b = BM25()
    got = [b.score(1, 2, 100, 10, 10), b.score(4, 2, 100, 10, 10), b.score(1, 90, 100, 10, 10)]
    assert [round(x, 6) for x in got] == [3.69883, 6.259558, 0.109771]
    assert BM25(0, 2).params() == (1.2, 0.75) and BM25(2, 0).params() == (2, 0)
    assert b.score(0, 1, 1, 1, 1) == b.score(1, 0, 1, 1, 1) == b.score(1, 1, 0, 1, 1) == 0


def test_empty_index_and_empty_fields(spark):
    empty = index_of(spark, {"a": {C: ""}})
    assert empty.stats() == (1, {C: 0}) and scores(empty.search(MatchQuery(C, "x"))) == {}
    assert scores(empty.search(BooleanQuery(must_not=[TermQuery(C, "x")]))) == {"a": 0.0}
    none = SearchIndex.of_documents(spark.createDataFrame([], DOC))
    assert none.stats()[0] == 0 and none.search(MatchQuery(C, "x y")).count() == 0


def test_field_analyzer(spark):
    config = IndexConfig().with_field_analyzer("title", Analyzer(SimpleTokenizer()))
    i = index_of(spark, {"a": {"title": "Go-Lang", C: "Go-Lang"}}, config)
    assert [r["term"] for r in i.terms("title").collect()] == ["Go", "Lang"]
    assert [r["term"] for r in i.terms(C).collect()] == ["go-lang"]


@pytest.mark.parametrize("text", ["title:golang", 'content:"distributed system"', "title:go* AND NOT content:legacy", "(go OR database) AND fast"])
def test_accepted(text):
    assert parse(text, C) is not None


@pytest.mark.parametrize("text", ['"unclosed', "field:", "(go OR db", ":x", "AND", "a AND", "NOT", "a )", "title:(a OR b)", 'x:"', "()", 'a" b'])
def test_refused(text):
    with pytest.raises(InvalidQueryError):
        parse(text, C)


def test_tree_shapes():
    m = lambda t, f=C: MatchQuery(f, t)
    assert parse("a b AND c", C) == BooleanQuery(should=[m("a"), BooleanQuery(must=[m("b"), m("c")])])
    assert parse("a OR b c", C) == BooleanQuery(should=[BooleanQuery(should=[m("a"), m("b")]), m("c")])
    assert parse("a NOT b", C) == BooleanQuery(should=[m("a"), BooleanQuery(must_not=[m("b")])])
    assert parse("a and Or_x", C) == BooleanQuery(must=[m("a"), m("Or_x")])
    assert parse('"AND"', C) == PhraseQuery(C, "AND")
    assert parse('"a:b c"', C) == MatchQuery('"a', 'b c"')
    assert parse("https://x", C) == MatchQuery("https", "//x")
    assert parse("*", C) == m("*") and parse("go**", C) == PrefixQuery(C, "go*")
    assert parse('t:"(a) b"', C) == PhraseQuery("t", "(a) b")


def _naive(index_docs, q):
    """Scores by the definition, over tokenised texts."""
    a = standard_analyzer()
    docs = {d: [t for t in a.analyze(f[C])] for d, f in index_docs.items()}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    vocabulary = {t.term for ts in docs.values() for t in ts}

    def term(t):
        hit = {d: sum(x.term == t for x in ts) for d, ts in docs.items()}
        hit = {d: k for d, k in hit.items() if k}
        return {d: BM25().score(k, len(hit), n, len(docs[d]), avg) for d, k in hit.items()}

    def add(parts):
        out = {}
        for p, w in parts:
            for d, s in p.items():
                out[d] = out.get(d, 0) + s * w
        return out

    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            new = [i]
            for j, e in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
            row = new
        return row[-1]

    if isinstance(q, TermQuery):
        return term(q.term)
    if isinstance(q, MatchQuery):
        ts = {t.term for t in a.analyze(q.text)}
        got = add([(term(t), 1) for t in ts])
        return {d: s for d, s in got.items() if q.operator == "or" or all(any(x.term == t for x in docs[d]) for t in ts)}
    if isinstance(q, PrefixQuery):
        return add([(term(t), 1) for t in vocabulary if t.startswith(q.prefix)])
    if isinstance(q, FuzzyQuery):
        return add([(term(t), 1 / (edits(t, q.term) + 1)) for t in vocabulary if edits(t, q.term) <= q.edits])
    if isinstance(q, PhraseQuery):
        ts = a.analyze(q.text)
        out = {}
        for d, own in docs.items():
            at = {t: sorted(x.position for x in own if x.term == t) for t in {x.term for x in ts}}

            def fits(start):
                place, used = start, 0
                for u, v in zip(ts, ts[1:]):
                    gap = max(1, v.position - u.position)
                    later = [p for p in at[v.term] if p >= place + gap]
                    if not later:
                        return False
                    used += later[0] - place - gap
                    place = later[0]
                return used <= q.slop

            if ts and any(fits(s) for s in at[ts[0].term]):
                out[d] = 1.5 * sum(term(t.term)[d] for t in ts)
        return out
    cand = None
    for c in q.must:
        s = _naive(index_docs, c)
        cand = s if cand is None else {d: cand[d] + s[d] for d in cand if d in s}
    for c in q.should:
        s = _naive(index_docs, c)
        if q.must:
            cand = {d: v + s.get(d, 0) for d, v in cand.items()}
        else:
            cand = add([(cand or {}, 1), (s, 1)])
    if cand is None:
        cand = dict.fromkeys(docs, 0.0) if q.must_not else {}
    for c in q.must_not:
        s = _naive(index_docs, c)
        cand = {d: v for d, v in cand.items() if d not in s}
    return cand


def _random_query(r, words, depth):
    kind = r.randint(0, 6) if depth else r.randint(0, 4)
    some = lambda k: " ".join(r.choice(words) for _ in range(k))
    if kind == 0:
        return TermQuery(C, r.choice(words))
    if kind == 1:
        return MatchQuery(C, some(r.randint(1, 3)), r.choice(["or", "and"]))
    if kind == 2:
        return PhraseQuery(C, some(r.randint(1, 3)), r.randint(0, 4))
    if kind == 3:
        return PrefixQuery(C, r.choice(words)[:2])
    if kind == 4:
        return FuzzyQuery(C, r.choice(words), r.randint(0, 3))
    part = lambda: [_random_query(r, words, depth - 1) for _ in range(r.choice([0, 0, 1, 2]))]
    return BooleanQuery(must=part(), should=part(), must_not=part())


def test_random_trees(spark):
    r = random.Random(4)
    words = ["alpha", "alps", "beta", "bet", "gamma", "gam", "delta", "of", "is"]
    docs = {f"d{i}": {C: " ".join(r.choice(words) for _ in range(r.randint(1, 9)))} for i in range(12)}
    index = index_of(spark, docs).cached()
    words = words[:-2]
    for _ in range(40):
        q = _random_query(r, words, 2)
        got, want = {x["id"]: x["score"] for x in index.hits(q).collect()}, _naive(docs, q)
        assert got.keys() == want.keys(), q
        for d in want:
            assert got[d] == pytest.approx(want[d], abs=1e-9), q


def test_fuzzy_beyond_the_literals(three, monkeypatch):
    from textloom.plans import compiler

    want = scores(three.search(FuzzyQuery(C, "gloang", 3)))
    monkeypatch.setattr(compiler, "FUZZY_LITERALS", 0)
    assert scores(three.search(FuzzyQuery(C, "gloang", 3))) == want != {}


def test_many_static_terms(three):
    words = " ".join(f"w{i}" for i in range(100))
    assert scores(three.search(MatchQuery(C, words + " golang"))) == {"web": 0.980829}
