import random

import numpy as np
import pytest

from textloom.llm import near_duplicates as nd
from textloom.runtime import materialize


def test_signatures_are_unbiased():
    r = np.random.default_rng(1)
    for _ in range(3):
        n, m = 60, 20
        shared, own = r.integers(-(2**62), 2**62, n), r.integers(-(2**62), 2**62, (2, m))
        wa, wb = r.integers(1, 11, n + m), r.integers(1, 11, n + m)
        inter = np.minimum(wa[:n], wb[:n]).sum()
        j = inter / (wa.sum() + wb.sum() - inter)
        items, weights = np.r_[shared, own[0], shared, own[1]], np.r_[wa, wb]
        est = [nd.estimate(*nd.bag_min_hash(items, weights, np.array([0, n + m]), 300, seed)) for seed in range(1, 25)]
        assert abs(np.mean(est) - j) < 4 * np.std(est) / len(est) ** 0.5 + 0.003


def test_signature_depends_on_the_bag_only():
    r = np.random.default_rng(2)
    bags = [r.integers(-(2**62), 2**62, k) for k in (1, 2, 7, 90, 3000)]
    weights = [r.integers(1, 11, len(b)) for b in bags]
    starts = np.cumsum([0] + [len(b) for b in bags])[:-1]
    together = nd.bag_min_hash(np.concatenate(bags), np.concatenate(weights), starts, 64)
    assert np.isfinite(together).all()
    for i, (b, w) in enumerate(zip(bags, weights)):
        p = r.permutation(len(b))
        assert np.array_equal(nd.bag_min_hash(b[p], w[p], np.array([0]), 64)[0], together[i])


def _corpus(seed):
    r = random.Random(seed)
    common = [f"c{i}" for i in range(30)]
    docs = {}
    for i in range(60):
        docs[len(docs)] = [r.choice(common) for _ in range(30)] + [f"w{r.randint(0, 4000)}" for _ in range(40)]
    for i in range(60):
        base = list(docs[r.randint(0, 59)])
        for _ in range(r.randint(0, 9)):
            k = r.randrange(len(base))
            base[k] = r.choice([f"e{r.randint(0, 999)}", base[k - 1]])
        r.shuffle(base)
        docs[len(docs)] = base
    for _ in range(40):
        docs[len(docs)] = list(docs[5])
    docs[len(docs)] = ["one"]
    docs[len(docs)] = ["one", "one"]
    return docs


def _tokens(spark, docs):
    rows = [(d, t, p, "clash") for d, ts in docs.items() for p, t in enumerate(ts)]
    return spark.createDataFrame(rows + rows[:50] + [(0, None, 1, "clash")], "k long, term string, position int, items string")


@pytest.fixture(scope="module")
def found(spark):
    docs = _corpus(3)
    bags = materialize(nd.bags_of_terms(_tokens(spark, docs), ["k"], "term"), "bags")
    return docs, nd.similar_pairs(bags, "k", (7, 10))


def _truth(docs):
    sets = {k: set(v) for k, v in docs.items()}
    return {(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])}


def test_pairs_against_brute_force(found):
    docs, (members, pairs) = found
    got = [tuple(r) for r in nd.record_pairs(members, pairs, "k").collect()]
    assert len(got) == len(set(got)) and set(got) == _truth(docs)


def test_groups_against_brute_force(found):
    docs, (members, pairs) = found
    root = {k: k for k in docs}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in _truth(docs):
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    got = {r["k"]: r["group"] for r in nd.groups(members, pairs, "k").collect()}
    assert got == {k: top(k) for k in docs}


def test_links_against_brute_force(spark, found):
    docs, (members, pairs) = found
    truth = _truth(docs)
    want = {k: sum(k in p for p in truth) for k, ts in docs.items() if ts}
    got = {x["k"]: (x["class"], x["links"]) for x in nd.linked_records(members, pairs, "k").collect()}
    assert {k: n for k, (_, n) in got.items()} == want
    assert all(got[k][0] == min(j for j in got if set(docs[j]) == set(docs[k])) for k in got)


def test_full_bands_in_parts(spark, monkeypatch):
    """Sixty texts that all differ in one word share nearly every band; none of their links is lost."""
    monkeypatch.setattr(nd, "FULL_BAND", 7)
    monkeypatch.setattr(nd, "SAMPLED", 2)
    docs = {i: [f"w{j}" for j in range(30)] + [f"own{i}"] for i in range(60)}
    bags = materialize(nd.bags_of_terms(_tokens(spark, docs).where("term IS NOT NULL"), ["k"], "term"), "bags")
    members, pairs = nd.similar_pairs(bags, "k", (7, 10))
    assert members.count() == 60 and {tuple(p) for p in pairs.collect()} == {(a, b) for a in docs for b in docs if a < b}


def test_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (200, 100), (7, 7)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["root"] for r in nd.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 200: 100}
    assert nd.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_multiset_overlap(spark):
    docs = {1: ["a"] * 9 + ["b"], 2: ["a"] * 10, 3: ["a"]}
    bags = nd.bags_of_terms(spark.createDataFrame([(k, t) for k, v in docs.items() for t in v], "k long, term string"), ["k"], "term", multiset=True)
    members, pairs = nd.similar_pairs(materialize(bags, "bags"), "k", (8, 10))
    assert [tuple(r) for r in nd.record_pairs(members, pairs, "k").collect()] == [(1, 2)]


def test_edited_copies_of_one_are_a_third_of_all(spark):
    """Common in the group, rare in the edits: the terms that differ are the rare ones."""
    r = random.Random(4)
    docs = {k: [f"b{i}" for i in range(80)] + [f"e{k}-{i}" for i in range(r.randint(8, 17))] for k in range(120)}
    docs |= {k: [f"w{r.randint(0, 4000)}" for _ in range(70)] for k in range(120, 360)}
    members, pairs = nd.similar_pairs(materialize(nd.bags_of_terms(_tokens(spark, docs), ["k"], "term"), "bags"), "k", (7, 10))
    want, got = _truth(docs), {tuple(r) for r in nd.record_pairs(members, pairs, "k").collect()}
    assert got <= want and len(want - got) <= 0.001 * len(want)


def test_empty(spark):
    bags = nd.bags_of_terms(spark.createDataFrame([], "k long, term string"), ["k"], "term")
    members, pairs = nd.similar_pairs(materialize(bags, "bags"), "k", (7, 10))
    assert members.count() == 0 and pairs.count() == 0 and nd.groups(members, pairs, "k").count() == 0
