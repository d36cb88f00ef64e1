import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from textloom.llm.distinctiveness import distinctiveness, leading_terms
from textloom.llm.term_counts import mark, term_counts

TOK = "shard int, id string, field string, term string, position int, records string"


def _tokens(seed, n):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        term = "hot" if r.random() < 0.4 else r.choice(["", "zebra", None, "ä", "b" * 500] + [f"t{k}" for k in range(60)])
        rows.append((r.choice([0, 1, None]), r.choice(["a", "b", None, f"d{r.randint(0, 30)}"]), r.choice(["title", None, "content"]), term, r.choice([None, i]), "clash"))
    return rows + r.sample(rows, n // 5)


@pytest.mark.parametrize("parts", [1, 9])
def test_counts_against_brute_force(spark, parts):
    rows = _tokens(parts, 3000)
    df = spark.createDataFrame(rows, TOK).repartition(parts)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r["term"]: (r["occurrences"], r["records"]) for r in term_counts(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    occ, rec = defaultdict(set), defaultdict(set)
    for s, i, f, t, p, _ in rows:
        if t is not None:
            occ[t].add((s, i, f, p))
            rec[t].add((s, i))
    assert got == {t: (len(occ[t]), len(rec[t])) for t in occ}


def test_no_tokens(spark):
    assert term_counts(spark.createDataFrame([], TOK)).count() == 0
    assert term_counts(spark.createDataFrame([(0, "a", "f", None, 1, "")], TOK)).count() == 0


def test_marks(spark):
    df = spark.createDataFrame([(1,), (2,), (9,), (10,), (None,)], "r long")
    assert [x[0] for x in df.select(mark(F.col("r"), 100)).collect()] == ["rare", None, None, "common", None]
    assert [x[0] for x in df.select(mark(F.col("r"), 5)).collect()][:2] == ["rare", "common"]


POST = "shard int, field string, term string, id string, tf int, positions array<int>, score string"


def test_distinctiveness_against_the_formula(spark):
    r = random.Random(6)
    posts, lens = {}, defaultdict(int)
    for i in range(40):
        for t in {r.choice(["the", "of", f"w{r.randint(0, 20)}", f"x{i}"]) for _ in range(8)}:
            posts[(i % 3, "content", t, f"d{i}")] = tf = r.randint(1, 6)
            lens[(i % 3, f"d{i}", "content")] += tf
    rows = [(*k, None if n % 4 == 0 else tf, list(range(tf)) if n % 3 or n % 4 == 0 else None, "x") for n, (k, tf) in enumerate(posts.items())]
    rows += rows[:25] + [(0, "content", "lost", "nowhere", 2, None, "x"), (0, "content", "odd", "d0", None, None, "x")]
    dl = [(*k, v, "y") for k, v in lens.items()] * 2
    n = 50
    got = {(x["shard"], x["field"], x["term"], x["id"]): x for x in distinctiveness(spark.createDataFrame(rows, POST), spark.createDataFrame(dl, "shard int, id string, field string, len int, term string"), n).collect()}
    df = defaultdict(int)
    for k in posts:
        df[k[2]] += 1
    mean = sum(lens.values()) / 50
    for (s, f, t, i), tf in posts.items():
        tfn, p = tf * math.log2(1 + mean / lens[s, i, f]), df[t] / 50
        want = (math.log2(1 + p) + tfn * math.log2((1 + p) / p)) / (tfn + 1)
        assert got[s, f, t, i]["score"] == pytest.approx(want) and got[s, f, t, i]["df"] == df[t]
    assert got[0, "content", "odd", "d0"]["score"] is None and len(got) == len(posts) + 2
    some = spark.createDataFrame([(0, "d0"), (0, "d0"), (9, "none")], "shard int, id string")
    part = distinctiveness(spark.createDataFrame(rows, POST), spark.createDataFrame(dl, "shard int, id string, field string, len int, term string"), n, of=some).collect()
    assert {x["id"] for x in part} == {"d0"} and all(x["score"] == got[x["shard"], x["field"], x["term"], x["id"]]["score"] for x in part if x["score"] is not None)


def test_leading_term_and_ties(spark):
    rows = [(1, "b", 2, 5.0), (1, "a", 2, 5.0), (1, "c", 3, 5.0), (1, "z", 9, 4.0), (2, "n", 1, None), (3, "y", 1, 1.0), (3, "x", 1, 1.0)]
    got = leading_terms(spark.createDataFrame(rows, "k long, term string, tf int, score double"), ["k"]).collect()
    assert {r["k"]: r["term"] for r in got} == {1: "c", 3: "x"}


def test_empty_inputs(spark):
    p, d = spark.createDataFrame([], POST), spark.createDataFrame([], "shard int, id string, field string, len int")
    assert distinctiveness(p, d, 0).count() == 0
