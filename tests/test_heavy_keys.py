import math
import random

import pytest
from pyspark.sql import functions as F

from textloom.operators.heavy_keys import exact_quantiles, first_bin, heavy_keys, once, profile_keys, surplus_copies
from textloom.operators.ranking import global_rank

PROBS = (0.0, 0.25, 0.5, 0.9, 1.0)


def _want(values):
    v = sorted(x for x in values if x is not None)
    return [v[max(1, math.ceil(p * len(v))) - 1] for p in PROBS] if v else [None] * len(PROBS)


def test_quantiles_of_hot_and_rare_keys(spark):
    r = random.Random(3)
    big = 2**62
    rows = [("hot", r.randint(-big, big)) for _ in range(3000)] + [("tied", 7)] * 500 + [("few", 1), ("few", 2**63 - 1), ("few", -(2**63)), ("close", big), ("close", big + 1), ("close", big + 3)]
    rows += [("narrow", 10**9 + r.randint(0, 50)) for _ in range(800)] + [(None, 5), (None, 6), ("nulls", None), ("some", None), ("some", 3)]
    rows += [(f"k{i}", r.randint(0, 300)) for i in range(200)]
    df = spark.createDataFrame(rows, "q string, n long").repartition(6)
    got = {x["q"]: x for x in exact_quantiles(df, ["q"], "n", PROBS).withColumnRenamed("q", "vals").toDF("q", "n", "vals").collect()}
    keys = {k for k, _ in rows}
    assert got.keys() == keys
    for k in keys:
        values = [v for q, v in rows if q == k]
        assert got[k]["n"] == sum(v is not None for v in values)
        assert list(got[k]["vals"]) == _want(values), k


def test_first_bin_is_monotone(spark):
    values = sorted({0, 1, 127, 128, 255, 256, 257, 511, 512, 2**62, 2**63 - 1, -1, -300, -(2**63), -(2**63) + 1, *(2**k + d for k in range(3, 62) for d in (-1, 0, 1))})
    bins = [x[0] for x in spark.createDataFrame([(v,) for v in values], "v long").select(first_bin(F.col("v"))).collect()]
    assert bins == sorted(bins) and len(set(bins)) > 120


def test_empty_and_bad_probabilities(spark):
    empty = spark.createDataFrame([], "k string, v long")
    assert exact_quantiles(empty, ["k"], "v", (0.5,)).count() == 0
    assert profile_keys(empty, "k", ["v"], "v", None, (0.5,)).count() == 0
    with pytest.raises(ValueError):
        exact_quantiles(empty, ["k"], "v", (1.5,))


def test_profile(spark):
    rows = [("a", 1, 2), ("a", 1, 3), ("a", 2, None), (None, 1, 1), ("b", None, 4), ("b", None, 4)]
    df = spark.createDataFrame(rows, "key_value string, records int, q int")
    got = {x["key_value"]: (x["n_rows"], x["occurrences"], x["records"], list(x["q"])) for x in profile_keys(df, "key_value", ["records"], "q", "q", (0.5,)).collect()}
    assert got == {"a": (3, 5, 2, [2]), None: (1, 1, 1, [1]), "b": (2, 8, 1, [4])}


def test_copies_count_once(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 1, 5), ("a", 2, 6), ("a", 2, 6)], "k string, p int, v int")
    assert once(df, ["k"], ["k", "p"]).count() == 2
    assert sorted(map(tuple, once(df, ["k"], ["k", "p"], F.max("v").alias("v")).collect())) == [("a", 1, 5), ("a", 2, 6)]


@pytest.mark.parametrize("limit", [None, 0])
def test_heavy_keys(spark, monkeypatch, limit):
    """Against brute force, with copies, nulls, ties at the share, wide and narrow values; with and without broadcasts."""
    from textloom.operators import heavy_keys as module

    if limit is not None:
        monkeypatch.setattr(module, "broadcast_if_small", lambda df: df)
    r = random.Random(8)
    wide = [("wide", i, r.choice([-(2**63), 2**63 - 1, 0, r.randint(-(2**62), 2**62)])) for i in range(300)]
    hot = [("hot", i, 10**17 + r.randint(0, 9)) for i in range(400)]
    rest = [(f"k{i}", 0, i) for i in range(195)] + [("one value", i, 5) for i in range(100)] + [("no value", i, None) for i in range(100)] + [(None, i, i) for i in range(100)] + [("short", i, i) for i in range(4)]
    distinct = wide + hot + rest
    rows = distinct + [distinct[0]] * 500 + r.sample(distinct, 200)
    df = spark.createDataFrame(rows, "n_rows string, q int, key_value long").repartition(5)
    got = {x["key_value"]: (x["n_rows"], list(x["q"])) for x in heavy_keys(df, "n_rows", ["n_rows", "q", "key_value"], "key_value", 100 / len(distinct), PROBS).collect()}
    assert got == {k: (sum(x[0] == k for x in distinct), _want([x[2] for x in distinct if x[0] == k])) for k in ("wide", "hot", "one value", "no value", None)}
    assert heavy_keys(df.limit(0), "n_rows", ["n_rows"], "key_value", 0.1, PROBS).count() == 0
    with pytest.raises(ValueError):
        heavy_keys(df, "n_rows", ["n_rows"], "key_value", 0, PROBS)


def test_surplus_copies(spark):
    df = spark.createDataFrame([("a", None, 1), (None, "a", 1), ("a", None, 1), ("b", "c", 2), ("a", None, 1)], "k string, extra string, v int").withColumnRenamed("extra", "p")
    assert [tuple(x) for x in surplus_copies(df, ["k", "p"], "v").collect()] == [("a", None, 1, 2)]


def test_global_rank(spark):
    r = random.Random(1)
    rows = [("hot" if r.random() < 0.6 else r.choice(["x", "y", None]), r.randint(0, 20), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "rank string, _n int, position int").toDF("k", "_x", "i").repartition(5)
    got = global_rank(df, ["k"], ["_x", "i"]).collect()
    assert len(got) == 2000 and sorted(g["position"] for g in got) == list(range(2000))
    for k in {x[0] for x in rows}:
        mine = sorted((g for g in got if g["k"] == k), key=lambda g: g["rank"])
        assert [g["rank"] for g in mine] == list(range(len(mine)))
        assert [(g["_x"], g["i"]) for g in mine] == sorted((g["_x"], g["i"]) for g in mine)
    ordered = sorted(got, key=lambda g: g["position"])
    assert [g["k"] or "" for g in ordered] == sorted((x[0] or "" for x in rows))
    assert global_rank(df.where("i < 0"), ["k"], ["i"]).count() == 0
