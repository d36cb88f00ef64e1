import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm.mixing import EXACT, mix, mix_shares, plan_mix
from textloom.llm.packing import best_fit_runs, fill, pack
from textloom.llm.token_sizes import token_sizes

KINDS = "container_kind string, capacity_tokens int"


def _best_fit_decreasing(sizes, capacity):
    """One document at a time into the fullest container that still takes it."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [(g, i) for i, g in enumerate(gaps) if g >= s]
        if fit:
            gaps[min(fit)[1]] -= s
        else:
            gaps.append(capacity - s)
    return sorted(capacity - g for g in gaps)


@pytest.mark.parametrize("seed", range(12))
def test_runs_equal_one_by_one(seed):
    r = random.Random(seed)
    capacity = r.choice([7, 50, 512])
    sizes = [r.choice([r.randint(1, capacity), r.randint(1, max(1, capacity // 6))]) for _ in range(r.randint(1, 400))]
    values, counts = np.unique(np.array(sizes), return_counts=True)
    runs, opened = best_fit_runs(values, counts, capacity)
    load = defaultdict(int)
    placed = defaultdict(int)
    for size, n, base, per in runs:
        placed[size] += n
        for i in range(n):
            load[base + i // per] += size
    assert dict(placed) == dict(zip(values.tolist(), counts.tolist())) and set(load) == set(range(opened))
    assert sorted(load.values()) == _best_fit_decreasing(sizes, capacity)


def test_many_equal_documents_need_few_runs():
    runs, opened = best_fit_runs(np.array([3, 400]), np.array([10**9, 10**6]), 512)
    assert len(runs) < 10 and opened == 10**6 + -(-(10**9 - 37 * 10**6) // 170)


def test_pack(spark):
    r = random.Random(2)
    docs = [(i, r.randint(1, 60)) for i in range(300)] + [(1000, 0), (1001, 0), (1002, 100), (1003, 250), (1004, 101), (1005, None), (7, 9)] + [(2000 + i, 33) for i in range(400)]
    sizes = spark.createDataFrame(docs, "doc_id long, n_tokens long").withColumn("kind", F.lit("clash"))
    kinds = spark.createDataFrame([("s", 100), ("s", 100), ("w", 1000), (None, 5), ("bad", 0)], KINDS)
    packed = pack(sizes, kinds).cache()
    rows = packed.collect()
    for kind, cap in (("s", 100), ("w", 1000)):
        mine = [x for x in rows if x["kind"] == kind]
        load, total = defaultdict(int), defaultdict(int)
        for x in mine:
            load[x["container"]] += x["tokens"]
            total[x["doc_id"]] += x["tokens"]
        assert max(load.values()) <= cap and set(load) == set(range(len(load)))
        want = defaultdict(int)
        for d, n in docs:
            want[d] += n or 0
        assert total == want
        for d, n in docs:
            own = sorted((x["piece"], x["first_token"], x["tokens"]) for x in mine if x["doc_id"] == d)
            if (n or 0) <= cap and d != 7:
                assert own == [(0, 0, n or 0)]
        assert len(load) <= 1.02 * sum(load.values()) / cap + 1
    assert sorted((x["piece"], x["tokens"]) for x in rows if x["kind"] == "s" and x["doc_id"] == 1003) == [(0, 100), (1, 100), (2, 50)]
    filled = fill(packed, kinds).collect()
    assert all(0 <= x["fill"] <= 1 for x in filled) and sum(x["texts"] for x in filled) == len(rows)


def test_pack_many_kinds_and_large_ones(spark, monkeypatch):
    """More kinds than could be listed by hand, capacities beyond a million, and runs that span many stretches."""
    from textloom.llm import packing

    monkeypatch.setattr(packing, "STRETCH_BITS", 2)
    r = random.Random(6)
    sizes = {i: r.randint(0, 120) for i in range(70)}
    kinds = {f"k{c}": c for c in range(30, 100)} | {"huge": 3_000_000}
    rows = pack(spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens long"), spark.createDataFrame(list(kinds.items()), "container_kind string, capacity_tokens int")).collect()
    assert {x["kind"] for x in rows} == set(kinds)
    for kind, cap in kinds.items():
        mine = [x for x in rows if x["kind"] == kind]
        whole = sorted((x["doc_id"], x["piece"], x["tokens"]) for x in mine)
        assert [n for _, _, n in whole] == [n for i, s in sizes.items() for n in ([cap] * ((s - 1) // cap) + [s - cap * max(0, (s - 1) // cap)] if s else [0])]
        loads = [sum(x["tokens"] for x in mine if x["container"] == c) for c in {x["container"] for x in mine}]
        assert max(loads) <= cap and sum(2 * x <= cap for x in loads) <= 1
        assert len(loads) == max(1, len(_best_fit_decreasing([n for _, _, n in whole if n], cap)))


def test_pack_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, n_tokens long")
    kinds = spark.createDataFrame([("s", 10)], KINDS)
    assert pack(none, kinds).count() == 0
    assert pack(spark.createDataFrame([(1, 1)], "doc_id long, n_tokens long"), kinds.where("capacity_tokens > 10")).count() == 0
    zero = pack(spark.createDataFrame([(1, 0)], "doc_id long, n_tokens long"), kinds).collect()
    assert [(x["container"], x["tokens"]) for x in zero] == [(0, 0)]


SIZES, TARGETS = "doc_id long, source string, n_tokens long", "source string, target_share double, max_repeat int"


def _sizes(spark):
    r = random.Random(4)
    rows = [(i, "big", r.randint(1, 200)) for i in range(3000)] + [(10_000 + i, "mid", r.randint(1, 200)) for i in range(400)] + [(20_000 + i, "tiny", 50) for i in range(20)]
    return spark.createDataFrame(rows + [(1, "big", 0), (2, None, 9), (3, "unlisted", 9), (4, "big", None), (5, "big", 77), (5, "big", 77)], SIZES)


def test_no_rank_is_too_large(spark):
    from textloom.llm.mixing import UNIT_BITS, crossed

    r, one = random.Random(3), 1 << UNIT_BITS
    rows = [(r.choice([r.randint(0, 1 << 60), r.randint(0, 50), one - 1, one]), r.choice([r.randint(1, 40 * one), one, 3 * one]), r.randint(0, one - 1)) for _ in range(300)]
    got = spark.createDataFrame(rows, "rank long, units long, start long").select("rank", "units", "start", crossed(F.col("rank"), F.col("units"), F.col("start")))
    assert all(n == (k * u + u + s) // one - (k * u + s) // one for k, u, s, n in got.collect())


def test_mix_exact(spark):
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.2, 5), ("none", 0.4, 3), (None, 0.1, 1)], TARGETS)
    chosen = mix(_sizes(spark), targets, EXACT, seed=3).cache()
    shares = {x["source"]: x for x in mix_shares(chosen, targets).collect()}
    for s, want in (("big", 0.5), ("mid", 0.3), ("tiny", 0.2)):
        assert shares[s]["actual_share"] == pytest.approx(want, abs=0.02)
    assert shares["tiny"]["copies"] == 100 and shares["none"]["tokens"] == 0
    assert chosen.where("copies > 5 or (source = 'big' and copies > 1) or n_tokens = 0").count() == 0


def test_mix_all(spark):
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 9), ("tiny", 0.2, 5)], TARGETS)
    sizes = _sizes(spark)
    plan = {p["source"]: p for p in plan_mix(sizes, targets)}
    at_hand = sum(p["tokens"] for p in plan.values())
    assert plan["tiny"]["wanted"] == 5 * 1000 and sum(p["wanted"] for p in plan.values()) == pytest.approx(at_hand)
    assert plan["big"]["wanted"] / plan["mid"]["wanted"] == pytest.approx(5 / 3)
    got = {r["source"]: r["t"] for r in mix(sizes, targets).groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("t")).collect()}
    for s, p in plan.items():
        assert got[s] == pytest.approx(p["wanted"], rel=0.01)
    again = lambda: sorted(map(tuple, mix(sizes, targets).collect()))
    assert again() == again()


def test_mix_number_and_nothing(spark):
    targets = spark.createDataFrame([("big", 1.0, 1), ("neg", -1.0, 2), ("no", None, None)], TARGETS)
    assert plan_mix(_sizes(spark), targets, 1000)[0]["wanted"] == 1000
    none = spark.createDataFrame([], SIZES)
    assert mix(none, targets).count() == 0
    assert [x["actual_share"] for x in mix_shares(mix(none, targets), targets).collect()] == [0.0] * 3
    assert mix(_sizes(spark), targets.where("target_share > 5")).count() == 0


def test_token_sizes(spark):
    rows = [(1, "hello world", "x"), (2, "", "x"), (3, None, None), (4, "<|endoftext|>", "x"), (5, "ab " * 40_000, "x")]
    got = {r["k"]: r["n_tokens"] for r in token_sizes(spark.createDataFrame(rows, "k int, t string, text string"), "t", ["k", "text"]).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and got[5] > 40_000 - 1
