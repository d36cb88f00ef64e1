"""Per-key results when a few keys hold most rows.

``profile_keys`` gives, for every key, its rows, its sum of a count column, its
distinct records and exact quantiles of a value. No step gathers the rows of a
key. The counts are mergeable sums. The quantiles are found by distributed
exact selection: histograms of the values are counted per key with partial
aggregation, the bin that holds each wanted rank is looked up in the running
count of the key's bins, and only the bins whose smallest and largest value
still differ are split again, until every rank has resolved to one value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.runtime import broadcast_if_small, discard, materialize

#: Bins per octave of the first histogram, and parts of a bin in each refinement.
SUB_BITS = 7
SPLIT = 256


def first_bin(value: Column, sub_bits: int = SUB_BITS) -> Column:
    """Monotone bin number of a signed 64-bit value: exact below ``2**sub_bits``, log-linear above.

    At most ``2 * 64 * 2**sub_bits`` bins exist, whatever the data hold.
    """
    # the smallest 64-bit value has no positive counterpart; it shares the bin of its neighbour
    size = F.abs(F.greatest(value, F.lit(-(2**63 - 1))))
    # whole-number logarithm by the length of the binary text: no rounding near powers of two
    bits = F.when(size == 0, 0).otherwise(F.length(F.bin(size)))
    over = F.greatest(bits - F.lit(sub_bits + 1), F.lit(0)).cast("int")
    mant = F.call_function("shiftright", size, over)
    b = mant + over.cast("long") * F.lit(1 << sub_bits)
    return F.when(value < 0, -b).otherwise(b)


def _clean_probs(probs: Sequence[float]) -> list[float]:
    out = sorted({float(p) for p in probs})
    if not out or out[0] < 0 or out[-1] > 1:
        raise ValueError("quantiles must lie between 0 and 1")
    return out


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Exact lower quantiles of an integer column per key: ``keys..., n, q`` with ``q ARRAY<BIGINT>``.

    ``q[i]`` is the value of rank ``max(1, ceil(probs[i] * n))`` in ascending
    order, for the sorted distinct ``probs``. Null values do not count; a key
    with only null values has ``n = 0`` and null quantiles. Null is a key like
    any other. ``df`` is read once per refinement round, so pass a written
    table. Ties resolve to the tied value. An empty table gives no rows.
    """
    probs = _clean_probs(probs)
    keys = list(keys)
    rows = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(value).cast("long").alias("_v"), F.lit(1).alias("_w"))
    ks = [f"_k{i}" for i in range(len(keys))]
    hist = rows.groupBy(*ks, first_bin(F.col("_v")).alias("_b")).agg(
        F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    # null values share a null bin of count 0, which keeps their key in the result
    hist = materialize(hist, "hist")
    running = Window.partitionBy(*ks).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy(*ks)
    cum = hist.withColumn("_cum", F.sum("_n").over(running)).withColumn("_all", F.sum("_n").over(total))
    want = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(probs)])
    open_ = (
        cum.withColumn("_w", F.explode(want))
        .withColumn("_rank", F.greatest(F.lit(1), F.ceil(F.col("_all") * F.col("_w.p"))).cast("long"))
        .where((F.col("_all") == 0) | ((F.col("_rank") > F.col("_cum") - F.col("_n")) & (F.col("_rank") <= F.col("_cum"))))
        .select(*ks, F.col("_w.i").alias("_i"), F.col("_all"), (F.col("_rank") - F.col("_cum") + F.col("_n")).alias("_rank"), "_lo", "_hi")
    )
    out = _resolve(rows, ks, materialize(open_, "ranks"))
    return out.select(*[F.col(k).alias(n) for k, n in zip(ks, keys)], F.col("_all").alias("n"), F.col("_q").alias("q"))


def _resolve(rows: DataFrame, ks: list[str], found: DataFrame) -> DataFrame:
    """``ks, _all, _q`` with the values of all wanted ranks, the intervals in ``found`` being split until each holds one value."""
    done = found.where(F.col("_lo").eqNullSafe(F.col("_hi")))
    todo = found.where(F.col("_lo") < F.col("_hi"))
    parts = [done]
    while not todo.isEmpty():
        todo = _refine(rows, ks, todo)
        parts.append(todo.where(F.col("_lo") == F.col("_hi")))
        todo = todo.where(F.col("_lo") < F.col("_hi"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.groupBy(*ks).agg(F.max("_all").alias("_all"), F.sort_array(F.collect_list(F.struct("_i", "_lo"))).alias("_q"))
    return out.select(*ks, "_all", F.col("_q._lo").alias("_q"))


def _refine(rows: DataFrame, ks: list[str], todo: DataFrame) -> DataFrame:
    """One round: split each open interval, count its parts, keep the part that holds the rank."""
    spans = materialize(todo.select(*ks, "_lo", "_hi").distinct(), "spans")
    spans = broadcast_if_small(spans.select(*[F.col(k).alias(f"s{k}") for k in ks], F.col("_lo").alias("_slo"), F.col("_hi").alias("_shi")))
    cond = [F.col(k).eqNullSafe(F.col(f"s{k}")) for k in ks] + [F.col("_v").between(F.col("_slo"), F.col("_shi"))]
    # the difference of whole numbers fits where both ends have one sign, and is rounded only where it is large; the
    # largest value never shares part 0 with the smallest
    one_sign = (F.col("_slo") < 0) == (F.col("_shi") < 0)
    less = lambda a, b: F.when(one_sign, F.try_subtract(a, b).cast("double")).otherwise(a.cast("double") - b.cast("double"))
    part = F.floor(less(F.col("_v"), F.col("_slo")) * SPLIT / (less(F.col("_shi"), F.col("_slo")) + 1))
    hist = (
        rows.join(spans, cond)
        .groupBy(*ks, F.col("_slo"), F.col("_shi"), part.alias("_b"))
        .agg(F.sum("_w").alias("_n"), F.min("_v").alias("_nlo"), F.max("_v").alias("_nhi"))
    )
    running = Window.partitionBy(*ks, "_slo", "_shi").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.withColumn("_cum", F.sum("_n").over(running))
    t = todo.alias("t")
    c = cum.alias("c")
    on = [F.col(f"t.{k}").eqNullSafe(F.col(f"c.{k}")) for k in ks] + [
        F.col("t._lo") == F.col("c._slo"),
        F.col("t._hi") == F.col("c._shi"),
        F.col("t._rank") > F.col("c._cum") - F.col("c._n"),
        F.col("t._rank") <= F.col("c._cum"),
    ]
    nxt = t.join(c, on).select(
        *[F.col(f"t.{k}").alias(k) for k in ks],
        F.col("t._i").alias("_i"),
        F.col("t._all").alias("_all"),
        (F.col("t._rank") - F.col("c._cum") + F.col("c._n")).alias("_rank"),
        F.col("c._nlo").alias("_lo"),
        F.col("c._nhi").alias("_hi"),
    )
    return materialize(nxt, "ranks")


def profile_keys(rows: DataFrame, key: str, record: Sequence[str], value: str, count: str | None, probs: Sequence[float]) -> DataFrame:
    """``key, n_rows, occurrences, records, q``: per-key totals and exact quantiles of ``value``.

    ``rows`` holds each fact once (drop copies first) and should be a written
    table. ``records`` counts distinct ``record`` tuples in two steps, so a hot
    key is spread over all tasks; ``occurrences`` sums ``count`` (or counts rows).
    A null key is a group of its own; nulls in ``count`` add nothing.
    """
    keyed = rows.withColumn("_key", F.col(key))
    amount = F.sum(count) if count else F.count("*")
    per_record = keyed.groupBy("_key", *record).agg(F.count("*").alias("_rows"), amount.cast("long").alias("_occ"))
    totals = per_record.groupBy("_key").agg(
        F.sum("_rows").alias("n_rows"), F.coalesce(F.sum("_occ"), F.lit(0)).alias("occurrences"), F.count("*").alias("records")
    )
    q = exact_quantiles(keyed.select("_key", value), ["_key"], value, probs).select(F.col("_key").alias("_qk"), "q")
    return totals.join(q, F.col("_key").eqNullSafe(F.col("_qk")), "left").select(F.col("_key").alias("key_value"), "n_rows", "occurrences", "records", "q")


def surplus_copies(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """``key..., value, extra`` of the rows that occur more than once, with the number of their copies beyond the first.

    Only a hash of each row is exchanged, counted inside each task first; rows
    whose hash recurs are then counted exactly. Nulls are values like others.
    """
    h = F.xxhash64(*key)
    twice = df.select(h.alias("_h")).groupBy("_h").agg(F.count("*").alias("_c")).where(F.col("_c") > 1).select("_h")
    twice = materialize(twice, "twice")
    some = df.withColumn("_h", h).join(broadcast_if_small(twice), "_h", "left_semi")
    found = some.groupBy(*key).agg(F.max(value).alias(value), (F.count("*") - 1).alias("extra"))
    out = materialize(found.where(F.col("extra") > 0), "surplus")
    discard(twice)
    return out


def heavy_keys(df: DataFrame, key: str, row: Sequence[str], value: str, share: float, probs: Sequence[float]) -> DataFrame:
    """``key_value, n_rows, q`` of the keys that hold at least ``share`` of all rows, copies of a ``row`` counted once.

    Exact selection that begins with one bin for each key, its range and count
    of values. The counts tell the heavy keys, at most ``1 / share``, and only
    their bins are split further, up to the exact quantiles. Copies are taken
    out as counts, not as rows: each histogram adds all rows and subtracts the
    surplus ones, which is possible because counts are mergeable. A null key is
    a key like any other; null values count as rows but have no rank, and a key
    without values has null quantiles. An empty table gives no rows.
    """
    if not 0 < share <= 1:
        raise ValueError("a share lies above 0 and not above 1")
    probs = _clean_probs(probs)
    named = df.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(row)], F.col(key).alias("_k0"), F.col(value).cast("long").alias("_v"))
    copies = surplus_copies(named, [*(f"_r{i}" for i in range(len(row))), "_k0"], "_v")
    rows = named.select("_k0", "_v", F.lit(1).cast("long").alias("_w")).unionByName(copies.select("_k0", "_v", (-F.col("extra")).alias("_w")))
    counted = rows.groupBy("_k0").agg(F.sum("_w").alias("_rows"), F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_w"))), F.lit(0)).alias("_all"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    first = materialize(counted, "bins")
    total = first.agg(F.sum("_rows")).first()[0] or 0
    # at most 1 / share rows
    heavy = materialize(first.where(F.col("_rows") >= F.lit(share) * F.lit(total)), "heavy")
    want = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(probs)])
    open_ = heavy.withColumn("_want", F.explode(want)).select(
        "_k0", F.col("_want.i").alias("_i"), "_all", F.greatest(F.lit(1), F.ceil(F.col("_all") * F.col("_want.p"))).cast("long").alias("_rank"), "_lo", "_hi"
    )
    q = _resolve(rows, ["_k0"], materialize(open_, "ranks")).select(F.col("_k0").alias("_qk"), "_q")
    return heavy.join(F.broadcast(q), F.col("_k0").eqNullSafe(F.col("_qk"))).select(F.col("_k0").alias("key_value"), F.col("_rows").alias("n_rows"), F.col("_q").alias("q"))


def once(df: DataFrame, spread: Sequence[str], key: Sequence[str], *values: Column) -> DataFrame:
    """Each ``key`` once, with ``values`` aggregated; the exchange is on ``spread``, a subset of ``key``.

    Later groupings on ``spread`` or more need no further exchange.
    """
    spread_out = df.repartition(*spread)
    return spread_out.groupBy(*key).agg(*values) if values else spread_out.select(*key).distinct()
