"""Near-duplicate records: BagMinHash signatures, banding, exact verification, groups."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.counted_join import join_counted
from textloom.runtime import broadcast_if_small, discard, estimated_bytes, materialize

#: Largest weight of an item that a signature has levels for.
TOP_WEIGHT = 10

#: Signature rows per band and number of bands. A pair of similarity 0.65
#: shares a band with probability 0.988, one of 0.70 with 0.9996, one of 0.75
#: with 0.999997.
ROWS, BANDS = 7, 90

#: Most bytes of bags that one task makes signatures of.
SIGNATURE_BYTES = 64 << 20
#: A band with more bags is cut into groups of about this size; such bands are found in one of so many bags.
FULL_BAND = 1000
SAMPLED = 64

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)

#: Resolution of a point's time, in mean gaps of its process.
_TICK = 2.0**-20


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _pieces(top: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds and lengths of [0,1), [1,2), [2,4), [4,8)... up to ``top``."""
    low, length = [0], [1]
    while low[-1] + length[-1] < top:
        at = low[-1] + length[-1]
        low.append(at)
        length.append(min(at, top - at))
    return np.array(low), np.array(length)


def bag_min_hash(items: np.ndarray, weights: np.ndarray, starts: np.ndarray, size: int, seed: int = 1, top: int = TOP_WEIGHT) -> np.ndarray:
    """Weighted-Jaccard signatures of many bags, one row of ``size`` values each.

    ``items`` (64-bit) and ``weights`` (integers from 1 to ``top``) list the
    bags one after the other; bag i begins at ``starts[i]``; every bag has an
    item, and no item twice.

    The weight axis of an item is cut into [0,1), [1,2), [2,4), [4,8)... and
    each piece below the weight carries a Poisson process of points in time,
    whose rate is the piece's length for every register. A point has a register
    and a level inside its piece, and counts only if the level lies below the
    weight: the thinning that makes a smaller weight see a subset of a larger
    one's points. Each register keeps its earliest point, so two bags agree in
    a register with a probability equal to their weighted Jaccard similarity.

    Points come in order of time and are drawn only up to a horizon that the
    latest register of the bag hardly ever passes: some ``size * log(size)`` of
    them for a bag, however many items it has. A bag with a register still
    empty then is followed to a later horizon.
    """
    n = len(starts)
    ends = np.r_[starts[1:], len(items)]
    low, length = _pieces(top)
    sig = np.full((n, size), np.inf)
    bag = np.repeat(np.arange(n), ends - starts)
    total = np.add.reduceat(weights.astype(np.float64), starts)
    row, kind = np.nonzero(weights[:, None] > low[None, :])
    with np.errstate(over="ignore"):
        state = _mix(items[row].astype(np.uint64) + _GOLD * (kind.astype(np.uint64) + np.uint64(seed << 8)))
    process = {"state": state, "bag": bag[row], "kind": kind, "w": weights[row], "ticks": np.zeros(len(row), np.int64), "step": np.zeros(len(row), np.int64)}
    reach = math.log(size) + 4.0
    todo = np.arange(n)
    while len(todo):
        horizon = np.zeros(n)
        horizon[todo] = reach / total[todo]
        on = np.isin(process["bag"], todo) if len(todo) < n else slice(None)
        process = {k: v[on] for k, v in process.items()}
        _draw(process, horizon, sig.reshape(-1), size, low, length)
        todo = np.flatnonzero(np.isinf(sig).any(axis=1))
        reach += 6.0
    return sig


def _draw(process: dict[str, np.ndarray], horizon: np.ndarray, flat: np.ndarray, size: int, low: np.ndarray, length: np.ndarray) -> None:
    """Follow every process past the horizon of its bag and lower the registers in ``flat``.

    ``ticks`` and ``step`` of a process are left before its first point beyond
    the horizon, so that it can be taken up again. Times are kept as whole
    ticks: a point has the same time in every bag, wherever a run was broken.
    """
    live = np.flatnonzero(horizon[process["bag"]] > 0)
    while len(live):
        bag, kind = process["bag"][live], process["kind"][live]
        rate = size * length[kind].astype(np.float64)
        until = horizon[bag]
        expect = np.maximum(0.0, until * rate - process["ticks"][live] * _TICK)
        count = np.ceil(expect + 2.0 * np.sqrt(expect) + 1.0).astype(np.int64)
        last = np.cumsum(count)
        first = last - count
        owner = np.repeat(np.arange(len(live)), count)
        step = np.arange(last[-1]) - first[owner] + process["step"][live][owner] + 1
        with np.errstate(over="ignore"):
            h = _mix(process["state"][live][owner] + _GOLD * step.astype(np.uint64))
        gap = -np.log(((h >> np.uint64(32)).astype(np.float64) + 0.5) * (1.0 / 4294967296.0))
        ticks = np.round(gap * (1.0 / _TICK)).astype(np.int64)
        run = np.cumsum(ticks)
        run += (process["ticks"][live] - run[first] + ticks[first])[owner]
        when = run * _TICK / rate[owner]
        ok = np.flatnonzero(when <= until[owner])
        oo, hh = owner[ok], h[ok]
        level = low[kind][oo] + (((hh & np.uint64(0xFFFF)) * length[kind].astype(np.uint64)[oo]) >> np.uint64(16)).astype(np.int64)
        take = level < process["w"][live][oo]
        reg = ((((hh >> np.uint64(16)) & np.uint64(0xFFFF)) * np.uint64(size)) >> np.uint64(16)).astype(np.int64)
        np.minimum.at(flat, (bag[oo] * size + reg)[take], when[ok][take])
        seen = np.bincount(oo, minlength=len(live))
        if seen.any():
            some = seen > 0
            process["ticks"][live[some]] = run[(first + seen - 1)[some]]
            process["step"][live[some]] += seen[some]
        live = live[seen == count]


def bags_of_terms(tokens: DataFrame, record: list[str], term: str, multiset: bool = False) -> DataFrame:
    """``record..., items`` with the sorted 64-bit hashes of each record's distinct terms.

    With ``multiset`` the i-th occurrence of a term is an item of its own, so
    the overlap of two item sets is the overlap of the multisets. Null terms
    are no terms. Copies of a token row must be dropped before ``multiset``.
    """
    rows = tokens.where(F.col(term).isNotNull())
    if multiset:
        counted = rows.groupBy(*record, term).agg(F.count("*").cast("int").alias("_n"))
        rows = counted.select(*record, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_i"), term)
        item = F.xxhash64(term, "_i")
    else:
        item = F.xxhash64(term)
    return rows.select(*record, item.alias("_x")).groupBy(*record).agg(F.array_sort(F.collect_set("_x")).alias("items"))


def band_keys(bags: DataFrame, key: str, rows: int = ROWS, bands: int = BANDS, full: DataFrame | None = None) -> DataFrame:
    """``key, band``: one line per bag and band, ``band`` being a hash of the band's number and values.

    Every item weighs 1, so registers agree with the probability of the very
    similarity that is verified, whatever the share of the bags with an item.
    Bands listed in ``full`` (``band, parts``) are cut into cells: a bag is of
    one of so many groups, and there is a cell for each two groups. It lies in
    the cells of its own group, so that any two bags meet in one.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                lists = part.column(1)
                items = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = np.diff(lists.offsets.to_numpy())
                sig = bag_min_hash(items, np.ones(len(items), np.int64), np.r_[0, np.cumsum(sizes)[:-1]], rows * bands, top=1)
                bits = sig.view(np.uint64).reshape(len(sizes), bands, rows)
                with np.errstate(over="ignore"):
                    h = _mix(np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(77), (len(sizes), bands)).copy())
                    for r in range(rows):
                        h = _mix(h * _GOLD + bits[:, :, r])
                values = pa.array(h.reshape(-1).view(np.int64))
                offsets = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * bands)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, values)], ["key", "bands"])

    kind = bags.schema[key].dataType.simpleString()
    out = bags.select(key, "items").mapInArrow(work, f"key {kind}, bands array<long>")
    out = out.select(F.col("key").alias(key), F.explode("bands").alias("band"))
    if full is None:
        return out
    out = out.join(broadcast_if_small(full), "band", "left")
    group = F.pmod(F.xxhash64(F.lit(3), key), F.col("parts"))
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.xxhash64("band", F.least(group, j.cast("long")), F.greatest(group, j.cast("long"))))
    return out.select(key, F.explode(F.when(F.col("parts").isNull(), F.array("band")).otherwise(cells)).alias("band"))


def similar_pairs(bags: DataFrame, key: str, threshold: tuple[int, int], rows: int = ROWS, bands: int = BANDS) -> tuple[DataFrame, DataFrame]:
    """Classes of equal bags, and the pairs of class representatives whose Jaccard similarity reaches the threshold.

    ``bags``: ``key`` and ``items`` as :func:`bags_of_terms` makes them, as a
    written table; ``threshold`` is a fraction (numerator, denominator). Returns
    ``(members, pairs)``: ``members`` has ``rep, key`` for every bag, ``pairs``
    has ``a, b`` with ``a < b``. Equal bags are one class from the start, so a
    class that holds a third of all rows costs one signature and no pairs.
    Candidates share a band of their BagMinHash signatures, in which every item
    weighs 1; each candidate is then verified exactly. Empty bags are no case.
    No rows give no classes and no pairs.
    """
    bags = bags.where(F.size("items") > 0)
    marked = materialize(bags.select(key, F.xxhash64("items").alias("_f"), F.xxhash64(F.lit(7), "items").alias("_g")), "marked")
    classes = materialize(marked.groupBy("_f", "_g").agg(F.min(key).alias("rep"), F.count("*").alias("_size")), "classes")
    members = materialize(join_counted(marked, classes, ["_f", "_g"], "_size").select("rep", key), "members")
    # signatures cost much for each byte: as many files as make tasks enough, by the exchange that the join needs anyway
    spark = bags.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), estimated_bytes(bags) // SIGNATURE_BYTES)
    reps = materialize(bags.repartition(tasks, key).join(classes.select(F.col("rep").alias(key)), key, "left_semi"), "reps")
    discard(marked, classes)
    # full bands show in a sample of the bags; what it misses costs time and no links
    some = band_keys(reps.where(F.pmod(F.xxhash64(F.lit(5), key), F.lit(SAMPLED)) == 0), key, rows, bands)
    full = some.groupBy("band").agg((F.count("*") * SAMPLED).alias("n")).where(F.col("n") >= FULL_BAND)
    keys = band_keys(reps, key, rows, bands, materialize(full.select("band", F.ceil(F.col("n") / FULL_BAND).cast("int").alias("parts")), "full"))
    # both sides are one exchange
    a = keys.select(F.col(key).alias("a"), "band")
    b = keys.select(F.col(key).alias("b"), "band")
    candidates = materialize(a.join(b, "band").where(F.col("a") < F.col("b")).select("a", "b").distinct(), "candidates")
    left = reps.select(F.col(key).alias("a"), F.col("items").alias("xa")).join(broadcast_if_small(candidates), "a")
    left = broadcast_if_small(materialize(left, "left"))
    both = reps.select(F.col(key).alias("b"), F.col("items").alias("xb")).join(left, "b")
    overlap = F.size(F.array_intersect("xa", "xb"))
    num, den = threshold
    union = F.size("xa") + F.size("xb") - overlap
    pairs = both.where(overlap.cast("long") * den >= union.cast("long") * num).select("a", "b")
    return members, materialize(pairs, "pairs")


def record_pairs(members: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """All pairs ``a < b`` of records: across linked classes and within each class of equal bags."""
    left = members.select(F.col("rep").alias("a"), F.col(key).alias("ka"))
    right = members.select(F.col("rep").alias("b"), F.col(key).alias("kb"))
    across = pairs.join(left, "a").join(right, "b").select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))
    several = members.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select("rep")
    some = members.join(several, "rep", "left_semi")
    within = some.select("rep", F.col(key).alias("a")).join(some.select("rep", F.col(key).alias("b")), "rep").where("a < b").select("a", "b")
    return across.unionByName(within)


def linked_records(members: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """``key, class, links``: one row per record with the representative of its class of equal bags and the number of records it is similar to.

    Links are counted from class sizes; no pair of records is written out. A
    record without bag is in no class and has no row.
    """
    size = materialize(members.groupBy("rep").agg(F.count("*").alias("n")), "sizes")
    both = pairs.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    across = both.join(size.select(F.col("rep").alias("other"), "n"), "other").groupBy("rep").agg(F.sum("n").alias("across"))
    links = materialize(size.join(across, "rep", "left").select("rep", "n", (F.col("n") - 1 + F.coalesce("across", F.lit(0))).alias("links")), "links")
    return join_counted(members, links, ["rep"], "n").select(key, F.col("rep").alias("class"), "links")


def components(pairs: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of each node's connected component, for all nodes of ``pairs(a, b)``.

    Alternating large-star and small-star steps; every round is an aggregation
    and a join, written to the shared folder, and the number of rounds grows
    with the logarithm of the longest chain. A node with very many neighbours
    is only ever aggregated to its minimum, never collected.
    """
    edges = materialize(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u > v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = materialize(small.where("u > v").distinct(), "edges")
        same = new.exceptAll(edges).isEmpty() and edges.exceptAll(new).isEmpty()
        discard(edges, large)
        edges = new
        if same:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.join(edges.select(F.col("u").alias("node")), "node", "left_anti"))


def groups(members: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """``key, group``: one row per record, the group being the smallest representative of its component."""
    comp = components(pairs).select(F.col("node").alias("rep"), "root")
    return members.join(comp, "rep", "left").select(key, F.coalesce("root", "rep").alias("group"))


def estimate(sig_a: np.ndarray, sig_b: np.ndarray) -> float:
    """Share of equal registers: the unbiased estimate of the weighted Jaccard similarity."""
    return float(np.mean(sig_a == sig_b))


__all__ = ["bag_min_hash", "bags_of_terms", "band_keys", "components", "estimate", "groups", "linked_records", "record_pairs", "similar_pairs"]
