"""Filling fixed-capacity containers with whole texts: bulk-synchronous best fit.

Documents and gaps are kept sorted by size. Sizes are whole tokens, so both
sorted sequences are held run-length encoded: so many documents of each size,
so many containers of each gap. One superstep takes the largest size left and
sweeps the gaps upward from it: the smallest gap that is large enough is the
successor of all documents of that size at once; where they outnumber the
places, their rank decides who gets in and the others go on to the next gap;
those that find none open containers. Then the gaps are updated and the next
size follows. The outcome is that of best fit decreasing, one document at a
time. What depends on the documents - sizes, ranks, counts and the lookup of
each rank's container - is distributed over them. The sweep of a kind costs
time and memory by its capacity, not by the number of documents, and is one
task; the kinds are swept side by side.
"""

from __future__ import annotations

import bisect
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.ranking import global_rank
from textloom.runtime import broadcast_if_small, materialize

#: Runs are matched to items by stretches of so many positions.
STRETCH_BITS = 14


def best_fit_runs(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Runs ``(size, n, container, per)`` in order of size descending, and the number of containers.

    The run places the next ``n`` documents of ``size``, ``per`` each, into
    containers numbered from ``container``. ``sizes`` are distinct and between
    1 and ``capacity``.
    """
    gaps: list[int] = []
    free: dict[int, deque[tuple[int, int]]] = {}
    runs: list[tuple[int, int, int, int]] = []
    opened = 0

    def add(gap: int, base: int, n: int) -> None:
        if gap <= 0 or n <= 0:
            return
        if gap not in free:
            free[gap] = deque()
            bisect.insort(gaps, gap)
        q = free[gap]
        if q and q[-1][0] + q[-1][1] == base:
            q[-1] = (q[-1][0], q[-1][1] + n)
        else:
            q.append((base, n))

    def put(size: int, left: int, gap: int, base: int, n: int) -> int:
        """Place up to ``left`` documents into ``n`` containers of one gap; returns how many were placed."""
        per = gap // size
        placed = min(left, per * n)
        runs.append((size, placed, base, per))
        whole, odd = divmod(placed, per)
        add(gap - per * size, base, whole)
        if odd:
            add(gap - odd * size, base + whole, 1)
        add(gap, base + whole + (1 if odd else 0), n - whole - (1 if odd else 0))
        return placed

    for i in np.argsort(-sizes, kind="stable"):
        size, left = int(sizes[i]), int(counts[i])
        while left:
            at = bisect.bisect_left(gaps, size)
            if at == len(gaps):
                per = capacity // size
                n = -(-left // per)
                left -= put(size, left, capacity, opened, n)
                opened += n
                continue
            gap = gaps[at]
            q = free[gap]
            base, n = q.popleft()
            if not q:
                del free[gap]
                gaps.pop(at)
            left -= put(size, left, gap, base, n)
    return runs, opened


def _kinds(containers: DataFrame) -> DataFrame:
    """``kind, cap`` of the usable kinds of containers; of several capacities of a kind the largest counts."""
    got = containers.where(F.col("container_kind").isNotNull() & (F.col("capacity_tokens") > 0))
    return got.groupBy(F.col("container_kind").alias("kind")).agg(F.max("capacity_tokens").cast("long").alias("cap"))


def pieces(sizes: DataFrame, kinds: list[tuple[str, int]]) -> DataFrame:
    """``kind, doc_id, piece, first_token, tokens``: each document once per kind, cut only where it exceeds the capacity."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).cast("long").alias("cap")) for k, c in kinds])
    rows = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n"), F.explode(each).alias("c"))
    last = F.greatest(F.ceil(F.col("n") / F.col("c.cap")).cast("long") - 1, F.lit(0))
    rows = rows.select("doc_id", "n", F.col("c.kind").alias("kind"), F.col("c.cap").alias("cap"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    return rows.select("kind", "doc_id", "piece", (F.col("piece") * F.col("cap")).alias("first_token"), F.least("cap", F.col("n") - F.col("piece") * F.col("cap")).alias("tokens"))


def _sweep(frame: pd.DataFrame) -> pd.DataFrame:
    """Runs of one kind, from its counts by size: ``kind, tokens, start, stop, base, per``, a run holding the items from one position up to another."""
    frame = frame.sort_values("tokens")
    kind, capacity = frame["kind"].iloc[0], int(frame["cap"].iloc[0])
    at = dict(zip(frame["tokens"].tolist(), frame["at"].tolist()))
    rows = [(kind, 0, at[0], at[0] + int(frame["n"].iloc[0]), 0, 0)] if 0 in at else []
    real = frame[frame["tokens"] > 0]
    for size, n, base, per in best_fit_runs(real["tokens"].to_numpy(), real["n"].to_numpy(), capacity)[0]:
        rows.append((kind, size, at[size], at[size] + n, base, per))
        at[size] += n
    return pd.DataFrame(rows, columns=["kind", "tokens", "start", "stop", "base", "per"])


def pack(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """``kind, container, doc_id, piece, first_token, tokens`` for every document and kind of container.

    ``sizes``: ``doc_id, n_tokens``; ``containers``: ``container_kind,
    capacity_tokens``. Containers are numbered from 0 within a kind. A document
    larger than the capacity is cut into full pieces and a rest; no other is
    cut. A document without tokens takes no room and lies in container 0. Kinds
    with a null name or a capacity below 1 are left out; no kinds or no
    documents give no rows. Equal sizes are placed in order of id and piece.

    The items are range-sorted by kind and size. Each kind's sweep is a task of
    its own over at most ``capacity`` counts; its runs go to the ranges of items
    that they cover, so neither items nor counts come to the driver, which
    reads the kinds alone: they are a parameter.
    """
    kinds = sorted((r["kind"], r["cap"]) for r in _kinds(containers).collect())
    spark = sizes.sparkSession
    if not kinds:
        kind = sizes.schema["doc_id"].dataType.simpleString()
        return spark.createDataFrame([], f"kind string, container long, doc_id {kind}, piece long, first_token long, tokens long")
    items = pieces(sizes, kinds).withColumn("_down", -F.col("tokens"))
    ranked = materialize(global_rank(items, ["kind", "_down"], ["doc_id", "piece"], "items").drop("_down", "rank"), "ranked")
    counts = ranked.groupBy("kind", "tokens").agg(F.count("*").alias("n"), F.min("position").alias("at"))
    counts = counts.join(F.broadcast(spark.createDataFrame(kinds, "kind string, cap long")), "kind")
    runs = counts.groupBy("kind").applyInPandas(_sweep, "kind string, tokens long, start long, stop long, base long, per long")
    # a run goes to each stretch of positions that it touches: as many lines as runs and stretches
    touched = F.sequence(F.shiftright("start", STRETCH_BITS), F.shiftright(F.col("stop") - 1, STRETCH_BITS))
    runs = broadcast_if_small(materialize(runs.withColumn("_stretch", F.explode(touched)), "runs"))
    rows = ranked.withColumn("_stretch", F.shiftright("position", STRETCH_BITS)).join(runs, ["kind", "tokens", "_stretch"])
    rows = rows.where((F.col("position") >= F.col("start")) & (F.col("position") < F.col("stop")))
    place = F.when(F.col("per") > 0, F.floor((F.col("position") - F.col("start")) / F.greatest("per", F.lit(1)))).otherwise(0)
    return rows.select("kind", (F.col("base") + place).alias("container"), "doc_id", "piece", "first_token", "tokens")


def fill(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """``kind, capacity, container, texts, tokens, fill``: the load of each container."""
    load = packed.groupBy("kind", "container").agg(F.count("*").alias("texts"), F.sum("tokens").alias("tokens"))
    caps = broadcast_if_small(materialize(_kinds(containers), "kinds"))
    return load.join(caps, "kind").select(
        "kind", F.col("cap").alias("capacity"), "container", "texts", "tokens", (F.col("tokens") / F.col("cap")).alias("fill")
    )
