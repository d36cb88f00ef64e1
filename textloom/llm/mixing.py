"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.ranking import global_rank

#: Expected copies are whole multiples of 2**-UNIT_BITS, so that running sums are exact.
UNIT_BITS = 24

#: Sizes of a mixture that follow from the data.
ALL, EXACT = "all", "exact"

#: Most sources a plan may have; the plan is held by the driver.
MAX_SOURCES = 100_000


def plan_mix(sizes: DataFrame, targets: DataFrame, total_tokens: int | str = ALL) -> list[dict]:
    """One entry per source of ``targets``: tokens at hand, wanted tokens and expected copies of each document.

    ``total_tokens`` is the wanted size of the mixture: a number, ``ALL`` for as
    many tokens as the listed sources hold, or ``EXACT`` for the largest size at
    which every source that has tokens still reaches its share within its
    ``max_repeat``. A source that cannot reach its share of the total is
    repeated as often as it may be, and the rest of the total is spread over the
    others in proportion to their shares, so that these keep their proportions.
    Shares are taken relative to those of the sources that have tokens. Null or
    negative shares and repeats count as 0.
    """
    have = sizes.where(F.col("n_tokens") > 0).groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    t = targets.groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeat").alias("repeat"))
    rows = t.join(have, "source", "left").select("source", "share", "repeat", F.coalesce("tokens", F.lit(0)).alias("tokens")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError("too many sources")
    plan = [
        {"source": r["source"], "share": max(0.0, r["share"] or 0.0), "repeat": max(0, r["repeat"] or 0), "tokens": int(r["tokens"])}
        for r in rows
        if r["source"] is not None
    ]
    plan.sort(key=lambda p: p["source"])
    live = [p for p in plan if p["tokens"] > 0 and p["share"] > 0 and p["repeat"] > 0]
    weight = sum(p["share"] for p in live)
    if total_tokens == ALL:
        total_tokens = sum(p["tokens"] for p in live)
    elif live and total_tokens == EXACT:
        total_tokens = min(p["repeat"] * p["tokens"] * weight / p["share"] for p in live)
    for p in plan:
        p["wanted"] = 0.0
    rest, left = list(live), float(total_tokens) if live else 0.0
    while rest:
        w = sum(p["share"] for p in rest)
        full = [p for p in rest if left * p["share"] / w >= p["repeat"] * p["tokens"]]
        if not full:
            for p in rest:
                p["wanted"] = left * p["share"] / w
            break
        for p in full:
            p["wanted"] = float(p["repeat"] * p["tokens"])
            rest.remove(p)
        left -= sum(p["wanted"] for p in full)
    for p in plan:
        p["units"] = min(p["repeat"] << UNIT_BITS, round(p["wanted"] / p["tokens"] * 2**UNIT_BITS)) if p["tokens"] else 0
    return plan


def _offset(seed: int, source: str) -> int:
    """The random start of a source, in units."""
    return int.from_bytes(hashlib.sha256(f"{seed}:{source}".encode()).digest()[:8], "big") % (1 << UNIT_BITS)


def crossed(rank: Column, units: Column, start: Column) -> Column:
    """Whole numbers that the running sum ``start + rank * units`` crosses with one more document.

    The high bits of the rank add whole numbers alone, so only the low ones are
    multiplied: no rank is too large.
    """
    at = rank.bitwiseAND(F.lit((1 << UNIT_BITS) - 1)) * units + start
    return F.shiftright(at + units, UNIT_BITS) - F.shiftright(at, UNIT_BITS)


def mix(sizes: DataFrame, targets: DataFrame, total_tokens: int | str = ALL, seed: int = 0) -> DataFrame:
    """``doc_id, source, n_tokens, copies`` of every chosen document.

    ``sizes``: ``doc_id, source, n_tokens``; ``targets``: ``source,
    target_share, max_repeat``. Inside a source the documents stand in order of
    size (then id); the running sum of their expected copies, started at one
    random offset, yields a copy at each whole number it crosses. A document
    thus gets its expected number of copies, rounded up or down, never more
    than ``max_repeat``, and each range of sizes is drawn on alike. The running
    sum is an exact distributed rank times a constant, so a source that holds a
    third of all rows is cut into many ranges. Documents without tokens or of a
    null or unlisted source are never chosen. Documents with equal ids are
    documents of their own.
    """
    plan = plan_mix(sizes, targets, total_tokens)
    spark = sizes.sparkSession
    table = spark.createDataFrame([(p["source"], p["units"], _offset(seed, p["source"])) for p in plan if p["units"] > 0], "source string, units long, start long")
    rows = sizes.where((F.col("n_tokens") > 0) & F.col("source").isNotNull()).select("doc_id", "source", "n_tokens")
    ranked = global_rank(rows, ["source"], ["n_tokens", "doc_id"], "mix").drop("position")
    # the plan has at most MAX_SOURCES lines
    ranked = ranked.join(F.broadcast(table), "source")
    copies = crossed(F.col("rank"), F.col("units"), F.col("start"))
    return ranked.select("doc_id", "source", "n_tokens", copies.alias("copies")).where(F.col("copies") > 0)


def mix_shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, max_repeat, documents, copies, tokens, actual_share`` for each listed source."""
    t = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeat").alias("max_repeat"))
    got = chosen.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = t.join(got, "source", "left").select("source", "target_share", "max_repeat", zero("documents"), zero("copies"), zero("tokens"))
    total = got.agg(F.sum("tokens")).first()[0]
    share = F.col("tokens") / F.lit(float(total)) if total else F.lit(0.0)
    return rows.select(*rows.columns, share.alias("actual_share"))
