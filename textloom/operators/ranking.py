"""Exact ranks over a sorted collection without one big window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.runtime import broadcast_if_small, materialize

_LOW = (1 << 33) - 1


def global_rank(df: DataFrame, keys: list[str], order: list[str], label: str = "ranked") -> DataFrame:
    """Add ``rank`` (0-based within ``keys``) and ``position`` (0-based over all rows).

    The rows are range-partitioned by ``keys + order`` and sorted inside their
    partition, so a key that holds most rows simply spans many partitions. Only
    one line per (partition, key) is aggregated to turn local positions into
    global ones; no task ever sees a whole key. ``order`` must make rows
    distinct where a stable result is wanted; equal rows rank in any order.
    Nulls sort first. An empty table gives an empty table.
    """
    spread = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    spread = spread.withColumn("_at", F.monotonically_increasing_id())
    spread = materialize(
        spread.withColumn("_part", F.shiftright("_at", 33).cast("int")).withColumn("_local", F.col("_at").bitwiseAND(F.lit(_LOW))).drop("_at"),
        label,
    )
    runs = spread.groupBy("_part", *keys).agg(F.count("*").alias("_n"), F.min("_local").alias("_first"))
    parts = runs.groupBy("_part").agg(F.sum("_n").alias("_all"))
    # one line per partition: a single-task prefix sum over the partition count only
    parts = parts.withColumn("_base", F.sum("_all").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    parts = parts.select("_part", F.coalesce("_base", F.lit(0)).alias("_base"))
    runs = runs.join(broadcast_if_small(materialize(parts, label + "-parts")), "_part")
    same = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(same), F.lit(0)))
    runs = broadcast_if_small(materialize(runs, label + "-runs"))
    cond = [spread["_part"] == runs["_part"]] + [spread[k].eqNullSafe(runs[k]) for k in keys]
    return spread.join(runs, cond).select(
        *[spread[c] for c in df.columns],
        (runs["_before"] + spread["_local"] - runs["_first"]).alias("rank"),
        (runs["_base"] + spread["_local"]).alias("position"),
    )
