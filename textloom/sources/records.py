"""The log of added records and the view of its current state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.patterns import WHITE_SPACE

BLANK = f"^[{WHITE_SPACE}]*$"


def accepted(id_col: Column, fields: Column) -> Column:
    """True for rows that the engine takes: an id that is not blank, and at least one field."""
    return F.coalesce(~id_col.rlike(BLANK), F.lit(False)) & (F.coalesce(F.size(fields), F.lit(0)) > 0)


def current_records(records: DataFrame, *names: str) -> DataFrame:
    """``seq, shard, id`` and the named fields of each current record.

    A record is one ``(shard, id)``; its current row is the accepted one with
    the highest ``seq``. Rows delivered twice count once. Fields are taken out
    of the map before the exchange, so unused texts are not moved. The choice
    is an aggregate with a partial step: a key that was added very often does
    not gather its rows in one task. A null field stays null.
    """
    rows = records.where(accepted(F.col("id"), F.col("fields"))).select(
        "seq", "shard", "id", *[F.col("fields").getItem(n).alias(f"f_{i}") for i, n in enumerate(names)]
    )
    if not names:
        return rows.groupBy("shard", "id").agg(F.max("seq").alias("seq")).select("seq", "shard", "id")
    best = rows.groupBy("shard", "id").agg(
        F.max("seq").alias("seq"), F.max_by(F.struct(*[f"f_{i}" for i in range(len(names))]), "seq").alias("f")
    )
    return best.select("seq", "shard", "id", *[F.col(f"f.f_{i}").alias(n) for i, n in enumerate(names)])
