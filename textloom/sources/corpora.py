"""Anything Spark can read as a corpus ``id STRING, fields MAP<STRING,STRING>``."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.sources.records import accepted


def corpus(df: DataFrame, doc_id: str | Column, fields: Mapping[str, str | Column]) -> DataFrame:
    """Rows as documents. A null value leaves its field out; an empty one stays. Ids and values are cast to strings."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    entries = F.array(*[F.struct(F.lit(n).alias("key"), as_col(c).cast("string").alias("value")) for n, c in fields.items()])
    return df.select(as_col(doc_id).cast("string").alias("id"), F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("fields"))


def corpus_of_records(records: DataFrame) -> DataFrame:
    """The current records of all shards as one corpus; ids are ``shard/id``. Rows the engine refuses are left out.

    The latest row of a record is found from light columns first, so that texts
    travel only once and a record that was added very often gathers in no task.
    """
    ok = records.where(accepted(F.col("id"), F.col("fields")))
    last = ok.groupBy("shard", "id").agg(F.max("seq").alias("seq"))
    # rows delivered twice are equal; one of them is taken
    texts = ok.select("seq", "shard", "id", F.array_sort(F.map_entries("fields")).alias("e")).join(last, ["seq", "shard", "id"], "left_semi")
    one = texts.groupBy("seq", "shard", "id").agg(F.min("e").alias("e"))
    fields = F.map_from_entries(F.filter("e", lambda x: x["value"].isNotNull()))
    return one.select(F.concat_ws("/", F.col("shard").cast("string"), "id").alias("id"), fields.alias("fields"))
