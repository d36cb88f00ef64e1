"""Incremental indexing of a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.operators.index_tables import invalid_documents, valid_documents
from textloom.runtime import materialize, scope
from textloom.sources.store import StoredIndex


def ingest(documents: DataFrame, index: StoredIndex, checkpoint: str, order: str | None = None, refused: str | None = None, **trigger) -> StreamingQuery:
    """Add every micro-batch of a streaming ``documents(id, fields[, order])`` to a stored index.

    A batch costs its own size (see :class:`StoredIndex`) and, delivered again
    after a failure, gives the same index, since adding is an upsert by id.
    Rows of a stream have no order of their own: of several with one id in a
    batch the last in ``order`` counts, and without an order a batch in which
    an id repeats with different fields stops the stream. Invalid documents
    cannot stop it: they are left out and, if ``refused`` names a folder,
    appended there with the number of their batch (a batch delivered again
    replaces its own rows).
    """

    def add(batch: DataFrame, number: int) -> None:
        with scope():
            one_batch(materialize(batch, "micro-batch"), number)

    def one_batch(batch: DataFrame, number: int) -> None:
        bad = invalid_documents(batch)
        if refused:
            bad.write.mode("overwrite").parquet(f"{refused.rstrip('/')}/batch={number}")
        good = valid_documents(batch)
        if not order:
            # equal rows delivered twice are one
            entries = good.select("id", F.array_sort(F.map_entries("fields")).alias("e")).distinct()
            good = entries.select("id", F.map_from_entries("e").alias("fields"))
        if not good.isEmpty():
            index.add_batch(good, order)

    return documents.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
