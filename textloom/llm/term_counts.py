"""Frequency of every distinct term, by an external sort and a run-length scan."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _changes(cur: pa.Array, last: pa.Scalar | None) -> np.ndarray:
    """True where a value differs from the one before; two nulls are alike."""
    n = len(cur)
    out = np.ones(n, dtype=bool)
    if n > 1:
        a, b = cur[1:], cur[:-1]
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        out[1:] = ~same.to_numpy(zero_copy_only=False)
    if last is not None:
        first = cur[0]
        out[0] = first.is_valid != last.is_valid or (first.is_valid and first.as_py() != last.as_py())
    return out


def _scan(n_record: int):
    """Run-length scan of sorted batches: one output line per run of a term in the partition."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[pa.Scalar] | None = None
        open_term, open_occ, open_rec = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = batch.columns
            new = [_changes(c, last[i] if last else None) for i, c in enumerate(cols)]
            new_term = new[0]
            new_rec = new_term.copy()
            for x in new[1 : 1 + n_record]:
                new_rec |= x
            new_row = new_rec.copy()
            for x in new[1 + n_record :]:
                new_row |= x
            starts = np.flatnonzero(new_term)
            cut = starts[0] if len(starts) else len(new_term)
            open_occ += int(new_row[:cut].sum())
            open_rec += int(new_rec[:cut].sum())
            if len(starts):
                occ = np.add.reduceat(new_row.astype(np.int64), starts)
                rec = np.add.reduceat(new_rec.astype(np.int64), starts)
                terms = cols[0].take(pa.array(starts))
                if open_term is not None:
                    head = pa.array([open_term], cols[0].type)
                    full = pa.concat_arrays([head, terms[:-1]])
                    yield _line(full, np.r_[open_occ, occ[:-1]], np.r_[open_rec, rec[:-1]])
                elif len(starts) > 1:
                    yield _line(terms[:-1], occ[:-1], rec[:-1])
                open_term, open_occ, open_rec = terms[-1].as_py(), int(occ[-1]), int(rec[-1])
            last = [c[len(c) - 1] for c in cols]
        if open_term is not None:
            yield _line(pa.array([open_term], pa.string()), np.array([open_occ]), np.array([open_rec]))

    return scan


def _line(terms: pa.Array, occ: np.ndarray, rec: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([terms.cast(pa.string()), pa.array(occ, pa.int64()), pa.array(rec, pa.int64())], ["term", "occurrences", "records"])


def term_counts(tokens: DataFrame, term: str = "term", record: Sequence[str] = ("shard", "id"), place: Sequence[str] = ("field", "position")) -> DataFrame:
    """``term, occurrences, records`` for every distinct term over the whole collection.

    The rows (term, record, place) are range-partitioned by term and record, so
    a term that holds a large part of the rows is cut into many ranges and no
    record is cut; each range is sorted externally and scanned once. Copies of
    a row are neighbours then and count once. The few terms that lie across a
    range bound are added up at the end. Null terms are no terms; a null in
    ``record`` or ``place`` is a value like any other. An empty table gives no
    rows; other columns, whatever their names, are not read.
    """
    cols = [F.col(term).alias("_t"), *[F.col(c).alias(f"_r{i}") for i, c in enumerate(record)], *[F.col(c).alias(f"_p{i}") for i, c in enumerate(place)]]
    rows = tokens.select(*cols).where(F.col("_t").isNotNull())
    rec = [f"_r{i}" for i in range(len(record))]
    spread = rows.repartitionByRange("_t", *rec).sortWithinPartitions(*rows.columns)
    runs = spread.mapInArrow(_scan(len(rec)), "term string, occurrences long, records long")
    return runs.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def mark(records: Column, n_records: int, common_share: float = 0.1) -> Column:
    """``rare`` for a term of exactly one record, ``common`` from ``common_share`` of all records on, else null.

    A term of one record is rare even where one record is a tenth of them all.
    """
    return F.when(records == 1, "rare").when(records >= F.lit(common_share) * n_records, "common")
