"""How much a term sets one record apart from the whole collection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.counted_join import join_counted
from textloom.runtime import broadcast_if_small, materialize


def dfr_gl2(tf: Column, df: Column, n: Column, length: Column, mean_length: Column, c: float = 1.0) -> Column:
    """Divergence from randomness: geometric model, Laplace after-effect, second normalisation.

    ``tfn = tf * log2(1 + c * mean_length / length)`` is the frequency at a
    standard length. With ``p = df / n`` the information content of ``tfn``
    occurrences under a geometric law of mean ``p`` is
    ``log2(1 + p) + tfn * log2((1 + p) / p)``; the gain of the after-effect is
    ``1 / (tfn + 1)``. The mean is taken from the document frequency, so that
    one record's bursts do not make its own term look ordinary. A null or zero
    input gives null; a length below 1 counts as 1.
    """
    tfn = tf * F.log2(1 + F.lit(float(c)) * mean_length / F.greatest(length, F.lit(1)))
    p = df / n
    score = (F.log2(1 + p) + tfn * F.log2((1 + p) / p)) / (tfn + 1)
    return F.when((tf > 0) & (df > 0) & (n > 0), score)


def unique_postings(postings: DataFrame) -> DataFrame:
    """Copies dropped; ``tf`` is the number of positions where it is null."""
    tf = F.coalesce("tf", F.when(F.col("positions").isNotNull(), F.size("positions")))
    return postings.select("shard", "field", "term", "id", tf.alias("tf")).groupBy("field", "term", "shard", "id").agg(F.max("tf").alias("tf"))


def distinctiveness(postings: DataFrame, doclen: DataFrame, n_records: int, of: DataFrame | None = None, c: float = 1.0) -> DataFrame:
    """``shard, id, field, term, tf, df, score`` for each term of each record's field.

    Document frequencies are counted from the postings themselves over all
    shards, with copies dropped, because stored counts may be stale; a hot term
    is pre-aggregated before its exchange. ``doclen`` gives lengths (copies are
    dropped), ``n_records`` is the number of records. Mean
    lengths are over all records, those without the field included. ``of``
    (``shard, id``) limits the scored records, never the statistics. A posting
    whose length is missing, or with neither ``tf`` nor positions, has a null
    score; one with a null field or term is none. Empty inputs give no rows.
    """
    once = unique_postings(postings)
    if of is None:
        # read twice below
        once = materialize(once, "postings")
    freq = once.where(F.col("field").isNotNull() & F.col("term").isNotNull()).groupBy("field", "term").agg(F.count("*").alias("df"))
    freq = materialize(freq, "freq")
    lens = doclen.groupBy("shard", "id", "field").agg(F.max("len").alias("len"))
    # one line per field name; names of fields are few by the nature of a record, but that is measured
    mean = lens.groupBy("field").agg(F.sum("len").alias("_total")).select(
        F.col("field").alias("_f"), (F.col("_total") / F.lit(float(max(1, n_records)))).alias("_mean")
    )
    mean = broadcast_if_small(materialize(mean, "means"))
    if of is not None:
        wanted = of.select("shard", "id").distinct()
        once = materialize(once.join(wanted, ["shard", "id"], "left_semi"), "postings")
        lens = lens.join(wanted, ["shard", "id"], "left_semi")
    # a hot term's postings stay where they are
    rows = join_counted(once, freq, ["field", "term"], "df").join(lens, ["shard", "id", "field"], "left")
    rows = rows.join(mean, F.col("field") == F.col("_f"), "left")
    score = dfr_gl2(F.col("tf"), F.col("df"), F.lit(float(n_records)), F.col("len"), F.col("_mean"), c)
    return rows.select("shard", "id", "field", "term", "tf", "df", score.alias("score"))


def leading_terms(scores: DataFrame, record: Sequence[str]) -> DataFrame:
    """The term of highest score per record; of equal scores the more frequent one, then the first in order.

    A maximum with a partial step, so a long record is not gathered. Null
    scores never lead.
    """
    # the least term in byte order among equals: compared by a second aggregate, not by a sort
    best = scores.where(F.col("score").isNotNull()).groupBy(*record).agg(F.max(F.struct("score", "tf")).alias("_b"))
    joined = scores.join(best, list(record)).where((F.col("score") == F.col("_b.score")) & (F.col("tf") == F.col("_b.tf")))
    return joined.groupBy(*record).agg(F.min("term").alias("term"))
