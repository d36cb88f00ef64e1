"""Session plumbing: the shared folder, written intermediate tables, size checks."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Largest table, in bytes, that this library ever sends to every executor.
BROADCAST_LIMIT = 64 * 1024 * 1024

_written: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver found it.

    Workers on this machine get its folder on their path; on a cluster, where
    that folder need not exist, they get the package as an archive.
    """
    sc = spark.sparkContext
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
    if home in paths:
        return
    sc.environment["PYTHONPATH"] = os.pathsep.join([home, *filter(None, paths)])
    if not sc.master.startswith("local"):
        made = tempfile.mkdtemp()
        # Spark takes its own copy and hands it to the executors
        sc.addPyFile(shutil.make_archive(os.path.join(made, "textloom"), "zip", home, "textloom"))
        atexit.register(shutil.rmtree, made, True)


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, as named by ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is made, but only in
    single-machine local mode; on a cluster its absence is an error, since a
    machine-local folder would lose data with its machine.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="textloom-")
    spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage, fixes everything nondeterministic (range bounds,
    partition numbers) and survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:
        pass


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` from which nothing will be read again, as the last round of a loop."""
    for t in tables:
        path = getattr(t, "_written_at", None)
        for entry in [x for x in _written if x[1] == path]:
            _written.remove(entry)
            _delete(*entry)


def release(since: int = 0) -> None:
    """Delete the tables that :func:`materialize` has written in this process, but for the first ``since``."""
    while len(_written) > since:
        _delete(*_written.pop())


@contextmanager
def scope() -> Iterator[None]:
    """Deletes at its end the tables written inside it: for work whose results have been written or fetched by then."""
    since = len(_written)
    try:
        yield
    finally:
        release(since)


atexit.register(release)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate; exact to within compression for a written table."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast only when the measured size of ``df`` is under ``limit``.

    Meant for materialised tables, whose size is known; beyond the limit the
    join is left to Catalyst, which then shuffles both sides.
    """
    from pyspark.sql import functions as F

    return F.broadcast(df) if estimated_bytes(df) * 4 <= limit else df
