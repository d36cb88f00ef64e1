"""Stores: versions of tables in a folder with an atomically replaced manifest, and ordered key-value stores."""

from __future__ import annotations

import json
import threading
import time
import uuid
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.model import DOCUMENTS, POSTINGS, STATS, CorruptIndexError, DocumentMissingError, InvalidDocumentError, KeyNotFoundError, StoreClosedError
from textloom.operators.index_tables import BLANK, IndexTables
from textloom.operators.search_index import IndexConfig, SearchIndex, fresh_tables, new_index
from textloom.runtime import broadcast_if_small, estimated_bytes, materialize, scope, shared_dir


#: Seconds after which a writer that no longer renews its claim counts as dead.
LEASE_SECONDS = 3600.0


class Folder:
    """A folder in any file system that Spark can reach. Each commit writes a new version; readers never see half of one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)

    def _read(self, name: str) -> bytes | None:
        p = self._path(f"{self.path}/{name}")
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def _write(self, name: str, data: bytes, overwrite: bool) -> None:
        stream = self._fs.create(self._path(f"{self.path}/{name}"), overwrite)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def manifest(self) -> dict:
        """What is published: ``version`` (0 where there is nothing) and what the writer said of it."""
        raw = self._read("MANIFEST")
        if raw is None:
            return {"version": 0}
        try:
            found = json.loads(raw)
            return found | {"version": int(found["version"])}
        except (ValueError, KeyError, TypeError) as e:
            raise CorruptIndexError("unreadable manifest") from e

    def version(self) -> int:
        return self.manifest()["version"]

    def at(self, part: str, table: str) -> str:
        """Where a table of a part lies; a part of another folder has its whole path for a name."""
        return f"{part if '/' in part else f'{self.path}/{part}'}/{table}"

    def commit(self, base: int, tables: list[tuple[str, DataFrame]], say: Callable[[str], dict]) -> int:
        """Write all tables into a new part and publish version ``base + 1`` in one rename.

        Who first makes the claim file of a version owns it; a second writer
        from the same base fails and nothing of its work becomes visible. A
        claim is a lease: its owner renews it, and one that has not been renewed
        for ``LEASE_SECONDS`` is of a writer that died and may be taken over.
        Whoever lost a claim does not publish. ``say(part)`` is what the
        manifest tells of the version; each try has a part of its own.
        """
        new = base + 1
        if self.version() != base:
            raise RuntimeError("another writer has published since")
        claim, owner = f"CLAIM-{new}", uuid.uuid4().hex
        self._take(claim, owner)
        part = f"v{new}-{owner}"
        try:
            with self._beating(claim, owner):
                for name, df in tables:
                    df.write.parquet(self.at(part, name))
            self._renew(claim, owner)
            if self.version() != base:
                raise RuntimeError("another writer has published since")
            temp = f"MANIFEST-{owner}"
            self._write(temp, json.dumps(say(part) | {"version": new}).encode(), True)
            self._replace(temp, "MANIFEST")
        except BaseException:
            self._fs.delete(self._path(f"{self.path}/{part}"), True)
            raise
        finally:
            if self._owner(claim)[0] == owner:
                self._fs.delete(self._path(f"{self.path}/{claim}"), False)
        return new

    def _owner(self, claim: str) -> tuple[str | None, float]:
        """Owner of a claim and the time of its last renewal; of an unreadable one the file's own time."""
        try:
            raw = self._read(claim)
            if raw is None:
                return None, 0.0
            found = json.loads(raw)
            return found["owner"], float(found["time"])
        except (ValueError, KeyError, TypeError):
            return None, self._fs.getFileStatus(self._path(f"{self.path}/{claim}")).getModificationTime() / 1000

    def _take(self, claim: str, owner: str) -> None:
        told = lambda: json.dumps({"owner": owner, "time": time.time()}).encode()
        try:
            self._write(claim, told(), False)
            return
        except Exception as e:
            _, at = self._owner(claim)
            if time.time() - at <= LEASE_SECONDS:
                raise RuntimeError("another writer is publishing") from e
        # of several that find it dead one moves it away
        stale = self._path(f"{self.path}/{claim}-{owner}")
        if not self._fs.rename(self._path(f"{self.path}/{claim}"), stale):
            raise RuntimeError("another writer is publishing")
        self._fs.delete(stale, False)
        try:
            self._write(claim, told(), False)
        except Exception as e:
            raise RuntimeError("another writer is publishing") from e

    def _renew(self, claim: str, owner: str) -> None:
        if self._owner(claim)[0] != owner:
            raise RuntimeError("the claim was lost to another writer")
        self._write(claim, json.dumps({"owner": owner, "time": time.time()}).encode(), True)

    @contextmanager
    def _beating(self, claim: str, owner: str) -> Iterator[None]:
        """Renews a claim from time to time while the work goes on."""
        over = threading.Event()

        def beat() -> None:
            while not over.wait(LEASE_SECONDS / 4):
                try:
                    self._renew(claim, owner)
                except RuntimeError:
                    return

        thread = threading.Thread(target=beat, daemon=True)
        thread.start()
        try:
            yield
        finally:
            over.set()
            thread.join()

    def parts(self) -> list[str]:
        """Names of all parts in the folder, published or not."""
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path)) if s.isDirectory() and s.getPath().getName().startswith("v")]

    def drop(self, part: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{part}"), True)

    def _replace(self, source: str, target: str) -> None:
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        how = gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        a, b = self._path(f"{self.path}/{source}"), self._path(f"{self.path}/{target}")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        context.rename(self._fs.makeQualified(a), self._fs.makeQualified(b), how)


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


#: Up to so many ids are looked up as constants, which prune files; more are joined.
LITERAL_IDS = 2000
#: From so many segments on, those of a key-value store are merged.
MERGE_SEGMENTS = 8
#: Tables up to so many bytes are written as one file.
ONE_FILE = 4 << 20
#: Versions whose parts a manifest remembers.
HISTORY = 8


def _with_ids(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of ``df`` with (``left_semi``) or without (``left_anti``) the ids of a written table."""
    few = [r["id"] for r in ids.select("id").limit(LITERAL_IDS + 1).collect()]
    if how == "left_semi" and len(few) <= LITERAL_IDS:
        return df.where(F.col("id").isin(few)) if few else df.limit(0)
    return df.join(broadcast_if_small(ids.select("id")), "id", how)


def vectors_of(postings: DataFrame, doclen: DataFrame) -> DataFrame:
    """``id, field, len, terms`` with the terms of each field of each document and their frequencies."""
    terms = postings.groupBy("id", "field").agg(F.collect_list(F.struct("term", "tf")).alias("terms"))
    return doclen.join(terms, ["id", "field"], "left").select("id", "field", "len", F.coalesce("terms", F.array().cast("array<struct<term:string,tf:int>>")).alias("terms"))


class StoredIndex:
    """A persistent index: every write publishes a new version as a whole, or nothing.

    A version is a list of segments. Adding or deleting writes one segment of
    its own size: the new documents with their postings and vectors, the ids
    that earlier segments no longer hold, and signed changes of the dictionary.
    The totals lie in the manifest. Readers take the segments together. As
    small segments gather they are merged into one of the next size, so that
    each document is written again a few times only, whatever the index holds.
    """

    TABLES = ("documents", "postings", "terms", "vectors", "gone")

    def __init__(self, spark: SparkSession, path: str, config: IndexConfig | None = None):
        self._folder, self.config, self._closed = Folder(spark, path), config or IndexConfig(), False
        if not self._folder.version():
            self._publish(new_index(spark, self.config), self._folder.manifest())

    def _manifest(self) -> dict:
        if self._closed:
            raise StoreClosedError(self._folder.path)
        return self._folder.manifest()

    def fork(self, path: str) -> "StoredIndex":
        """A new index in ``path`` that begins as this one is now and goes its own way.

        Nothing is copied: its first segments are those of this index, which
        must not be vacuumed before the new one has merged or rebuilt them.
        """
        manifest, folder = self._manifest(), Folder(self._folder.spark, path)
        here = [x | {"part": x["part"] if "/" in x["part"] else f"{self._folder.path}/{x['part']}"} for x in manifest["segments"]]
        folder.commit(0, [], lambda part: manifest | {"segments": here, "history": []})
        return StoredIndex(folder.spark, path, self.config)

    def _table(self, segments: list[dict], name: str) -> DataFrame:
        """Rows of the segments that no later one of them has removed."""
        spark = self._folder.spark
        read = lambda x: spark.read.parquet(self._folder.at(x["part"], name))
        if name in ("terms", "gone"):
            return reduce(DataFrame.unionByName, [read(x) for x in segments])
        out = None
        for i, x in enumerate(segments):
            rows, later = read(x), [y for y in segments[i + 1 :] if y["gone"]]
            if later:
                rows = rows.join(broadcast_if_small(self._table(later, "gone").distinct()), "id", "left_anti")
            out = rows if out is None else out.unionByName(rows)
        return out

    @staticmethod
    def _gone_rows(segments: list[dict]) -> int:
        return sum(x["gone"] for x in segments)

    def _index(self, manifest: dict) -> SearchIndex:
        spark, segments = self._folder.spark, manifest["segments"]
        terms = self._table(segments, "terms")
        if len(segments) > 1:
            terms = terms.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("total_tf").alias("total_tf")).where(F.col("df") > 0)
        stats = spark.createDataFrame([(manifest["documents"], manifest["lengths"])], STATS)
        doclen = self._table(segments, "vectors").select("id", "field", "len")
        return SearchIndex(IndexTables(self._table(segments, "documents"), self._table(segments, "postings"), terms, doclen, stats), self.config)

    def snapshot(self) -> SearchIndex:
        """The published version; it stays readable whatever is written later."""
        return self._index(self._manifest())

    @staticmethod
    def _sorted(name: str, df: DataFrame) -> DataFrame:
        """The order in which a reader prunes: all postings of a term lie together, in order of id."""
        keys = {"postings": ("field", "term", "id"), "terms": ("field", "term")}.get(name, ("id",))
        # what one file holds needs no ranges
        return (df.coalesce(1) if estimated_bytes(df) <= ONE_FILE else df.repartitionByRange(*keys)).sortWithinPartitions(*keys)

    def _commit(self, manifest: dict, keep: list[dict], tables: dict[str, DataFrame], segment: dict, documents: int, lengths: dict[str, int]) -> None:
        def say(part: str) -> dict:
            segments = [*keep, segment | {"part": part}]
            past = [[x["part"] for x in manifest.get("segments", [])], *manifest.get("history", [])]
            return {"segments": segments, "documents": documents, "lengths": lengths, "history": past[:HISTORY]}

        self._folder.commit(manifest["version"], [(n, self._sorted(n, tables[n])) for n in self.TABLES], say)

    def _publish(self, index: SearchIndex, manifest: dict) -> None:
        """A whole index as one segment."""
        t, spark = index.tables, self._folder.spark
        vectors = vectors_of(t.postings, t.doclen)
        tables = {"documents": t.documents, "postings": t.postings, "terms": t.terms, "vectors": vectors, "gone": spark.createDataFrame([], "id string")}
        n, lengths = index.stats()
        self._commit(manifest, [], tables, {"docs": n, "gone": 0}, n, lengths)

    def write(self, change: Callable[[SearchIndex], SearchIndex]) -> SearchIndex:
        """Publish what ``change`` makes of the present snapshot, as a whole; if it raises, nothing changes."""
        manifest = self._manifest()
        self._publish(change(self._index(manifest)), manifest)
        return self.snapshot()

    def _append(self, manifest: dict, fresh: IndexTables | None, gone: DataFrame) -> SearchIndex:
        """A segment with ``fresh`` that takes the place of the documents ``gone``."""
        spark, segments = self._folder.spark, manifest["segments"]
        lost = materialize(_with_ids(self._table(segments, "vectors"), gone, "left_semi"), "lost")
        flat = lost.select("field", F.explode("terms").alias("t")).select("field", "t.term", "t.tf")
        terms = flat.groupBy("field", "term").agg((-F.count("*")).alias("df"), (-F.sum("tf").cast("long")).alias("total_tf"))
        lengths, docs, added = dict(manifest["lengths"]), manifest["documents"], 0
        removed = gone.count()
        for r in lost.groupBy("field").agg(F.sum("len").alias("n"), F.count("*").alias("c")).collect():
            lengths[r["field"]] = lengths[r["field"]] - r["n"]
        if fresh:
            terms = terms.unionByName(fresh.terms).groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("total_tf").alias("total_tf")).where((F.col("df") != 0) | (F.col("total_tf") != 0))
            stats = fresh.stats.first()
            added = stats["document_count"]
            for name, n in (stats["total_field_length"] or {}).items():
                lengths[name] = lengths.get(name, 0) + n
            tables = {"documents": fresh.documents, "postings": fresh.postings, "vectors": vectors_of(fresh.postings, fresh.doclen)}
        else:
            empty = lambda schema: spark.createDataFrame([], schema)
            tables = {"documents": empty(DOCUMENTS), "postings": empty(POSTINGS), "vectors": empty("id string, field string, len int, terms array<struct<term:string,tf:int>>")}
        segment = {"docs": added, "gone": removed}
        self._commit(manifest, segments, tables | {"terms": terms, "gone": gone.select("id")}, segment, docs - removed + added, lengths)
        self.compact()
        return self.snapshot()

    def add_batch(self, documents: DataFrame, order: str | None = None) -> SearchIndex:
        """``SearchIndex.add_batch`` as a segment: costs what the batch and the documents it replaces cost."""
        with scope():
            manifest = self._manifest()
            fresh = fresh_tables(documents, order, self.config)
            old = _with_ids(self._table(manifest["segments"], "documents").select("id"), fresh.documents, "left_semi")
            return self._append(manifest, fresh, materialize(old, "gone"))

    def delete(self, *ids: str) -> SearchIndex:
        return self.delete_all(self._folder.spark.createDataFrame([(i,) for i in ids], "id string"))

    def delete_all(self, ids: DataFrame) -> SearchIndex:
        """Deletes the documents of a table of ids; a blank or unknown one is an error and changes nothing."""
        with scope():
            manifest = self._manifest()
            wanted = materialize(ids.select("id").distinct(), "ids")
            if not wanted.where(F.col("id").isNull() | F.col("id").rlike(BLANK)).isEmpty():
                raise InvalidDocumentError("blank id")
            gone = materialize(_with_ids(self._table(manifest["segments"], "documents").select("id"), wanted, "left_semi"), "gone")
            if missing := wanted.join(gone, "id", "left_anti").take(1):
                raise DocumentMissingError(missing[0]["id"])
            return self._append(manifest, None, gone)

    def rebuild(self) -> SearchIndex:
        return self.write(lambda i: SearchIndex.written(i.tables.documents, self.config))

    def compact(self, everything: bool = False) -> None:
        """Merges the last segments as long as those before them are less than four times as large; or all."""
        manifest = self._manifest()
        segments = manifest["segments"]
        size = lambda x: max(1, x["docs"] + x["gone"])
        at, total = len(segments), 0
        while at > 0 and (everything or (at > 0 and size(segments[at - 1]) < 4 * total) or at == len(segments)):
            at -= 1
            total += size(segments[at])
        # two alike are left alone: four segments of a size make one of the next
        if len(segments) - at < (2 if everything else 4):
            return
        keep, some = segments[:at], segments[at:]
        tables = {n: self._table(some, n) for n in self.TABLES}
        terms = tables["terms"].groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("total_tf").alias("total_tf"))
        tables["terms"] = terms.where((F.col("df") != 0) | (F.col("total_tf") != 0))
        tables["gone"] = tables["gone"].distinct() if keep else self._folder.spark.createDataFrame([], "id string")
        gone = self._gone_rows(some) if keep else 0
        self._commit(manifest, keep, tables, {"docs": sum(x["docs"] for x in some), "gone": gone}, manifest["documents"], manifest["lengths"])

    def vacuum(self, keep: int = 2) -> None:
        """Delete parts that none of the last ``keep`` versions (at most ``HISTORY`` + 1) has; readers of older ones fail from then on."""
        manifest = self._manifest()
        live = {x["part"] for x in manifest["segments"]} | {p for parts in manifest["history"][: max(0, keep - 1)] for p in parts}
        for part in self._folder.parts():
            if part not in live:
                self._folder.drop(part)

    def close(self) -> None:
        self._closed = True


class Transaction:
    """Reads see the store with this transaction's own changes; nothing is visible outside before it ends well."""

    def __init__(self, base: DataFrame):
        self._base, self.changes = base, {}

    def get(self, key: bytes) -> bytes:
        if key in self.changes:
            value = self.changes[key]
            if value is None:
                raise KeyNotFoundError(key)
            return value
        rows = self._base.where(F.col("key") == F.lit(bytearray(key))).take(1)
        if not rows:
            raise KeyNotFoundError(key)
        return bytes(rows[0]["value"])

    def put(self, key: bytes, value: bytes) -> None:
        self.changes[bytes(key)] = bytes(value)

    def delete(self, key: bytes) -> None:
        self.changes[bytes(key)] = None

    def written(self) -> DataFrame:
        """The changes as rows; a null value deletes."""
        rows = [(bytearray(k), None if v is None else bytearray(v)) for k, v in self.changes.items()]
        return self._base.sparkSession.createDataFrame(rows, "key binary, value binary")

    def result(self) -> DataFrame:
        if not self.changes:
            return self._base
        new = self.written()
        # as large as one transaction's writes, which the driver holds already
        return self._base.join(F.broadcast(new.select("key")), "key", "left_anti").unionByName(new.where(F.col("value").isNotNull()))

    def scan(self, prefix: bytes = b"") -> KeyIterator:
        return scan_rows(self.result(), prefix)


def scan(table: DataFrame, prefix: bytes = b"") -> DataFrame:
    """Rows whose key begins with ``prefix``, in byte order of the key."""
    return table.where(F.expr("startswith(key, X'" + prefix.hex() + "')")).orderBy("key")


class KeyIterator(Iterator[tuple[bytes, bytes]]):
    """Cursor over rows in byte order of the key, fetched a partition at a time.

    It stands before the first row; ``advance`` moves and tells whether there
    is a row, ``key`` and ``value`` are None outside, ``error`` is what ended the
    rows early, and after ``close`` there are none. A Python iterator too.
    """

    def __init__(self, table: DataFrame):
        self._rows = table.toLocalIterator()
        self.key: bytes | None = None
        self.value: bytes | None = None
        self.error: Exception | None = None
        self._open = True

    @property
    def valid(self) -> bool:
        return self.key is not None

    def advance(self) -> bool:
        row = None
        if self._open:
            try:
                row = next(self._rows, None)
            except Exception as e:
                self.error = e
        if row is None:
            self.close()
            return False
        self.key, self.value = bytes(row["key"]), bytes(row["value"])
        return True

    def __next__(self) -> tuple[bytes, bytes]:
        if not self.advance():
            if self.error:
                raise self.error
            raise StopIteration
        return self.key, self.value

    def close(self) -> None:
        self._open, self.key, self.value = False, None, None


def scan_rows(table: DataFrame, prefix: bytes) -> KeyIterator:
    return KeyIterator(scan(table, prefix))


class Store(ABC):
    """What a key-value store of the user's own has to offer."""

    @abstractmethod
    def transaction(self, work: Callable[[Transaction], None]) -> None: ...

    @abstractmethod
    def get(self, key: bytes) -> bytes: ...

    @abstractmethod
    def scan(self, prefix: bytes = b"") -> KeyIterator: ...

    @abstractmethod
    def close(self) -> None: ...

    def put(self, key: bytes, value: bytes) -> None:
        self.transaction(lambda tx: tx.put(key, value))

    def delete(self, key: bytes) -> None:
        self.transaction(lambda tx: tx.delete(key))


class KeyValueStore(Store):
    """An ordered key-value store ``key BINARY, value BINARY``; with a path it is persistent.

    A transaction costs its own changes: they are one more segment, in which a
    null value deletes its key. Several segments are merged into one now and
    then. Without a path they lie in the shared folder of the session.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self._closed = spark, False
        self._folder = Folder(spark, path or f"{shared_dir(spark)}/textloom/kv-{uuid.uuid4().hex}")

    def _now(self) -> tuple[dict, DataFrame]:
        if self._closed:
            raise StoreClosedError("store is closed")
        manifest = self._folder.manifest()
        return manifest, self._rows(manifest.get("segments", [])).where(F.col("value").isNotNull())

    def _rows(self, segments: list[str]) -> DataFrame:
        """The last value of each key, null where it was deleted."""
        if not segments:
            return self.spark.createDataFrame([], "key binary, value binary")
        read = [self.spark.read.schema("key binary, value binary").parquet(self._folder.at(p, "kv")) for p in segments]
        if len(read) == 1:
            return read[0]
        rows = reduce(DataFrame.unionByName, [df.withColumn("n", F.lit(i)) for i, df in enumerate(read)])
        return rows.groupBy("key").agg(F.max(F.struct("n", "value")).alias("v")).select("key", "v.value")

    def transaction(self, work: Callable[[Transaction], None]) -> None:
        """All changes of ``work``, or none if it raises."""
        manifest, table = self._now()
        tx = Transaction(table)
        work(tx)
        if not tx.changes:
            return
        before = manifest.get("segments", [])
        self._commit(manifest, before, tx.written())
        if len(before) + 1 >= MERGE_SEGMENTS:
            manifest, table = self._now()
            self._commit(manifest, [], table)

    def _commit(self, manifest: dict, before: list[str], rows: DataFrame) -> None:
        self._folder.commit(manifest["version"], [("kv", rows.repartitionByRange("key").sortWithinPartitions("key"))], lambda part: {"segments": [*before, part]})

    def get(self, key: bytes) -> bytes:
        return Transaction(self._now()[1]).get(key)

    def scan(self, prefix: bytes = b"") -> KeyIterator:
        """A snapshot of the rows under a prefix, in byte order."""
        return scan_rows(self._now()[1], prefix)

    def table(self, prefix: bytes = b"") -> DataFrame:
        """The same as a table."""
        return scan(self._now()[1], prefix)

    def close(self) -> None:
        self._closed = True
