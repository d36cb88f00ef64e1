import pytest
from pyspark.sql import functions as F

from textloom import KeyValueStore, MatchQuery, SearchIndex, StoredIndex, TermQuery, add, new_index
from textloom.model import DocumentMissingError, InvalidDocumentError, KeyNotFoundError, StoreClosedError
from textloom.sources.corpora import corpus, corpus_of_records
from textloom.streaming.ingest import ingest

C, DOC = "content", "id string, fields map<string,string>"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOC)


def dictionary(index):
    return sorted(map(tuple, index.tables.terms.select("field", "term", "df", "total_tf").collect()))


def report(index):
    problems = sorted(map(tuple, index.problems().collect()))
    r = index.check().first()
    assert r["problems"] == len(problems)
    return r["documents"], problems


def test_add_positions(spark):
    i = add(new_index(spark), "1", {C: "go good go fast"})
    assert tuple(i.postings(C, "go").first()) == ("1", 2, [0, 2])
    assert i.stats() == (1, {C: 4}) and report(i) == (1, [])


def test_string_ids(spark):
    name = "tenant/用户:42"
    i = add(new_index(spark), name, {C: "string identifier"})
    assert i.document(name) == {C: "string identifier"} and i.metadata(name) == {C: 2}
    assert i.search(TermQuery(C, "string")).first()["id"] == name
    with pytest.raises(DocumentMissingError):
        i.document("other")


def test_update(spark):
    i = add(add(new_index(spark), "1", {C: "old old term"}), "1", {C: "new term"})
    assert i.term_info(C, "old") == (0, 0) and i.term_info(C, "new") == (1, 1) and i.stats() == (1, {C: 2})
    assert report(i) == (1, [])


def test_batch_is_all_or_nothing(spark):
    for bad in [("", {C: "x"}), (" 　", {C: "x"}), (None, {C: "x"}), ("b", {}), ("b", None), ("b", {" ": "x"})]:
        with pytest.raises(InvalidDocumentError):
            new_index(spark).add_batch(docs(spark, [("a", {C: "x"}), bad]))


def test_last_of_a_batch_wins(spark):
    rows = spark.createDataFrame([("1", {C: "first"}, 1), ("1", {C: "second"}, 2), ("2", {C: "other"}, 3)], DOC + ", n int")
    i = new_index(spark).add_batch(rows, order="n")
    assert i.document("1") == {C: "second"} and i.stats()[0] == 2


def test_repeated_ids_need_an_order(spark, tmp_path):
    rows = docs(spark, [("1", {C: "first"}), ("1", {C: "second"})])
    with pytest.raises(InvalidDocumentError):
        new_index(spark).add_batch(rows)
    store = StoredIndex(spark, str(tmp_path / "index"))
    with pytest.raises(InvalidDocumentError):
        store.add_batch(rows)
    assert store.snapshot().stats()[0] == 0
    ties = spark.createDataFrame([("1", {C: "a"}, 5), ("1", {C: "b"}, 5), ("1", {C: "z"}, 4)], DOC + ", n int")
    assert store.add_batch(ties, "n").document("1") == {C: "b"}


def test_delete(spark):
    one = add(new_index(spark), "1", {C: "alpha beta"})
    two = add(one, "2", {C: "beta gamma"})
    assert dictionary(two.delete("2")) == dictionary(one)
    assert report(two.delete("1")) == (1, [])
    with pytest.raises(DocumentMissingError):
        two.delete("missing")
    with pytest.raises(InvalidDocumentError):
        two.delete(" ")


def test_rebuild_and_check(spark):
    i = new_index(spark).add_batch(docs(spark, [("a", {C: "go go web", "t": ""}), ("b", {C: "web"})]))
    again = i.rebuild()
    assert dictionary(again) == dictionary(i) and again.stats() == i.stats() == (2, {C: 4, "t": 0})
    i.tables.terms = i.tables.terms.withColumn("df", F.when(F.col("term") == "web", 7).otherwise(F.col("df")))
    assert report(i) == (2, [("term", C, "web", 7, 2)])


def test_stored_index(spark, tmp_path):
    path = str(tmp_path / "index")
    s = StoredIndex(spark, path)
    s.add_batch(docs(spark, [("1", {C: "persistent value"}), ("2", {C: "other"})]))
    again = StoredIndex(spark, path)
    assert [r["id"] for r in again.snapshot().search(TermQuery(C, "persistent")).collect()] == ["1"]
    old = again.snapshot()
    again.delete("1")
    assert old.search(TermQuery(C, "persistent")).count() == 1
    assert again.snapshot().search(TermQuery(C, "persistent")).count() == 0
    with pytest.raises(InvalidDocumentError):
        again.add_batch(docs(spark, [("x", {C: "y"}), ("", {C: "y"})]))
    assert again.snapshot().stats()[0] == 1 and report(again.rebuild()) == (1, [])
    again.vacuum(1)
    assert again.snapshot().stats()[0] == 1 and len(again._folder.parts()) == 1
    with pytest.raises(RuntimeError):
        again._folder.commit(1, [], lambda part: {})
    again.close()
    with pytest.raises(StoreClosedError):
        again.snapshot()


def test_segments(spark, tmp_path):
    """Batches, updates and deletes as segments give what one build of the last state gives, also when some or all are merged."""
    import random

    r, state = random.Random(4), {}
    store = StoredIndex(spark, str(tmp_path / "index"))
    words = "alpha beta gamma delta the epsilon".split()
    for step in range(7):
        batch = {str(r.randint(0, 12)): {C: " ".join(r.choices(words, k=r.randint(0, 6))), **({"t": "x y"} if r.random() < 0.5 else {})} for _ in range(4)}
        store.add_batch(docs(spark, list(batch.items())))
        state |= batch
        if step % 3 == 2:
            gone = r.sample(sorted(state), 2)
            store.delete(*gone)
            for g in gone:
                del state[g]
        if step in (2, 6):
            want = SearchIndex.of_documents(docs(spark, list(state.items())))
            for _ in range(2):
                now = store.snapshot()
                assert report(now) == (len(state), []) and dictionary(now) == dictionary(want)
                n, lengths = now.stats()
                assert n == len(state) and {f: x for f, x in lengths.items() if x} == {f: x for f, x in want.stats()[1].items() if x}
                rows = lambda i: sorted((p["field"], p["term"], p["id"], p["tf"], tuple(p["positions"]), p["dl"]) for p in i.tables.postings.collect())
                assert rows(now) == rows(want)
                store.compact(everything=True)
            assert len(store._manifest()["segments"]) == 1
    assert store.rebuild().stats()[0] == len(state)


def test_forks_go_their_own_way(spark, tmp_path):
    one = StoredIndex(spark, str(tmp_path / "one"))
    one.add_batch(docs(spark, [("1", {C: "alpha"}), ("2", {C: "beta"})]))
    two = one.fork(str(tmp_path / "two"))
    two.add_batch(docs(spark, [("2", {C: "gamma"}), ("3", {C: "alpha"})]))
    one.delete("1")
    assert sorted(r["id"] for r in one.snapshot().all_ids().collect()) == ["2"] and report(one.snapshot()) == (1, [])
    assert sorted(r["id"] for r in two.snapshot().all_ids().collect()) == ["1", "2", "3"] and report(two.snapshot()) == (3, [])
    two.rebuild()
    two.vacuum(1)
    assert two.snapshot().term_info(C, "alpha") == (2, 2) and one.snapshot().document("2") == {C: "beta"}


def test_small_segments_merge(spark, tmp_path):
    store = StoredIndex(spark, str(tmp_path / "index"))
    for i in range(6):
        store.add_batch(docs(spark, [(str(i), {C: f"w{i} w"})]))
        assert len(store._manifest()["segments"]) < 5
    assert store.snapshot().term_info(C, "w") == (6, 6) and report(store.snapshot()) == (6, [])


def test_many_ids_are_joined(spark, tmp_path, monkeypatch):
    from textloom.sources import store as module

    monkeypatch.setattr(module, "LITERAL_IDS", 2)
    store = StoredIndex(spark, str(tmp_path / "index"))
    store.add_batch(docs(spark, [(str(i), {C: "old"}) for i in range(6)]))
    now = store.add_batch(docs(spark, [(str(i), {C: "new"}) for i in range(4)]))
    assert now.term_info(C, "old") == (2, 2) and now.term_info(C, "new") == (4, 4) and report(now) == (6, [])


def test_claims_are_leases(spark, tmp_path, monkeypatch):
    import json
    import os
    import time

    path = str(tmp_path / "index")
    store = StoredIndex(spark, path)
    claim = os.path.join(path, "CLAIM-2")

    def left(age):
        with open(claim, "w") as f:
            json.dump({"owner": "someone", "time": time.time() - age}, f)
        crc = os.path.join(path, ".CLAIM-2.crc")
        if os.path.exists(crc):
            os.remove(crc)

    left(5)
    with pytest.raises(RuntimeError):
        store.add_batch(docs(spark, [("1", {C: "x"})]))
    assert store.snapshot().stats()[0] == 0
    left(10**6)
    assert store.add_batch(docs(spark, [("1", {C: "x"})])).stats()[0] == 1 and not os.path.exists(claim)


@pytest.mark.parametrize("persistent", [False, True])
def test_key_value_store(spark, tmp_path, persistent):
    path = str(tmp_path / "kv") if persistent else None
    s = KeyValueStore(spark, path)

    def failing(tx):
        tx.put(b"k", b"v")
        assert tx.get(b"k") == b"v"
        raise ValueError

    with pytest.raises(ValueError):
        s.transaction(failing)
    with pytest.raises(KeyNotFoundError):
        s.get(b"k")
    value = bytearray(b"one")
    s.put(b"p/2", b"two")
    s.put(b"p/1", value)
    s.put(b"q/\xff", b"")
    value[0] = 0
    assert list(s.scan(b"p/")) == [(b"p/1", b"one"), (b"p/2", b"two")] and s.get(b"q/\xff") == b""
    it = s.scan(b"p/")
    assert not it.valid and it.advance() and it.valid and (it.key, it.value) == (b"p/1", b"one")
    it.close()
    assert not it.valid and not it.advance() and it.error is None
    s.delete(b"p/1")
    assert [k for k, _ in s.scan()] == [b"p/2", b"q/\xff"]
    if persistent:
        assert KeyValueStore(spark, path).get(b"p/2") == b"two"
    s.close()
    with pytest.raises(StoreClosedError):
        s.get(b"p/2")


def test_streaming_ingest(spark, tmp_path):
    source = str(tmp_path / "in")
    docs(spark, [("1", {C: "streamed text"}), ("", {C: "refused"}), ("2", {C: "more text"})]).write.parquet(source)
    index, bad = StoredIndex(spark, str(tmp_path / "index")), str(tmp_path / "refused")
    run = lambda: ingest(spark.readStream.schema(DOC).parquet(source), index, str(tmp_path / "cp"), refused=bad).awaitTermination()
    run()
    docs(spark, [("2", {C: "changed"})]).write.mode("append").parquet(source)
    run()
    i = index.snapshot()
    assert i.stats()[0] == 2 and i.document("2") == {C: "changed"}
    assert [(r["batch"], r["id"]) for r in spark.read.schema(DOC + ", batch int").parquet(bad).collect()] == [(0, "")]
    assert [r["id"] for r in i.search(MatchQuery(C, "text")).collect()] == ["1"]


def test_corpora(spark):
    got = corpus(spark.createDataFrame([(1, "a", None, 2.5)], "k long, t string, u string, fields double"), "k", {"t": "t", "u": "u", "f": "fields"}).first()
    assert got["id"] == "1" and got["fields"] == {"t": "a", "f": "2.5"}
    rows = [(1, 0, "a", {"t": "old"}), (2, 0, "a", {"t": "new", "u": None}), (2, 0, "a", {"t": "new", "u": None}), (9, 0, " ", {"t": "x"}), (8, 0, "a", {}), (3, 1, "a", {"t": ""}), (4, 1, None, {"t": "x"})]
    r = spark.createDataFrame(rows, "seq long, shard int, id string, fields map<string,string>")
    assert {x["id"]: x["fields"] for x in corpus_of_records(r).collect()} == {"0/a": {"t": "new"}, "1/a": {"t": ""}}


def test_index_of_nothing(spark):
    i = SearchIndex.of_documents(docs(spark, []))
    assert report(i) == (0, []) and report(i.rebuild()) == (0, [])
