import random

import pytest
from pyspark.sql import functions as F

from textloom import HighlightOptions, standard_analyzer
from textloom.functions.codec import decode_posting, encode_posting, from_json, key_part, key_part_text, key_parts, to_json
from textloom.functions.highlight import highlight
from textloom.model import CorruptIndexError, CorruptPostingError, Posting
from textloom.operators.postings import PostingCursor, SortedCursor, intersect, skip_to, union


def test_posting_round_trip():
    p = Posting("doc-42", (1000, 1, 8, 9))
    data = encode_posting(p)
    assert len(data) == 14 and decode_posting(data) == p and p.positions == (1, 8, 9, 1000) and p.frequency == 4
    r = random.Random(2)
    for _ in range(300):
        p = Posting(r.choice(["", "a", "文档", "x" * 200]), tuple(r.sample(range(2**32), r.randint(0, 20))))
        assert decode_posting(encode_posting(p)) == p


@pytest.mark.parametrize("data", [b"\x80", b"", b"\x01", b"\x01a\x01", b"\x01a\x02\x01\x00", b"\x01a\x01\x01\x00\x00", b"\x01\xff\x00\x00", b"\x01a" + b"\xff" * 11, b"\x01a\xff\xff\xff\xff\x0f\xff\xff\xff\xff\x0f"])
def test_corrupt_postings(data):
    with pytest.raises(CorruptPostingError):
        decode_posting(data)


def test_metadata_codec(spark):
    assert from_json(to_json({"a": 1, "é": [2]})) == {"a": 1, "é": [2]}
    with pytest.raises(CorruptIndexError):
        from_json(b"{")
    names = ["", "a/b", "https://x?y=z", "文档", "\x00", "??>>", "x" * 100]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", key_parts(F.col("n")).alias("k")).collect()
    for r in got:
        assert r["k"] == key_part(r["n"]) and key_part_text(r["k"]) == r["n"] and "/" not in r["k"]
    with pytest.raises(CorruptIndexError):
        key_part_text("*")


def test_cursors():
    c = PostingCursor([Posting(i, (1,)) for i in ("doc-9", "doc-1", "doc-5")])
    assert c.skip_to("doc-5") and c.posting.doc_id == "doc-5" and c.next() and c.key == "doc-9" and not c.next()
    c = SortedCursor([f"{i:03d}" for i in range(0, 200, 2)])
    assert c.skip_to("073") and c.key == "074" and c.skip_to("010") and c.key == "074" and not c.skip_to("999") and c.key is None
    c = SortedCursor(["文档-2", "doc/1", "alpha"])
    assert c.skip_to("doc") and c.key == "doc/1" and c.next() and c.key == "文档-2"
    assert not SortedCursor([]).next()


def test_list_operations(spark):
    make = lambda rows: spark.createDataFrame(rows, "id string, tf int, positions array<int>")
    left, right = make([("a", 1, [1]), ("b", 2, [1, 2])]), make([("b", 9, [9]), ("c", 3, [3])])
    assert [tuple(r) for r in intersect(left, right).collect()] == [("b", 2, [1, 2])]
    assert sorted(tuple(r) for r in union(left, right).collect()) == [("a", 1, [1]), ("b", 2, [1, 2]), ("c", 3, [3])]
    assert [r["id"] for r in skip_to(union(left, right), "b").collect()] == ["b", "c"]
    assert intersect(left, make([])).count() == 0 and union(make([]), make([])).count() == 0


def test_highlight():
    a = standard_analyzer()
    assert highlight(a, "x", []) == [] and highlight(a, "", ["x"]) == [] and highlight(a, None, ["x"]) == [] and highlight(a, "y", ["x"]) == []
    assert highlight(a, "<b> GO & it's", ["go"])[0]["text"] == "&lt;b&gt; <em>GO</em> &amp; it&#39;s"
    raw = HighlightOptions(escape_html=False, pre_tag="[", post_tag="]")
    assert highlight(a, '<b> go "', ["go"], raw)[0]["text"] == '<b> [go] "'
    text = "go " + "世界 " * 40 + "go " + "x " * 200 + "go"
    got = highlight(a, text, ["GO"], HighlightOptions(fragment_size=30, max_fragments=5, pre_tag="", post_tag=""))
    assert len(got) == 3 and all(g["text"].count("<em>go</em>") == 1 for g in got)
    for g in got:
        plain = g["text"].replace("<em>", "").replace("</em>", "")
        assert text.encode()[g["start"] : g["end"]].decode() == plain
    assert len(highlight(a, text, ["go"], HighlightOptions(fragment_size=0, max_fragments=0))) == 1
    chain = " ".join(["go"] + ["pad " * 5 + "go"] * 6)
    one = highlight(a, chain, ["go"], HighlightOptions(fragment_size=25))
    assert len(one) == 1 and one[0]["end"] - one[0]["start"] == len(chain)
