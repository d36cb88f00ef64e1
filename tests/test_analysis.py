import random

import pytest
from pyspark.sql import functions as F

from textloom import (
    Analyzer, DictionaryTokenizer, HmmModel, HmmTokenizer, LowercaseFilter, SimpleTokenizer, StandardTokenizer, StemmerFilter, StopWordFilter, WhitespaceTokenizer, standard_analyzer,
)
from textloom.functions.filters import lower, lower_text, stem, stem_text


def terms(tokens):
    return [t.term for t in tokens]


def test_whitespace_offsets_are_bytes():
    got = WhitespaceTokenizer().scan("Go\t世界 fast")
    assert [(t.term, t.start_offset, t.end_offset) for t in got] == [("Go", 0, 2), ("世界", 3, 9), ("fast", 10, 14)]


def test_simple():
    assert terms(SimpleTokenizer().scan("Hello, Go123!")) == ["Hello", "Go123"]


def test_standard_types():
    got = StandardTokenizer().scan("mail me@example.com at https://go.dev, price 12.5!")
    assert [(t.term, t.type) for t in got] == [
        ("mail", "word"), ("me@example.com", "email"), ("at", "word"), ("https://go.dev", "url"), (",", "symbol"), ("price", "word"), ("12.5", "number"), ("!", "symbol"),
    ]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Hello, world.", [("hello", 0), (",", 1), ("world.", 2)]),
        ("Go is fast. It is.", [("go", 0), ("fast.", 2), ("is.", 4)]),
        ("1,2 a-b _x www. (see WWW.x.y).", [("1", 0), (",", 1), ("2", 2), ("a-b", 3), ("_", 4), ("x", 5), ("www", 6), (".", 7), ("(", 8), ("see", 9), ("www.x.y", 10), (")", 11), (".", 12)]),
        ("mail me@example.com at https://go.dev, price 12.5!", [("mail", 0), ("me@example.com", 1), ("https://go.dev", 3), (",", 4), ("price", 5), ("12.5", 6), ("!", 7)]),
        ("", []),
    ],
)
def test_default_analyzer(text, want):
    assert [(t.term, t.position) for t in standard_analyzer().analyze(text)] == want


ODD = ["", " ", "a b", "www.", "http://", "https://x.y/z).", "x@y.", "é².", "İSTANBUL ΣΑΣ", "a　b c", "中文 mixed中文", "\x1ca\x85b", "1.5-2+3 4,5", "_a __ -", "A\nB\rC", "😀 ok", "WWW.a,b;c"]


def _random_texts(n, seed):
    r = random.Random(seed)
    alphabet = "abAB12.,;:-_+@!?)( \t\n　éÉßΣİ中文字²😀/whtps:"
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) + r.choice(["", " www.x.y) z", " https://a.b/c.,", " me@x.y."]) for _ in range(n)]


@pytest.mark.parametrize("tokenizer", [WhitespaceTokenizer(), SimpleTokenizer(), StandardTokenizer()])
def test_native_equals_scan(spark, tokenizer):
    texts = ODD + _random_texts(300, 5)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, text string")
    rows = {r["i"]: r["t"] for r in df.select("i", tokenizer.column(F.col("text"), types=True).alias("t")).collect()}
    for i, text in enumerate(texts):
        assert [(t["term"], t["position"], t["type"]) for t in rows[i]] == [(t.term, t.position, t.type) for t in tokenizer.scan(text)], text
    assert not rows[-1]


def test_offsets_name_the_terms():
    for text in ODD + _random_texts(300, 6):
        raw = text.encode()
        for tokenizer in (WhitespaceTokenizer(), SimpleTokenizer(), StandardTokenizer(), DictionaryTokenizer(["中文"]), HmmTokenizer()):
            for t in tokenizer.scan(text):
                assert raw[t.start_offset : t.end_offset].decode() == t.term


def test_filters_and_immutability():
    tokens = WhitespaceTokenizer().scan("RUNNING is FAST")
    before = list(tokens)
    out = tokens
    for f in (LowercaseFilter(), StopWordFilter(["is"]), StemmerFilter()):
        out = f.apply(out)
    assert [(t.term, t.position) for t in out] == [("run", 0), ("fast", 2)]
    assert tokens == before


STEMS = {
    "running": "run", "falling": "fal", "string": "str", "sing": "sing", "bring": "bring", "tried": "try", "died": "died", "speed": "spe", "boxes": "box",
    "cities": "citi", "does": "doe", "class": "class", "s": "s", "": "", "ééing": "éé", "cats": "cat", "gas": "gas", "as": "as",
}


def test_stem_and_lower_columns(spark):
    words = list(STEMS) + ["Σας", "İx", "ÉCOLE", "naïves", "éés"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", stem(F.col("w")).alias("s"), lower(F.col("w")).alias("l")).collect()
    for r in rows:
        assert r["s"] == stem_text(r["w"]), r["w"]
        assert r["l"] == lower_text(r["w"])
        assert STEMS.get(r["w"], r["s"]) == r["s"], r["w"]


def test_pipeline_without_parts():
    assert Analyzer(None).analyze("x y") == []
    assert terms(Analyzer(WhitespaceTokenizer(), [None]).analyze("x y")) == ["x", "y"]


def test_stream():
    s = standard_analyzer().stream("Go is fast")
    assert s.token is None
    assert terms(s) == ["go", "fast"] and s.token is None and not s.next()
    s.reset("Simple")
    assert s.next() and s.token.term == "simple"


def test_dictionary_modes():
    whole = DictionaryTokenizer(["中华人民共和国", "人民", "共和国"], "both")
    assert terms(whole.scan("中华人民共和国")) == ["中华人民共和国"]
    assert terms(DictionaryTokenizer().scan("搜索AI")) == ["搜", "索", "AI"]
    words = ["研究", "研究生", "生命", "命"]
    assert terms(DictionaryTokenizer(words).scan("研究生命")) == ["研究生", "命"]
    assert terms(DictionaryTokenizer(words, "reverse").scan("研究生命")) == ["研究", "生命"]
    assert terms(DictionaryTokenizer(words, "both").scan("研究生命")) == ["研究", "生命"]
    mixed = ["中a", "a文"]
    assert terms(DictionaryTokenizer(mixed).scan("中a文")) == ["中a", "文"]
    assert terms(DictionaryTokenizer(mixed, "reverse").scan("中a文")) == ["中", "a文"]
    got = DictionaryTokenizer().scan("中，$ 文!")
    assert [(t.term, t.position, t.type) for t in got] == [("中", 0, "han"), ("$", 1, "symbol"), ("文", 2, "han")]
    with pytest.raises(ValueError):
        DictionaryTokenizer([], "sideways")


def test_hmm():
    assert ["".join("BMES"[s] for s in HmmModel().states("字" * n)) for n in range(1, 6)] == ["S", "BE", "BME", "BEBE", "BMEBE"]
    assert terms(HmmTokenizer().scan("中文分词 AI")) == ["中文", "分词", "AI"]
    own = HmmModel(emission={"的": (-9.0, -9.0, -9.0, -0.01)})
    assert own.segment("我的书") == ["我", "的", "书"]


@pytest.mark.parametrize("mode", ["forward", "reverse", "both"])
@pytest.mark.parametrize("native", [0, 2000])
def test_cuttings_on_both_sides_of_the_word_limit(spark, monkeypatch, mode, native):
    """Long lists are matched by scanning, short ones inside the JVM: the same terms, positions and types."""
    from textloom.functions import tokenizers

    monkeypatch.setattr(tokenizers, "NATIVE_WORDS", native)
    r = random.Random(7)
    words = ["北京", "北京大学", "大学生", "大学", "学生活动", "生活", "活动中心", "中心", "X光", "光学", "é光", "e\u0301光"]
    texts = ["", None, " ", "北京大学生活动中心", "X光学é光", "a1北京,b。😀京", "e\u0301光学"] + ["".join(r.choice("北京大学生活动中心光Xé1 ,。😀") for _ in range(r.randint(1, 30))) for _ in range(60)]
    tokenizer = DictionaryTokenizer(words, mode)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for i, got in df.select("i", tokenizer.column(F.col("text"), types=True)).collect():
        want = [(t.term, t.position, t.type) for t in tokenizer.scan(texts[i] or "")]
        assert [tuple(t) for t in got or []] == want, texts[i]


def test_paths_of_equal_signs_depend_on_the_length_alone():
    plain, listed = HmmTokenizer(), HmmTokenizer(HmmModel(emission={"龘": (-0.6, -0.8, -0.6, -0.9)}))
    for n in range(1, 40):
        assert plain.scan("大" * n) == listed.scan("大" * n)
