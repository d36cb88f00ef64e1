import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import language as L
from textloom.llm.visual_form import Conflict, Transducer, transducer, visual_form


# ------------------------------------------------------------- visual form


@pytest.mark.parametrize(
    "text,want",
    [
        ("Ｈｅｌｌｏ　ｗｏｒｌｄ", "Hello world"),
        ("é é", "é é"),
        ("ze​ro­ wi⁠dth﻿", "zero width"),
        ("‍lead‎", "lead"),
        ("рау", "pay"),
        ("ﬁﬀ‐‑x", "fiff--x"),
        ("ёёë", "ëëë"),
        ("ｶﾞｶ", "ガカ"),
        ("K⽤  ", "K用  "),
        ("한", "한"),
        ("ậ", "ậ"),
        ("ậ", "ậ"),
        ("a\tb", "a b"),
        ("́", "́"),
        ("", ""),
    ],
)
def test_forms(text, want):
    assert transducer().apply(text) == want


@pytest.mark.parametrize("a,b", [("A", "a"), ("e", "é"), ("2", "²"), ("1", "①"), ("TM", "™"), ("x", "x…"), ("и", "й"), ("-", "—"), ("l", "I")])
def test_different_looks_stay_apart(a, b):
    assert transducer().apply(a) != transducer().apply(b)


def test_idempotent_and_canonical():
    t, r = transducer(), random.Random(8)
    pool = [chr(c) for c in [*range(0x20, 0x250), *range(0x300, 0x330), *range(0x370, 0x530), 0x1100, 0x1161, 0x11A8, 0x200B, 0x200D, 0xFE0F, 0xFF76, 0xFF9E, *range(0xFF00, 0xFF60)]]
    for _ in range(2000):
        s = "".join(r.choice(pool) for _ in range(r.randint(0, 8)))
        once = t.apply(s)
        assert t.apply(once) == once, ascii(s)
        assert t.apply(unicodedata.normalize("NFD", s)) == once, ascii(s)


def test_conflicts_are_found():
    with pytest.raises(Conflict):
        Transducer(look_alike="a а   o а")
    with pytest.raises(Conflict):
        Transducer(look_alike="а ɑ   a а")


def test_column(spark):
    long = "а​" * 50_000
    rows = [(1, None), (2, ""), (3, "ａ"), (4, long)]
    got = {r["form"]: r["f"] for r in spark.createDataFrame(rows, "form int, t string").select("form", visual_form(F.col("t")).alias("f")).collect()}
    assert got == {1: None, 2: "", 3: "a", 4: "a" * 50_000}


# ---------------------------------------------------------------- language

WORDS = {
    "en": "the index reads every stored value because the disk is slow and nobody looks",
    "de": "der Parser liest die alte Fassung und niemand weiß warum das Protokoll leer ist",
    "es": "la página guarda los valores vacíos pero nadie sabe por qué el disco es lento",
    "fr": "le dictionnaire trie les valeurs vides mais personne ne sait pourquoi la page est lente",
    "nl": "het logboek bewaart de oude versie maar niemand weet waarom de schijf traag is",
    "pt": "a página guarda os valores vazios mas ninguém sabe por que o disco é lento",
    "ru": "журнал хранит старую версию но никто не знает почему диск такой медленный",
    "zh": "索引器读取旧的快照但是没有人知道为什么磁盘这么慢",
}


def _sentence(r, lang, n=9):
    if lang == "zh":
        return "".join(r.choice(WORDS[lang]) for _ in range(2 * n)) + "。"
    return " ".join(r.choice(WORDS[lang].split()) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def model():
    r = random.Random(5)
    texts, labels = [], []
    for lang in L.LANGS:
        for _ in range(40):
            texts.append("\n".join(_sentence(r, lang) for _ in range(3)))
            # a tenth of the labels are wrong
            labels.append(lang if r.random() > 0.1 else r.choice(L.LANGS))
    return L.fit(texts, labels)


def test_held_out_accuracy(model):
    r = random.Random(77)
    truth = [r.choice(L.LANGS) for _ in range(400)]
    got = [L.LANGS[k] for k in model.scores([_sentence(r, t) + " zorplex KOR-12" for t in truth]).argmax(1)]
    assert np.mean([a == b for a, b in zip(truth, got)]) > 0.98


def test_unseen_words_back_off(model):
    assert L.LANGS[model.scores(["knoweth lookst slowe nobodyy"]).argmax()] == "en"
    assert L.LANGS[model.scores(["хранитель медленно старую"]).argmax()] == "ru"
    assert not model.scores(["12345 !!", ""]).any()


def test_labels(spark):
    cases = {"EN": "en", "en_GB": "en", "zho": "zh", "zh_Hans": "zh", "German": "de", " pt-BR": "pt", "fre": "fr", "Dutch": "nl", "??": None, "": None, "und": None, "unknown": None, None: None, "it": None, "english (UK)": "en"}
    got = spark.createDataFrame([(k,) for k in cases], "l string").select("l", L.label_code(F.col("l")).alias("c")).collect()
    assert {r["l"]: r["c"] for r in got} == cases


def test_paragraphs(spark, model):
    r = random.Random(9)
    rows = [
        (1, _sentence(r, "en") + "\n" + _sentence(r, "ru") + "\n\n12", "en"), (2, _sentence(r, "de"), "German"), (3, None, "en"), (4, "", "en"), (5, "123\n!", "en"),
        (6, _sentence(r, "fr"), "nl"), (7, _sentence(r, "zh"), None), (8, "\n".join(_sentence(r, "es", 30) for _ in range(3000)), "es"),
    ]
    df = spark.createDataFrame(rows, "para long, lang string, label string")
    out = L.paragraph_languages(df.toDF("seq", "text", "label"), "seq", "text", model)
    got = {(x["seq"], x["para"]): x for x in out.collect()}
    assert [got[1, i]["lang"] for i in range(4)][:2] == ["en", "ru"] and got[1, 2]["lang"] == got[1, 0]["doc_lang"] and got[1, 3]["lang"] == got[1, 0]["doc_lang"]
    assert got[2, 0]["lang"] == "de" and got[2, 0]["confidence"] > 0.9
    assert (3, 0) not in got and got[4, 0]["lang"] is None and got[5, 1]["confidence"] == 0
    assert np.mean([got[8, i]["lang"] == "es" for i in range(3000)]) > 0.98 and got[8, 0]["doc_lang"] == "es"
    bad = L.relabelled(out.where("lang is not null"), df.toDF("seq", "text", "label").select("seq", "label"), "seq", "label")
    assert {x["seq"] for x in bad.collect()} == {1, 6, 7}
    empty = spark.createDataFrame([], "seq long, text string")
    assert L.paragraph_languages(empty, "seq", "text", model).count() == 0


def test_sample_is_bounded(spark):
    df = spark.createDataFrame([(i, f"text {i}", "en" if i % 2 else None) for i in range(50)], "k long, t string, l string")
    texts, labels = L.labelled_sample(df, "t", "l", "k", per_language=7)
    assert len(texts) == 7 and set(labels) == {"en"}
