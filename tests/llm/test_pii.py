import itertools
import random
import re

import numpy as np
import pytest

from textloom.llm import pii
from textloom.llm.crf import Chain, certain, forward_backward, legal, loopy, train_skip, viterbi
from textloom.llm.pii_samples import make


def _paths(unary, trans):
    n, k = unary.shape
    for p in itertools.product(range(k), repeat=n):
        yield p, sum(unary[i, y] for i, y in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:]))


def test_chain_against_enumeration():
    r = np.random.default_rng(3)
    lengths, k = [3, 1, 4, 2], 3
    unary, trans = r.normal(size=(sum(lengths), k)), r.normal(size=(k, k))
    logz, marg, pair = forward_backward(unary, trans, Chain(np.array(lengths)))
    best = viterbi(unary, trans, Chain(np.array(lengths)))
    at, pairs = 0, np.zeros((k, k))
    for s, n in enumerate(lengths):
        paths = list(_paths(unary[at : at + n], trans))
        z = np.log(sum(np.exp(v) for _, v in paths))
        assert logz[s] == pytest.approx(z)
        for i in range(n):
            for y in range(k):
                assert np.exp(marg[at + i, y]) == pytest.approx(sum(np.exp(v - z) for p, v in paths if p[i] == y))
        for p, v in paths:
            for a, b in zip(p, p[1:]):
                pairs[a, b] += np.exp(v - z)
        assert tuple(best[at : at + n]) == max(paths, key=lambda x: x[1])[0]
        at += n
    assert pair == pytest.approx(pairs)


def test_loopy_is_exact_on_a_tree():
    r = np.random.default_rng(5)
    k = 3
    unary, trans, skip = r.normal(size=(4, k)), r.normal(size=(k, k)), r.normal(size=(k, k))
    chain = Chain(np.array([2, 2]))
    now = loopy(unary, trans, chain, np.array([[1, 2, 0]]), skip[None], rounds=6)
    _, marg, _ = forward_backward(now, trans, chain)
    total = np.zeros((4, k))
    for p in itertools.product(range(k), repeat=4):
        v = np.exp(sum(unary[i, y] for i, y in enumerate(p)) + trans[p[0], p[1]] + trans[p[2], p[3]] + skip[p[1], p[2]])
        for i, y in enumerate(p):
            total[i, y] += v
    assert np.exp(marg) == pytest.approx(total / total.sum(axis=1, keepdims=True), rel=1e-6)


def test_edges_are_linear_in_the_group():
    texts = ["Ann Bly, then ann and ANN Bly and Cy Ann. Ann", "no Ann Bly here twice", "王芳和王芳，王芳", "call 555-010-9999 or +1 555 010 9999"]
    lexer = pii.Lexer()
    r = lexer.read(texts)
    got = {}
    for a, b, kind in r.edges(texts, np.ones(len(r.real), bool)).tolist():
        t = int(r.owner[a])
        assert t == r.owner[b]
        got.setdefault((t, kind, texts[t][slice(*r.spans[a])].lower()), []).append((a, b))
    # three of four "Ann" stand beside another capital, in a ring of three edges; a pair has one edge
    assert {k: len(v) for k, v in got.items()} == {(0, 0, "ann"): 4, (0, 0, "bly"): 1, (2, 1, "王"): 3, (3, 2, "555-010-9999"): 1}


@pytest.mark.parametrize("seed", range(30))
def test_certain_tokens_are_outside_on_the_best_path(seed):
    """The proof against full decoding, with margins from small to large."""
    r = np.random.default_rng(seed)
    lengths = r.integers(1, 40, 12)
    n = int(lengths.sum())
    trans = r.normal(size=(5, 5)) + legal(5)
    unary = r.normal(size=(n, 5)) * 2
    unary[:, 0] += r.uniform(0, 12, n)
    ends = np.zeros(n, bool)
    ends[np.cumsum(lengths) - 1] = True
    starts = np.r_[True, ends[:-1]]
    unary[starts, 2::2] -= 30
    sure = certain(unary, trans, starts, ends)
    best = viterbi(unary, trans, Chain(lengths))
    assert not best[sure].any() and sure.mean() > 0.2


def test_skip_potentials_are_learned():
    """Tokens whose own features say nothing take the label of the equal token elsewhere."""
    r = np.random.default_rng(2)
    features, labels, lengths, edges = [], [], [], []
    for i in range(300):
        y = int(r.integers(0, 2))
        edges.append((2 * i, 2 * i + 1, 0))
        features += [[1 + y], [3]]
        labels += [y, y]
        lengths.append(2)
    w, trans, skip = train_skip(np.array(features), np.array(labels), lengths, np.zeros((4, 2)), np.zeros((2, 2)), np.array(edges), np.array([0, 1]), 1, epochs=40)
    assert skip[0, 0, 0] > 0.3 and skip[0, 1, 1] > 0.3 and skip[0, 0, 1] < -0.3 and np.allclose(skip[0], skip[0].T)


@pytest.fixture(scope="module")
def model():
    return pii.fit()


def test_held_out(model):
    samples = make(400, seed=987)
    found = model.find([t for t, _ in samples])
    hit = sum(len(set(a) & set(b)) for (_, a), b in zip(samples, found))
    assert hit / sum(len(a) for _, a in samples) > 0.97 and hit / sum(map(len, found)) > 0.97


def test_recurring_name_is_recognised(model):
    text = "Reported by Gareth Quenborne (g@corp.test). " + "The parser reads the values. " * 6 + "Later Gareth Quenborne saw the block."
    names = [text[a:b] for a, b, k in model.find([text])[0] if k == "name"]
    assert names == ["Gareth Quenborne"] * 2


def test_whole_texts_are_read(model):
    text = "a quiet word, then more of them\n" * 40 + "今天天气很好" * 30
    r = pii.Lexer().read([text])
    assert "".join(text[a:b] for a, b in r.spans) == "".join(text.split())
    for piece in ("João da Silva", "Ana dos Santos", "Šimon Thornfield", "Anna  Meyer"):
        line = f"the parser reads the values, thanks to {piece} for the patch."
        assert [line[a:b] for a, b, _ in model.find([line])[0]] == [piece]


def test_batches_do_not_matter(model, monkeypatch):
    texts = [t for t, _ in make(60, seed=31)] + ["", " ", "x"]
    whole = model.find(texts)
    monkeypatch.setattr(pii, "READ_AT_ONCE", 100)
    assert model.find(texts) == whole == [model.find([t])[0] for t in texts]


def test_pruned_decoding_equals_full_decoding(model):
    texts = [t for t, _ in make(80, seed=77)]
    lone = pii.Recogniser(model.keys, model.shapes, model.own, model.around, model.weights, model.trans, np.zeros_like(model.skip))
    r = lone.lexer.read(texts)
    unary = lone.unary(r).astype(np.float64)
    got = lone.decode(unary.copy(), r, texts)
    first = np.r_[True, r.owner[1:] != r.owner[:-1]]
    unary[first, 2::2] += pii.NEVER
    assert (got == viterbi(unary, lone.trans, Chain(r.lengths[r.lengths > 0]))).all()


def test_skip_edges_change_results(model):
    """Without the skip potentials some recurring names of made-up documents come out otherwise; with them more are right."""
    samples = make(3000, seed=4242)
    texts = [t for t, _ in samples]
    lone = pii.Recogniser(model.keys, model.shapes, model.own, model.around, model.weights, model.trans, np.zeros_like(model.skip))
    a, b = model.find(texts), lone.find(texts)
    assert sum(x != y for x, y in zip(a, b)) > 10
    right = lambda found: sum(len(set(t) & set(f)) - len(set(f) - set(t)) for (_, t), f in zip(samples, found))
    assert right(a) > right(b)


#: Sentences written by hand in other words than the samples: {piece|kind letter}.
OTHER_WORDS = """
Yesterday evening {Margaret Ellsworth|N} handed in her keys at reception.
The invoice should go to {Tom Whitfield|N}, not to the branch.
Has anybody seen {Deborah Kane|N} since lunch?
Voicemail from {(212) 555 0188|P}, no message left.
Her badge shows {Q48213377|I} under the photo.
They are renovating {17 Maple Avenue|A} until autumn.
Escalated to {Samuel B. Ortega|N} because the disk was full.
Bug filed against the Merge Policy; {Hollis, Janet|N} has the traceback.
I forwarded it to {j.hollis@northgate.example|E} and to {sam (at) northgate.example|E} as well.
Our landlord is {Peter O'Malley|N}, his office is {203B King Street|A}.
SSN {512-44-7810|I} must not show up in the export.
Ms. {Nkechi Okonkwo|N} will present the Annual Report on Tuesday.
Der Schlüssel liegt bei {Annegret Pohl|N} im zweiten Stock.
Wir treffen uns um acht vor {Lindenstraße 14a|A}.
Notruf nachts: {0151 23456789|P}, fragen Sie nach {Karsten Wehrmann|N}.
Seine Steuernummer lautet {93 815 036 207|I}.
Frau {Henriette von Bülow|N} hat den Antrag zurückgezogen.
El informe lo redactó {Consuelo Ibáñez|N} en marzo.
Vive en la {Calle Mayor, 23|A} desde hace años.
Me dio su DNI, {48213377K|I}, y se fue.
Pregunta por {Andrés Llorente|N}, extensión del {912 345 678|P}.
Le courrier est adressé à {Mathilde Garnier|N}.
Ils ont emménagé {8 bis rue des Lilas|A} samedi.
Son numéro, {06 12 34 56 78|P}, ne répond plus.
Le dossier de {Yves Lemaître|N} est incomplet.
De sleutel ligt bij {Annelies Vermeer|N} op kantoor.
Zij wonen al jaren op {Prinsengracht 112|A}.
Mijn nieuwe nummer is {06 1234 5678|P}.
A chave está com {Leonor Figueiredo|N} na receção.
Mudaram-se para a {Rua das Flores, 45|A} no sábado.
O CPF dela é {123.456.789-09|I}, confirme por favor.
Ключи у {Марина Афанасьева|N} на втором этаже.
Они живут по адресу {ул. Садовая, д. 12|A} уже давно.
Мой новый номер {+7 916 123-45-67|P}, запишите.
钥匙在{陈晓东|N}那里，请下午去取。
{赵丽华|N}上周搬到了{建国路88号|A}。
我的新手机号是{13912345678|P}，旧的不用了。
他的身份证号是{110101199003078515|I}。
会议由{诸葛文涛|N}主持，{孙莉|N}做记录。
The Northwind Traders catalogue lists 48213377 items in 12 groups.
Chapter 4 of the Quick Start Guide explains the Query Planner.
On Monday New York Airport was closed for 3 hours, flight 4821 left late.
Der Parser liest die Tabelle, der Index wächst auf 93815036 Zeilen.
Release 4.12.7 fixes ticket 48213 and order 20240117.
搜索服务每小时重新加载词典，日志保留七天。
"""


def test_other_words(model):
    """Figures on phrasing that the samples do not share, which the README gives; the bounds only guard against a fall."""
    hit = found = true = 0
    letters = dict(zip("NEPIA", pii.KINDS))
    for line in OTHER_WORDS.strip().split("\n"):
        text, want = "", set()
        for i, part in enumerate(re.split(r"[{}]", line)):
            if i % 2:
                piece, kind = part.split("|")
                want.add((len(text), len(text) + len(piece), letters[kind]))
                part = piece
            text += part
        got = set(model.find([text])[0])
        for x in want ^ got:
            print("missed" if x in want else "extra", text[x[0] : x[1]], x[2], "|", text)
        hit, found, true = hit + len(want & got), found + len(got), true + len(want)
    print(f"recall {hit / true:.3f}, precision {hit / found:.3f} of {true}")
    assert hit / true > 0.75 and hit / found > 0.85


CASES = [None, "", "   ", "nothing here", "x" * 200_000, "Tel. 555-555-0123", "😀 请联系王芳，邮箱 a.b@mail.example，电话 010-55501234。", "From: Mara O'Drannery <mara [at] corp [dot] test>\n" * 300]


def test_find_and_redact(spark, model):
    df = spark.createDataFrame(list(enumerate(CASES)), "kind long, text string").repartition(3)
    rows = [tuple(r) for r in pii.find_pii(df.toDF("k", "t"), "k", "t", model).collect()]
    assert (5, "phone", 5, 17) in rows
    zh = CASES[6]
    assert {(kind, zh[a:b]) for k, kind, a, b in rows if k == 6} == {("name", "王芳"), ("email", "a.b@mail.example"), ("phone", "010-55501234")}
    assert sum(k == 7 for k, *_ in rows) == 600
    done = {r["k"]: r["text"] for r in pii.redact_pii(df.toDF("k", "t"), "k", "t", model).collect()}
    assert [done[i] for i in range(5)] == CASES[:5] and done[5] == "Tel. [PHONE]"
    assert done[7] == "From: [NAME] <[EMAIL]>\n" * 300
    assert pii.find_pii(spark.createDataFrame([], "k long, t string"), "k", "t", model).count() == 0


def test_redaction_changes_nothing_else():
    r = random.Random(1)
    for text, spans in make(100, seed=r.randint(0, 99)):
        out, rest = pii.redact(text, spans), text
        for a, b, kind in sorted(spans, reverse=True):
            rest = rest[:a] + f"[{kind.upper()}]" + rest[b:]
        assert out == rest
