"""Language of documents and of their paragraphs, with a confidence.

Word-first backoff: a known word is scored by its frequency in each language;
an unseen word falls back to its longest known character n-grams.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Usual names of the languages: two-letter code, three-letter codes, English name.
NAMES = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german"),
    "es": ("es", "spa", "spanish"),
    "fr": ("fr", "fra", "fre", "french"),
    "nl": ("nl", "nld", "dut", "dutch"),
    "pt": ("pt", "por", "portuguese"),
    "ru": ("ru", "rus", "russian"),
    "zh": ("zh", "zho", "chi", "cmn", "chinese"),
}
LANGS = tuple(NAMES)

#: Words: each Han sign alone, any other run of letters as a whole.
WORD = re.compile(r"[㐀-䶿一-鿿]|[^\W\d_㐀-䶿一-鿿]+")

#: Bound of the labelled sample, in records per language, on which the model is fitted.
FIT_RECORDS = 400
MAX_N = 5


def label_code(label: Column) -> Column:
    """The code of a label in any usual spelling, or null where it names none of the languages."""
    first = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]+)", 1)
    table = F.create_map(*[F.lit(x) for code, names in NAMES.items() for n in names for x in (n, code)])
    return F.try_element_at(table, first)


class Model:
    """Per-language log frequencies of words and of n-grams, relative to the mean language."""

    def __init__(self, words: dict[str, np.ndarray], grams: list[dict[str, np.ndarray]], limit: float = 4.0):
        self.index = {w: i for i, w in enumerate(words)}
        n = len(LANGS)
        self.table = np.array(list(words.values()), np.float32).reshape(-1, n)
        self.grams = grams
        self.limit = limit
        self._unseen: dict[str, np.ndarray] = {}

    def unseen(self, word: str) -> np.ndarray:
        """Mean score of the longest n-grams of which any is known; zeros if none is."""
        got = self._unseen.get(word)
        if got is not None:
            return got
        padded = f" {word} "
        got = np.zeros(len(LANGS), np.float32)
        for n in range(min(MAX_N, len(padded)), 0, -1):
            table = self.grams[n - 1]
            hit = [table[g] for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) in table]
            if hit:
                # the share of known grams tempers the evidence of a word that is mostly strange
                got = (np.mean(hit, axis=0) * (len(hit) / (len(padded) - n + 1))).astype(np.float32)
                break
        if len(self._unseen) > 300_000:
            self._unseen.clear()
        self._unseen[word] = got
        return got

    def scores(self, texts: list[str]) -> np.ndarray:
        """Sum of the word scores of each text, one column per language."""
        index, ids, ends, extra = self.index, [], [], []
        base = len(self.table)
        new: dict[str, int] = {}
        for t in texts:
            for w in WORD.findall(t.lower()):
                k = index.get(w)
                if k is None:
                    k = new.get(w)
                    if k is None:
                        k = new[w] = base + len(extra)
                        extra.append(self.unseen(w))
                ids.append(k)
            ends.append(len(ids))
        out = np.zeros((len(texts), len(LANGS)))
        if not ids:
            return out
        table = np.vstack([self.table, np.array(extra, np.float32)]) if extra else self.table
        got = table[np.array(ids)]
        run = np.vstack([np.zeros((1, len(LANGS))), np.cumsum(got, axis=0, dtype=np.float64)])
        ends = np.array(ends)
        return run[ends] - run[np.r_[0, ends[:-1]]]


def _tables(counts: dict[str, Counter], least: int, a: float, limit: float) -> dict[str, np.ndarray]:
    """Clipped log frequency of each item in each language, less its mean over the languages."""
    total = np.array([sum(counts[lang].values()) for lang in LANGS], float)
    items = Counter()
    for c in counts.values():
        items.update(c)
    keep = [x for x, n in items.items() if n >= least]
    if not keep:
        return {}
    m = np.array([[counts[lang][x] for lang in LANGS] for x in keep], float)
    # smoothing in proportion to each language's share, so that a small sample gives no advantage
    share = (total + 1) / (total + 1).sum()
    logp = np.log((m + a * len(LANGS) * share) / (total + 1))
    logp -= logp.mean(axis=1, keepdims=True)
    return dict(zip(keep, np.clip(logp, -limit, limit).astype(np.float32)))


def fit(texts: list[str], labels: list[str], rounds: int = 2, limit: float = 4.0) -> Model:
    """Fit on labelled texts. Wrong labels are allowed: after the first fit each paragraph is relabelled by the model."""
    paras = [(p, lab) for t, lab in zip(texts, labels) for p in t.split("\n") if p]
    model = None
    for _ in range(rounds):
        if model is not None:
            s = model.scores([p for p, _ in paras])
            paras = [(p, LANGS[k]) if top > 0 else (p, lab) for (p, lab), k, top in zip(paras, s.argmax(1), s.max(1))]
        words: dict[str, Counter] = defaultdict(Counter)
        for p, lab in paras:
            words[lab].update(WORD.findall(p.lower()))
        grams: list[dict[str, Counter]] = [defaultdict(Counter) for _ in range(MAX_N)]
        for lab, ws in words.items():
            for w, k in ws.items():
                padded = f" {w} "
                # word types count by the root of their frequency, so one frequent word does not make a gram typical
                k = max(1, round(k**0.5))
                for n in range(1, MAX_N + 1):
                    c = grams[n - 1][lab]
                    for i in range(len(padded) - n + 1):
                        c[padded[i : i + n]] += k
        model = Model(_tables(words, 3, 0.5, limit), [_tables(g, 4, 1.0, limit / 2) for g in grams], limit)
    return model


def labelled_sample(rows: DataFrame, text: str, label: str, key: str, per_language: int = FIT_RECORDS) -> tuple[list[str], list[str]]:
    """At most ``per_language`` labelled texts of each language, chosen by a hash of ``key``: the smallest hashes.

    One aggregation counts the texts of each language, from which follows up to
    which hash some twice as many as wanted lie; one pass then reads those. The
    driver gets a bounded number of rows, however many there are.
    """
    base = rows.select(F.col(text).alias("_t"), label_code(F.col(label)).alias("_l"), F.xxhash64(key).alias("_h")).where(
        F.col("_l").isNotNull() & (F.length("_t") > 0)
    )
    counts = {r["_l"]: r["n"] for r in base.groupBy("_l").agg(F.count("*").alias("n")).collect()}
    # of hashes spread evenly, fewer than wanted below the limit do not occur
    limits = {lang: round(2**64 * (2 * per_language + 200) / n) - 2**63 for lang, n in counts.items() if n > 2 * per_language + 200}
    some = base
    for lang, limit in limits.items():
        some = some.where((F.col("_l") != lang) | (F.col("_h") < limit))
    got = sorted(map(tuple, some.select("_l", "_h", "_t").collect()))
    out: list[tuple[str, str]] = []
    for lang in LANGS:
        out += [(t, lab) for lab, _, t in got if lab == lang][:per_language]
    return [t for t, _ in out], [lab for _, lab in out]


def paragraph_languages(rows: DataFrame, key: str, text: str, model: Model, temperature: float = 4.0) -> DataFrame:
    """``key, para, lang, confidence, doc_lang, doc_confidence``: one row per line of each text.

    Lines are counted from 0. The confidence is the posterior of the language
    under the tempered scores. A line without evidence takes the language of
    its whole text; a text without any has null languages and confidence 0. A
    null text gives no rows, an empty one a single row with nulls.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    langs = np.array(LANGS, dtype=object)

    def posterior(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = s / temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        k = s.argmax(axis=1)
        conf = z[np.arange(len(s)), k] / z.sum(axis=1)
        none = ~np.any(s, axis=1)
        lang = langs[k].copy()
        lang[none] = None
        conf[none] = 0.0
        return lang, conf

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for f in frames:
            f = f[f["_t"].notna()]
            if f.empty:
                continue
            lines = [t.split("\n") for t in f["_t"]]
            n = np.array([len(x) for x in lines])
            s = m.scores([p for x in lines for p in x])
            starts = np.r_[0, np.cumsum(n)[:-1]]
            whole = np.add.reduceat(s, starts, axis=0)
            lang, conf = posterior(s)
            dl, dc = posterior(whole)
            dl, dc = np.repeat(dl, n), np.repeat(dc, n)
            none = np.array([x is None for x in lang])
            lang[none], conf[none] = dl[none], dc[none] * 0.5
            para = np.arange(len(s)) - np.repeat(starts, n)
            yield pd.DataFrame({"_k": np.repeat(f["_k"].to_numpy(), n), "para": para, "lang": lang, "confidence": conf, "doc_lang": dl, "doc_confidence": dc})

    kind = rows.schema[key].dataType.simpleString()
    out = rows.select(F.col(key).alias("_k"), F.col(text).alias("_t")).mapInPandas(
        work, f"_k {kind}, para long, lang string, confidence double, doc_lang string, doc_confidence double"
    )
    return out.withColumnRenamed("_k", key)


def relabelled(paras: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Paragraphs of the texts whose label is absent, names no language or another one, or whose languages differ.

    The paragraphs of one text are not gathered: what is needed of a text is the
    least and the greatest of its languages.
    """
    per = paras.groupBy(key).agg(F.min("lang").alias("_lo"), F.max("lang").alias("_hi"))
    code = labels.select(key, label_code(F.col(label)).alias("_code"))
    bad = per.join(code, key, "left").where(
        F.col("_code").isNull() | (F.col("_lo") != F.col("_hi")) | (F.col("_code") != F.col("_lo"))
    )
    return paras.join(bad.select(key), key, "left_semi")
