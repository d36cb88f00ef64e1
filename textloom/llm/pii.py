"""Personal data in free text: found by a skip-chain conditional random field, replaced by placeholders."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm.crf import NEVER, Chain, certain, legal, loopy, marginals, train, train_skip, viterbi
from textloom.llm.pii_samples import SURNAMES_ZH, make

KINDS = ("name", "email", "phone", "id_number", "address")
#: Label 0 is outside; 2k+1 begins and 2k+2 continues kind k.
N_LABELS = 1 + 2 * len(KINDS)
#: Class of each label at the ends of a skip edge: a kind, or outside.
CLASSES = np.array([0] + [1 + k for k in range(len(KINDS)) for _ in range(2)])

#: Documents made up for fitting, a bound of the model and of nothing else.
FIT_DOCUMENTS = 9000
#: Characters of the texts that are read at once; a longer text is read alone.
READ_AT_ONCE = 800_000

_HAN = "㐀-鿿"
_AT = r"(?:\s?[@＠]\s?|\s?[\[({]\s?at\s?[\])}]\s?|&\#64;)"
_DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?)"

#: What every address has between its parts; only there are the parts looked for.
MARK = re.compile(_AT)
#: The sign itself, or the word with the bracket after it.
SIGN = re.compile(r"[@＠]|&\#64;|at\s?[\])}]")
LOCAL = re.compile(r"[A-Za-z0-9_%+À-ɏ][A-Za-z0-9._%+\-À-ɏ]{0,63}$")
DOMAIN = re.compile(rf"[A-Za-z0-9À-ɏ][A-Za-z0-9\-À-ɏ]*(?:{_DOT}[A-Za-z0-9][A-Za-z0-9\-]*)+")

_PARTS = (
    ("S", r"\s+"),
    ("V", rf"[^\W\d_A-Z{_HAN}][^\W\d_{_HAN}]*(?:['’\-][^\W\d_{_HAN}]+)*"),
    ("H", rf"[{_HAN}]"),
    ("A", r"(?<![A-Za-z0-9])(?=[A-Z0-9]*[0-9])(?=[A-Z0-9]*[A-Z])[A-Z0-9]{7,}(?![A-Za-z0-9])|(?<![A-Za-z0-9])[A-Z]{1,2}(?:[ ]\d{2,3}){2,4}[ ][A-Z](?![A-Za-z0-9])"),
    ("N", r"(?<![A-Za-z0-9_])(?:\+\d{1,3}[ \xa0]?\(\d+\)|\d{1,3}[ \xa0]\(\d{2,4}\)|\(\d+\)|\+?\d+)(?:[ \xa0.\-/]?\d+)*(?:-?[A-Za-z](?![A-Za-z0-9]))?"),
    ("W", rf"[^\W\d_{_HAN}]+(?:['’\-][^\W\d_{_HAN}]+)*"),
    ("P", r"\S"),
)
#: Cuts a text into tokens and the blanks between them, leaving nothing out.
TOKEN = re.compile("|".join(p for _, p in _PARTS))
_KIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _PARTS))

_DIGITS = str.maketrans("123456789", "000000000")
_SURNAMES = frozenset(SURNAMES_ZH.split())


def _level(sign: str) -> str:
    """Whether a Han sign is of the common or of the rarer set of its encoding, or of neither."""
    try:
        return "common" if sign.encode("gb2312")[0] < 0xD8 else "rare"
    except UnicodeEncodeError:
        return "other"


def _word_forms(kind: str, s: str) -> tuple[str, str, tuple[str, ...]]:
    """Key, shape and own features of a token."""
    if kind == "E":
        return "<mail>", "E" + s, ("E" + s,)
    if kind in "NA":
        zero = s.translate(_DIGITS).replace("\u00a0", " ")
        n = zero.count("0")
        size = "1-2" if n <= 2 else "3" if n == 3 else "4-6" if n <= 6 else "7-8" if n <= 8 else "9-11" if n <= 11 else "12+"
        mask = re.sub("[A-Z]", "X", zero)
        mask = re.sub("[a-z]", "x", mask)
        return "<num" + size, "N" + size, ("m=" + mask, "n=" + size, "lead=" + mask[:1], "run=" + re.sub("0+", "0", mask), "plus" if "+" in s else "none")
    if kind == "H":
        family = "1" if s in _SURNAMES else "0"
        return s, "H" + family, ("h=" + s, "lv=" + _level(s) + family)
    if kind == "W":
        low = s.lower()
        if s.isupper():
            shape = "X." if len(s) == 1 else "XX"
        elif s[:1].isupper():
            shape = "Xx" if "-" not in s and "'" not in s and "’" not in s else "Xx-"
        elif s != low:
            shape = "xX"
        else:
            shape = "x"
        script = "c" if "Ѐ" <= s[-1] <= "ӿ" else "l"
        return low, shape + script, ("w=" + low, "s2=" + low[-2:], "s3=" + low[-3:], "s4=" + low[-4:], "s6=" + low[-6:], "len=" + ("1" if len(s) == 1 else "2" if len(s) < 4 else "9"))
    return s, "P" + s, ("p=" + s,)


#: Most features a token has of its own, and how its neighbours' codes make the others.
OWN = 6
AROUND = ("k-1", "k+1", "k-2", "k+2", "h-h", "hh+", "h-hh+", "h--h-h", "hh+h++", "gg+", "gh", "k-h", "hk+", "n-h", "n--h", "k--k-", "k+k++", "k-k", "n--n-")
EDGE, UNKNOWN = 0, 1
#: Kinds of skip edges: equal words that stand with other capitals, equal pairs of Han signs, numbers equal in their digits.
WORDS, SIGNS, NUMBERS = range(3)


class Lexer:
    """Turns texts into numbered tokens; remembers the forms it has met.

    ``keys`` and ``shapes`` number the known keys and shapes from 2; 0 is the
    edge of a text and 1 anything unknown.
    """

    def __init__(self, keys: dict[str, int] | None = None, shapes: dict[str, int] | None = None):
        self.keys, self.shapes = keys, shapes
        self.clear()

    def clear(self) -> None:
        self.forms: dict[str, int] = {}
        self.masks: dict[str, int] = {}
        self.key: list[int | str] = [EDGE]
        self.shape: list[int | str] = [EDGE]
        self.own: list[tuple[str, ...]] = [()]
        #: length, gap (0 for tokens), whether a word, whether it starts like a name, kind of skip edge, number of the word in any case
        self.traits: list[tuple[int, int, int, int, int, int]] = [(0, 0, 1, 0, -1, 0)]
        self.words: dict[str, int] = {}
        self.mails = [self._add("E", x, 0) for x in ("tld", "num")]
        self.columns = np.zeros((0, 8), np.int64)

        class Numbers(dict):
            def __missing__(this, s: str) -> int:  # noqa: N805
                return self._form(s)

        self.forms = Numbers()

    def _add(self, kind: str, s: str, length: int) -> int:
        if kind == "S":
            row, traits = ("", "", ()), (length, 3 if "\n" in s else 2, 0, 0, -1, 0)
        else:
            row = _word_forms(kind, s)
            capital = kind == "W" and row[1][0] == "X"
            link = WORDS if capital and len(s) > 2 else SIGNS if kind == "H" else NUMBERS if kind in "NA" and sum(c.isdigit() for c in s) >= 6 else -1
            traits = (length, 0, kind in "WH", capital, link, self.words.setdefault(row[0], len(self.words)) if link in (WORDS, SIGNS) else 0)
        self.key.append(row[0] if self.keys is None else self.keys.get(row[0], UNKNOWN))
        self.shape.append(row[1] if self.shapes is None else self.shapes.get(row[1], UNKNOWN))
        self.own.append(row[2])
        self.traits.append(traits)
        return len(self.key) - 1

    def _form(self, s: str) -> int:
        m = _KIND.fullmatch(s)
        kind = m.lastgroup if m else "P"
        kind = "W" if kind == "V" else kind
        if kind in "NA":
            # numbers of one layout are one form
            mask = s.translate(_DIGITS)
            i = self.masks.get(mask)
            if i is None:
                i = self.masks[mask] = self._add(kind, s, len(s))
            return i
        i = self.forms[s] = self._add(kind, s, len(s))
        return i

    def mail_spans(self, text: str) -> list[tuple[int, int]]:
        """Addresses, looked for only where one of the signs for "at" stands."""
        places = [m.start() for m in SIGN.finditer(text)]
        out, last = [], 0
        for at in places:
            # a blank and a bracket may stand before the sign
            m = next((m for x in (at - 3, at - 2, at - 1, at) if x >= last and (m := MARK.match(text, x)) and m.end() > at), None)
            if m is None:
                continue
            a, b = m.span()
            local = LOCAL.search(text, max(last, a - 66), a)
            domain = DOMAIN.match(text, b)
            if local and domain:
                out.append((local.start(), domain.end()))
                last = domain.end()
        return out

    def read(self, texts: list[str]) -> Read:
        """All tokens of the texts, each text between two edges on either side."""
        if len(self.key) > 300_000:
            self.clear()
        get, cut = self.forms.__getitem__, TOKEN.findall
        ids: list[int] = [0, 0]
        at: list[int] = []
        mails: list[tuple[int, int]] = []
        for text in texts:
            at.append(len(ids))
            last = 0
            if "@" in text or "＠" in text or "at" in text or "&#64;" in text:
                for a, b in self.mail_spans(text):
                    ids += map(get, cut(text, last, a))
                    ending = re.split(r"[.\])}\s]+", text[a:b])[-1]
                    mails.append((len(ids), b - a))
                    ids.append(self.mails[0] if ending.isalpha() and len(ending) > 1 else self.mails[1])
                    last = b
            ids += map(get, cut(text, last))
            ids += (0, 0)
        if len(self.columns) < len(self.key):
            old = len(self.columns)
            more = np.array([(0 if self.keys is None else k, 0 if self.shapes is None else h, *t) for k, h, t in zip(self.key[old:], self.shape[old:], self.traits[old:])], np.int64)
            self.columns = np.concatenate([self.columns, more])
        i = np.array(ids, np.int64)
        length, space = self.columns[:, 2].take(i), self.columns[:, 3].take(i)
        for k, n in mails:
            length[k] = n
        end = np.cumsum(length)
        first = np.array(at, np.int64)
        # a token's gap is that of the blank before it
        gap = np.ones(len(i), np.int64)
        gap[1:] = np.maximum(space[:-1], 1)
        gap[i == 0] = 0
        token = np.flatnonzero(space == 0)
        owner = np.searchsorted(first, token, side="right") - 1
        base = end.take(first - 1)
        i, gap, end, length = i.take(token), gap.take(token), end.take(token), length.take(token)
        c = self.columns.take(i, axis=0)
        real = np.flatnonzero(i)
        owner = owner.take(real)
        stop = end.take(real) - base.take(owner)
        return Read(i, c, gap, real, np.bincount(owner, minlength=len(texts)), owner, np.c_[stop - length.take(real), stop])


class Read:
    """Tokens of some texts with their edges: forms, their columns and gaps; and of the real tokens place, text and span."""

    def __init__(self, form, columns, gap, real, lengths, owner, spans):
        self.form, self.columns, self.gap, self.real, self.lengths, self.owner, self.spans = form, columns, gap, real, lengths, owner, spans

    def codes(self, key: np.ndarray, shape: np.ndarray, n_keys: int, n_shapes: int) -> dict[str, np.ndarray]:
        """Codes of ``AROUND`` for every real token."""
        at, last = self.real, len(key) - 1
        k0, k1, k2, km1, km2 = key.take(at), key.take(at + 1), key.take(np.minimum(at + 2, last)), key.take(at - 1), key.take(at - 2)
        h0, h1, h2, hm1, hm2 = shape.take(at), shape.take(at + 1), shape.take(np.minimum(at + 2, last)), shape.take(at - 1), shape.take(at - 2)
        g0, g1 = self.gap.take(at), self.gap.take(at + 1)
        # the last two words before a token, whatever signs stand between; the edge of the text counts as one
        n = np.arange(len(key))
        before = np.r_[0, np.maximum.accumulate(np.where(self.columns[:, 4] > 0, n, 0))[:-1]]
        w1 = before.take(at)
        n1, n2 = key.take(w1), key.take(before.take(w1))
        s, k = n_shapes, n_keys
        hh, hn = hm1 * s + h0, h0 * s + h1
        return {
            "k-1": km1, "k+1": k1, "k-2": km2, "k+2": k2, "h-h": hh, "hh+": hn, "h-hh+": hh * s + h1, "h--h-h": hm2 * s * s + hh, "hh+h++": hn * s + h2, "gg+": g0 * 4 + g1, "gh": g0 * s + h0,
            "k-h": km1 * s + h0, "hk+": k1 * s + h0, "n-h": n1 * s + h0, "n--h": n2 * s + h0, "k--k-": km2 * k + km1, "k+k++": k1 * k + k2, "k-k": km1 * k + k0, "n--n-": n2 * k + n1,
        }

    def edges(self, texts: list[str], open_: np.ndarray) -> np.ndarray:
        """Skip edges ``(left, right, type)`` between open tokens of one text that recur in it."""
        link = self.columns[:, 6].take(self.real)
        some = np.flatnonzero(open_ & (link >= 0))
        none = np.zeros((0, 3), np.int64)
        if not len(some):
            return none
        kind, place = link.take(some), self.real.take(some)
        capital, word, last = self.columns[:, 5], self.columns[:, 7], len(self.form) - 1
        after = np.minimum(place + 1, last)
        beside = (capital.take(place - 1) + capital.take(after) + capital.take(place - 2) + capital.take(np.minimum(place + 2, last))) > 0
        paired = (self.columns[:, 6].take(after) == SIGNS) & (self.gap.take(after) == 1)
        keep = np.where(kind == WORDS, beside, np.where(kind == SIGNS, paired, True))
        some, kind, place, after = some[keep], kind[keep], place[keep], after[keep]
        if not len(some):
            return none
        one, two = word.take(place), np.where(kind == SIGNS, word.take(after), 0)
        # of a number the last digits: prefixes come and go
        digits: dict[str, int] = {}
        for i in np.flatnonzero(kind == NUMBERS).tolist():
            t, (a, b) = int(self.owner[some[i]]), self.spans[some[i]].tolist()
            one[i] = digits.setdefault("".join(c for c in texts[t][a:b] if c.isalnum())[-7:], len(digits))
        order = np.lexsort((two, one, kind, self.owner.take(some)))
        some, kind, one, two = some[order], kind[order], one[order], two[order]
        owner = self.owner.take(some)
        alike = (owner[1:] == owner[:-1]) & (kind[1:] == kind[:-1]) & (one[1:] == one[:-1]) & (two[1:] == two[:-1])
        # each with the next of its group, and the last of three or more with the first
        first = np.flatnonzero(np.r_[True, ~alike])
        end = np.r_[first[1:], len(some)] - 1
        rings = end - first >= 2
        left, right = np.r_[np.flatnonzero(alike), end[rings]], np.r_[np.flatnonzero(alike) + 1, first[rings]]
        return np.c_[some[left], some[right], kind[left]]


class Pairs:
    """Exact lookup of numbers by 64-bit codes: two tables by two hashes, each code stored once."""

    BITS = 18

    def __init__(self, codes: np.ndarray, numbers: np.ndarray):
        self.tables = []
        for salt in range(64):
            slot = self._slot(codes, salt)
            _, first = np.unique(slot, return_index=True)
            keys, values = np.full(1 << self.BITS, -1, np.int64), np.zeros(1 << self.BITS, np.int32)
            keys[slot[first]], values[slot[first]] = codes[first], numbers[first]
            self.tables.append((salt, keys, values))
            rest = np.ones(len(codes), bool)
            rest[first] = False
            codes, numbers = codes[rest], numbers[rest]
            if not len(codes):
                return
        raise ValueError("too many pairs for the table")

    def _slot(self, codes: np.ndarray, salt: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * salt * 0x632BE59BD9B4E019 & (1 << 64) - 1)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def __getitem__(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes), np.int32)
        for salt, keys, values in self.tables:
            slot = self._slot(codes, salt)
            out += np.where(keys.take(slot) == codes, values.take(slot), 0)
        return out


class Recogniser:
    """The fitted field: known keys, shapes and features with their weights, transitions and skip potentials."""

    def __init__(self, keys: dict[str, int], shapes: dict[str, int], own: dict[str, int], around: dict[str, tuple[np.ndarray, np.ndarray]], weights: np.ndarray, trans: np.ndarray, skip: np.ndarray):
        self.keys, self.shapes, self.own, self.around = keys, shapes, own, around
        self.weights, self.trans, self.skip = weights, trans, skip
        self._compile()

    def __getstate__(self):
        return (self.keys, self.shapes, self.own, self.around, self.weights, self.trans, self.skip)

    def __setstate__(self, state):
        self.keys, self.shapes, self.own, self.around, self.weights, self.trans, self.skip = state
        self._compile()

    def _compile(self) -> None:
        """Tables in which a code finds its weights: dense rows for one key, numbers of rows for the rest."""
        self.lexer = Lexer(self.keys, self.shapes)
        w = self.w = self.weights.astype(np.float32)
        self.n_keys, self.n_shapes = len(self.keys) + 2, len(self.shapes) + 2
        s = self.n_shapes
        dense = {t: np.zeros(self.n_keys, np.int32) for t in ("k-1", "k+1", "k-2", "k+2")}
        dense |= {t: np.zeros(s**3, np.int32) for t in ("h--h-h", "hh+h++")}
        dense |= {t: np.zeros(self.n_keys * s, np.int32) for t in ("k-h", "hk+", "n-h", "n--h")}
        dense |= {"h-h": np.zeros(s * s, np.int32), "hh+": np.zeros(s * s, np.int32), "h-hh+": np.zeros(s**3, np.int32), "gg+": np.zeros(16, np.int32), "gh": np.zeros(4 * s, np.int32)}
        self.sparse = {}
        for t, (codes, numbers) in self.around.items():
            if t in dense:
                dense[t][codes] = numbers
            elif t != "h":
                self.sparse[t] = Pairs(codes, numbers)
        self.rows = {t: w[dense.pop(t)] for t in ("k-1", "k+1", "k-2", "k+2")}
        a, b = w[dense.pop("h-h")].reshape(s, s, 1, -1), w[dense.pop("hh+")].reshape(1, s, s, -1)
        self.shapes3 = np.ascontiguousarray((a + b + w[dense.pop("h-hh+")].reshape(s, s, s, -1)).reshape(s**3, -1))
        self.gaps = (w[dense.pop("gg+")].reshape(4, 4, 1, -1) + w[dense.pop("gh")].reshape(4, 1, s, -1)).reshape(16 * s, -1)
        self.numbers = dense
        self._own = np.zeros((0, N_LABELS), np.float32)

    def _own_rows(self) -> np.ndarray:
        have, all_ = len(self._own), self.lexer.own
        if have > len(all_):
            have, self._own = 0, self._own[:0]
        if have < len(all_):
            numbers = np.zeros((len(all_) - have, OWN), np.int64)
            get = self.own.get
            for i, features in enumerate(all_[have:]):
                for j, f in enumerate(features):
                    numbers[i, j] = get(f, 0)
            shape = np.array(self.lexer.shape[have:], np.int64)
            named = self.own_shapes[shape]
            self._own = np.concatenate([self._own, self.w[numbers].sum(axis=1) + self.w[named]])
        return self._own

    @property
    def own_shapes(self) -> np.ndarray:
        codes, numbers = self.around["h"]
        out = np.zeros(self.n_shapes, np.int64)
        out[codes] = numbers
        return out

    def unary(self, r: Read) -> np.ndarray:
        """Scores of every label for every token."""
        own = self._own_rows()
        key, shape, s = np.ascontiguousarray(r.columns[:, 0]), np.ascontiguousarray(r.columns[:, 1]), self.n_shapes
        out = np.empty((len(r.real), N_LABELS), np.float32)
        all_codes = r.codes(key, shape, self.n_keys, s)
        all_codes["gap"] = all_codes["gg+"] * s + shape[r.real]
        form = r.form[r.real]
        # blocks that stay in the cache
        for at in range(0, len(out), 16_384):
            c = {t: x[at : at + 16_384] for t, x in all_codes.items()}
            u = own.take(form[at : at + 16_384], axis=0)
            for t in ("k-1", "k+1", "k-2", "k+2"):
                u += self.rows[t].take(c[t], axis=0)
            u += self.shapes3.take(c["h-hh+"], axis=0)
            u += self.gaps.take(c["gap"], axis=0)
            for t, table in self.numbers.items():
                u += self.w.take(table.take(c[t]), axis=0)
            for t, table in self.sparse.items():
                u += self.w.take(table[c[t]], axis=0)
            out[at : at + 16_384] = u
        return out

    def find(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Spans ``(start, end, kind)`` of each text, in code points."""
        out: list[list[tuple[int, int, str]]] = []
        some: list[str] = []
        size = 0
        for text in texts:
            if some and size + len(text) > READ_AT_ONCE:
                out += self._find(some)
                some, size = [], 0
            some.append(text)
            size += len(text)
        return out + (self._find(some) if some else [])

    def _find(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        if self.lexer.key and len(self.lexer.key) > 300_000:
            self.lexer.clear()
            self._own = self._own[:0]
        r = self.lexer.read(texts)
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if not len(r.real):
            return out
        labels = self.decode(self.unary(r), r, texts)
        # only stretches of labelled tokens are looked at one by one
        on = np.flatnonzero(labels)
        for t, x, y, kind in _pieces(labels[on], r.owner[on], r.spans[on], np.r_[0, np.diff(on)] != 1):
            if plausible(kind, texts[t][x:y]):
                out[t].append((x, y, kind))
        return out

    def decode(self, unary: np.ndarray, r: Read, texts: list[str]) -> np.ndarray:
        """Best labels under the field.

        Tokens proven to be outside on every best path of their chain split it;
        between them the decoding is the same as over the whole chain. Skip
        edges join open tokens, and the stretches they touch go through message
        passing first.
        """
        n = len(unary)
        last = np.r_[r.owner[1:] != r.owner[:-1], True]
        first = np.r_[True, last[:-1]]
        unary[first, 2::2] += NEVER
        open_ = ~certain(unary, self.trans, first, last)
        out = np.zeros(n, np.int64)
        rows = np.flatnonzero(open_)
        if not len(rows):
            return out
        place = np.full(n, -1)
        place[rows] = np.arange(len(rows))
        begins = np.r_[True, (np.diff(rows) != 1) | first[rows[1:]]]
        ends = np.r_[begins[1:], True]
        u = unary.take(rows, axis=0).astype(np.float64)
        u[begins & ~first[rows]] += self.trans[0]
        u[ends & ~last[rows]] += self.trans[:, 0]
        starts = np.flatnonzero(begins)
        lengths = np.diff(np.r_[starts, len(rows)])
        edges = r.edges(texts, open_)
        if len(edges) and np.any(self.skip):
            edges = np.c_[place[edges[:, :2]], edges[:, 2]]
            self._pass(u, edges, np.cumsum(begins) - 1, starts, lengths)
        found = np.zeros(len(rows), np.int64)
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            # stretches of like length go together, as many as their padding allows
            size = max(1, min(4096, 40_000 // int(lengths[order[min(at + 255, len(order) - 1)]])))
            ws = order[at : at + size]
            at += size
            n = lengths[ws]
            x = np.repeat(starts[ws] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            found[x] = viterbi(u.take(x, axis=0), self.trans, Chain(n))
        out[rows] = found
        return out


    def _pass(self, u: np.ndarray, edges: np.ndarray, which: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        """Message passing over the stretches with edges; adds the messages to ``u``.

        A message changes the logarithm of the odds of two labels by no more
        than the spread of the potentials, and a token has at most two edges. So
        an edge of which both ends are surer than two messages can undo, with
        one to spare, is left out.
        """
        sure = 1.0 / (1.0 + np.exp(-1.0 - 2.0 * (self.skip.max(axis=1) - self.skip.min(axis=1)).max()))

        def part(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            linked = np.unique(which[edges[:, :2].reshape(-1)])
            n = lengths[linked]
            rows = np.repeat(starts[linked] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            new = np.zeros(len(u), np.int64)
            new[rows] = np.arange(len(rows))
            return rows, n, np.c_[new[edges[:, :2]], edges[:, 2]]

        rows, n, here = part(edges)
        belief = marginals(u.take(rows, axis=0), self.trans, n).max(axis=1)
        doubt = (belief < np.log(sure)).take(here[:, :2]).any(axis=1)
        if not doubt.any():
            return
        rows, n, here = part(edges[doubt])
        u[rows] = loopy(u.take(rows, axis=0), self.trans, Chain(n), here, self.skip)


def _pieces(labels: np.ndarray, owner: np.ndarray, spans: np.ndarray, broken: np.ndarray) -> Iterator[tuple[int, int, int, str]]:
    """Text, start, end and kind of each run of labels; ``broken`` marks tokens before which others lie."""
    text, start, end, kind = -1, 0, 0, -1
    for y, t, (a, b), cut in zip(labels.tolist(), owner.tolist(), spans.tolist(), broken.tolist()):
        k = (y - 1) // 2
        if y % 2 == 0 and k == kind and t == text and not cut:
            end = b
            continue
        if kind >= 0:
            yield text, start, end, KINDS[kind]
        text, start, end, kind = t, a, b, k
    if kind >= 0:
        yield text, start, end, KINDS[kind]


def plausible(kind: str, piece: str) -> bool:
    """Whether a piece has what its kind cannot do without, by its definition: two names, a sign between, digits."""
    digits = sum(c.isdigit() for c in piece)
    if kind == "name":
        return not digits and piece[0].isalpha() and (len(piece.split()) > 1 or (len(piece) > 1 and all("㐀" <= c <= "鿿" for c in piece)))
    if kind == "email":
        return MARK.search(piece) is not None and re.split(r"[.\])}\s]+", piece)[-1].isalpha()
    if kind == "address":
        return digits > 0 and any(c.isalpha() for c in piece)
    return digits >= 6


def _truth(samples: list[tuple[str, list[tuple[int, int, str]]]], r: Read) -> np.ndarray:
    """Labels of the tokens of labelled texts."""
    out = np.zeros(len(r.spans), np.int64)
    for i, (t, (x0, x1)) in enumerate(zip(r.owner.tolist(), r.spans.tolist())):
        for t0, t1, kind in samples[t][1]:
            if x0 >= t0 and x1 <= t1:
                out[i] = 2 * KINDS.index(kind) + (1 if x0 == t0 else 2)
                break
    return out


def _known(values: list[str], counts: np.ndarray) -> dict[str, int]:
    """Numbers from 2 of the values seen at least twice."""
    total: Counter[str] = Counter()
    for v, n in zip(values, counts.tolist()):
        total[v] += n
    return {v: i + 2 for i, v in enumerate(sorted(v for v, n in total.items() if n >= 2 and v))}


@lru_cache(maxsize=2)
def fit(documents: int = FIT_DOCUMENTS, seed: int = 11) -> Recogniser:
    """Fit on made-up documents: the chain first, then chain and skip potentials together. Features seen once are left out."""
    samples = make(documents, seed)
    texts = [t for t, _ in samples]
    raw = Lexer()
    seen = np.bincount(raw.read(texts).form, minlength=len(raw.key))
    keys, shapes = _known(raw.key[1:], seen[1:]), _known(raw.shape[1:], seen[1:])
    lexer = Lexer(keys, shapes)
    r = lexer.read(texts)
    form = r.form[r.real]
    codes = r.codes(r.columns[:, 0], r.columns[:, 1], len(keys) + 2, len(shapes) + 2) | {"h": r.columns[r.real, 1]}
    total: Counter[str] = Counter()
    for features, n in zip(lexer.own, np.bincount(form, minlength=len(lexer.own)).tolist()):
        for f in features:
            total[f] += n
    own = {f: i + 1 for i, f in enumerate(sorted(f for f, n in total.items() if n >= 2))}
    numbers = np.zeros((len(form), OWN + len(codes)), np.int32)
    rows = np.zeros((len(lexer.own), OWN), np.int32)
    for i, features in enumerate(lexer.own):
        rows[i, : len(features)] = [own.get(f, 0) for f in features]
    numbers[:, :OWN] = rows[form]
    at, around = len(own) + 1, {}
    for c, (t, x) in enumerate(codes.items()):
        values, where, n = np.unique(x, return_inverse=True, return_counts=True)
        number = np.where(n >= 2, at + np.cumsum(n >= 2) - 1, 0)
        around[t] = (values[number > 0], number[number > 0])
        at += int((n >= 2).sum())
        numbers[:, OWN + c] = number[where]
    truth = _truth(samples, r)
    w, trans = train(numbers, truth, r.lengths, at, N_LABELS)
    last = np.r_[r.owner[1:] != r.owner[:-1], True]
    first = np.r_[True, last[:-1]]
    unary = np.concatenate([w[numbers[i : i + 50_000]].sum(axis=1) for i in range(0, len(numbers), 50_000)])
    unary[first, 2::2] += NEVER
    edges = r.edges(texts, ~certain(unary, trans + legal(N_LABELS), first, last))
    w, trans, skip = train_skip(numbers, truth, r.lengths, w, trans, edges, CLASSES, 3)
    return Recogniser(keys, shapes, own, around, w, trans + legal(N_LABELS), skip)


def find_pii(docs: DataFrame, key: str, text: str, model: Recogniser) -> DataFrame:
    """``key, kind, start_char, end_char`` of every piece, in code points from 0, the end being exclusive.

    Pieces do not overlap. Null and empty texts have none; texts are read
    whole, of any length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                found = m.find([t or "" for t in part.column(1).to_pylist()])
                n = [len(x) for x in found]
                flat = [y for x in found for y in x]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))),
                        pa.array([y[2] for y in flat], pa.string()),
                        pa.array([y[0] for y in flat], pa.int64()),
                        pa.array([y[1] for y in flat], pa.int64()),
                    ],
                    ["k", "kind", "start_char", "end_char"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(work, f"k {kind}, kind string, start_char long, end_char long").withColumnRenamed("k", key)


def placeholder(kind: str) -> str:
    return f"[{kind.upper()}]"


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in sorted(found):
        out += [text[at:a], placeholder(kind)]
        at = b
    return "".join(out) + text[at:]


def redact_pii(docs: DataFrame, key: str, text: str, model: Recogniser) -> DataFrame:
    """``key, text`` with every piece replaced by a placeholder of its kind and nothing else changed. Null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                texts = part.column(1).to_pylist()
                found = m.find([t or "" for t in texts])
                done = [None if t is None else redact(t, x) for t, x in zip(texts, found)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(done, pa.string())], ["k", "t"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(work, f"k {kind}, t string").toDF(key, "text")


__all__ = ["Recogniser", "find_pii", "fit", "redact", "redact_pii"]
