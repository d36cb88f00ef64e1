"""One form for text that looks the same.

A table of sources and targets is derived from Unicode properties and a plain
list of look-alike letters, checked for conflicts, and compiled into one
longest-match pattern over grapheme clusters; a text is rewritten in one pass.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Look-alike letters: each Latin letter is followed by letters of other scripts
# that common typefaces draw alike.
LOOK_ALIKE = """
a а ɑ   c с ϲ ⅽ   d ԁ ⅾ   e е   g ɡ   h һ   i і ⅰ   j ј ϳ   l ⅼ ӏ   m ⅿ   n ո   o о ο օ
p р ρ   q ԛ   s ѕ   u ս   v ν ѵ ⅴ   w ԝ   x х ⅹ   y у ү   æ ӕ   ə ә
A А Α   B В Β   C С Ϲ Ⅽ   D Ⅾ   E Е Ε   G Ԍ   H Н Η   I І Ι Ⅰ Ӏ   J Ј Ϳ   K К Κ   L Ⅼ   M М Μ Ⅿ
N Ν   O О Ο Օ   P Р Ρ   Q Ԛ   S Ѕ Տ   T Т Τ   U Ս   V Ѵ Ⅴ   W Ԝ   X Х Χ Ⅹ   Y Ү Υ   Z Ζ   Æ Ӕ   Ə Ә
A Ꭺ ꓮ   B Ᏼ ꓐ   C Ꮯ ꓚ   D Ꭰ ꓓ   E Ꭼ ꓰ   F ꓝ   G Ꮐ ꓖ   H Ꮋ ꓧ   I ꓲ   J Ꭻ ꓙ   K Ꮶ ꓗ   L Ꮮ ꓡ   M Ꮇ ꓟ   N ꓠ   O ꓳ   P Ꮲ ꓑ
R Ꮢ ꓣ   S Ꮪ ꓢ   T Ꭲ ꓔ   U ꓴ   V Ꮩ ꓦ   W Ꮃ ꓪ   X ꓫ   Y ꓬ   Z Ꮓ ꓜ
"""

# Hyphens drawn like the ASCII one.
HYPHENS = "‐‑‒⁃˗﹣"

#: Compatibility kinds whose characters look like their plain sequence. Raised,
#: lowered and circled characters and fractions are not among them.
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")

#: Blocks of the <compat> kind that hold joined letters and radicals, not signs.
JOINED = ((0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0xFB00, 0xFB06), (0xFB13, 0xFB17), (0x2E80, 0x2FDF), (0x2160, 0x217F), (0x3131, 0x318E))

#: Characters without a mark of their own besides those of category Cf.
INVISIBLE = ((0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF))


class Conflict(ValueError):
    """Two rules disagree, or a target is itself a source."""


def _within(cp: int, ranges: Iterable[tuple[int, int]]) -> bool:
    return any(a <= cp <= b for a, b in ranges)


def _points() -> Iterable[int]:
    """All code points that may change: the whole basic plane, and beyond it what has a decomposition or is a mark, a blank or a format character."""
    yield from range(0x80, 0xD800)
    yield from range(0xE000, 0x10000)
    # the ideographs of the planes 2 and 3 have neither; their compatibility forms begin at 2F800
    for cp in chain(range(0x10000, 0x20000), range(0x2F800, 0x30000), range(0xE0000, 0xE1000)):
        ch = chr(cp)
        if unicodedata.decomposition(ch) or unicodedata.category(ch) in ("Cf", "Zs", "Mn", "Mc", "Me") or _within(cp, INVISIBLE):
            yield cp


_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def _inside(chars: Iterable[str]) -> str:
    """The inside of a character class, neighbours joined to ranges."""
    points, out = sorted(map(ord, chars)), []
    for p in points:
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(re.escape(chr(a)) + (f"-{re.escape(chr(b))}" if b > a else "") for a, b in out)


class Transducer:
    """The compiled mapping. ``apply`` is idempotent."""

    def __init__(self, look_alike: str = LOOK_ALIKE, hyphens: str = HYPHENS):
        self.table: dict[str, str] = {}
        self._memo: dict[str, str] = {}
        groups = [g.split() for g in re.split(r"\s{2,}|\n", look_alike.strip()) if g.strip()]
        for target, *sources in groups:
            for s in sources:
                self._add(s, target)
        for h in hyphens:
            self._add(h, "-")
        for c in "\t\x0b\x0c\x85":
            self._add(c, " ")
        listed = dict(self.table)
        for cp in _points():
            ch = chr(cp)
            if ch in listed:
                continue
            cat = unicodedata.category(ch)
            if cat == "Cf" or _within(cp, INVISIBLE):
                self._add(ch, "")
            elif cat == "Zs":
                self._add(ch, " ")
            else:
                kind = unicodedata.decomposition(ch).split(" ", 1)[0]
                if kind in SAME_LOOK or (kind == "<compat>" and _within(cp, JOINED)):
                    plain = unicodedata.normalize("NFKC", ch)
                    self._add(ch, "".join(listed.get(c, c) for c in plain))
        # half-width kana take their sound mark as a second character
        for cp in range(0xFF66, 0xFF9E):
            for sound in "ﾞﾟ":
                whole = unicodedata.normalize("NFKC", chr(cp) + sound)
                if len(whole) == 1:
                    self._add(chr(cp) + sound, whole)
        self._check()
        self._compile()

    def _add(self, source: str, target: str) -> None:
        if self.table.setdefault(source, target) != target:
            raise Conflict(f"{source!r} has two targets")

    def _check(self) -> None:
        for s, t in self.table.items():
            if t == s or any(c in self.table for c in t):
                raise Conflict(f"target of {s!r} is itself a source")

    def _compile(self) -> None:
        table = self.table
        changed, marks, hidden = [], [], []
        for cp in chain(range(0x80), _points()):
            ch = chr(cp)
            # what stands for a combining mark, such as the half-width sound marks, belongs to its cluster too
            mark = table.get(ch, ch)
            if mark and unicodedata.category(mark[0]) in ("Mn", "Mc", "Me"):
                marks.append(ch)
            elif table.get(ch) == "":
                hidden.append(ch)
            elif self._cluster(ch) != ch:
                changed.append(ch)
        # Classes of the basic plane compile to a bitmap; astral members would be tried one by one. So there are two
        # patterns, and the one with astral characters serves the texts that hold any.
        basic = lambda cs: [c for c in cs if ord(c) < 0x10000]
        self.pattern, self.trigger = self._patterns(basic(changed), basic(marks), basic(hidden))
        self.wide_pattern, self.wide_trigger = self._patterns(changed, marks, hidden)

    def _patterns(self, changed: list[str], marks: list[str], hidden: list[str]) -> tuple[re.Pattern, re.Pattern]:
        """The transducer's pattern, and the class of what a text must hold for anything to change in it."""
        c, m, h = _inside(changed), _inside(marks), _inside(hidden)
        # sequences with one second character form one class, so that a character is tried against few alternatives
        seconds: dict[str, list[str]] = {}
        for source in self.table:
            if len(source) == 2:
                seconds.setdefault(source[1], []).append(source[0])
        longer = "|".join(f"[{_inside(firsts)}]{re.escape(second)}" for second, firsts in seconds.items())
        tail = f"[{m}{h}]"
        jamo = "[ᄀ-ᅞ][ᅡ-ᆧ][ᆨ-ᇿ]?"
        # longest first: listed sequences, syllables of jamo, a changed base with its tail, any base with a tail, invisible characters before any base
        pattern = f"(?:{longer}){tail}*|{jamo}{tail}*|[{c}]{tail}*|(?s:.){tail}+|[{h}]+"
        return re.compile(pattern), re.compile(f"[{c}{m}{h}ᄀ-ᇿ]")

    def _cluster(self, cluster: str) -> str:
        """Rewrite one grapheme cluster."""
        table, out, i = self.table, [], 0
        while i < len(cluster):
            pair = cluster[i : i + 2]
            if len(pair) == 2 and pair in table:
                out.append(table[pair])
                i += 2
                continue
            ch = cluster[i]
            if ch in table:
                out.append(table[ch])
            else:
                out += [table.get(c, c) for c in unicodedata.normalize("NFD", ch)]
            i += 1
        return unicodedata.normalize("NFC", "".join(out))

    def _replace(self, m: re.Match) -> str:
        cluster = m.group()
        got = self._memo.get(cluster)
        if got is None:
            got = self._cluster(cluster)
            if len(self._memo) < 100_000:
                self._memo[cluster] = got
        return got

    def apply(self, text: str | None) -> str | None:
        """The common form; null stays null, an empty text stays empty, ASCII without tabs is unchanged."""
        if text is None:
            return None
        pattern, trigger = (self.wide_pattern, self.wide_trigger) if _ASTRAL.search(text) else (self.pattern, self.trigger)
        return text if trigger.search(text) is None else pattern.sub(self._replace, text)


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    return Transducer()


@lru_cache(maxsize=1)
def character_table() -> list[tuple[str, str]]:
    """Each single character that changes, with what it becomes alone: a plain table of the mapping, for checks of another make."""
    t = transducer()
    out = []
    for cp in chain(range(0x80), _points()):
        ch = chr(cp)
        new = t.table[ch] if ch in t.table else "".join(t.table.get(c, c) for c in unicodedata.normalize("NFD", ch))
        if unicodedata.normalize("NFC", new) != ch:
            out.append((ch, new))
    return out


def visual_form(text: Column) -> Column:
    """Column of texts in the one form. Nulls stay null; whole texts are rewritten, of any length."""

    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        apply = transducer().apply
        return s.map(lambda t: apply(t) if isinstance(t, str) else None)

    return form(text)


if __name__ == "__main__":
    t = transducer()
    sys.stdout.write(f"{len(t.table)} sources\n")
