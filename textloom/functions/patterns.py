"""Character classes and token patterns shared by tokenizers and validators."""

from __future__ import annotations

# The code points of Unicode White_Space, as inclusive ranges.
SPACE_RANGES = (
    (0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
)


def _inside(form: str) -> str:
    return "".join(form.format(a) + ("" if a == b else "-" + form.format(b)) for a, b in SPACE_RANGES)


#: White space as the inside of a character class, for Java and RE2 ...
WHITE_SPACE = _inside(r"\x{{{0:x}}}")
#: ... and for Python.
WHITE_SPACE_PY = _inside(r"\u{0:04x}")

# Signs that a URL gives back at its end.
URL_TAIL = r".,;:!?)\]}"
URL_HEAD = r"https?://|www\."
WORD_HEAD = r"\p{L}\p{Nd}"
WORD_TAIL = r"\p{L}\p{Nd}._+@\-"


def standard(space: str = WHITE_SPACE, groups: bool = False) -> str:
    """URL, else a run of word characters, else any single visible character."""
    parts = (rf"(?=(?i:{URL_HEAD}))[^{space}]*[^{space}{URL_TAIL}]", rf"[{WORD_HEAD}][{WORD_TAIL}]*", rf"[^{space}]")
    return "(?s)" + "|".join(f"({p})" if groups else p for p in parts)


def whitespace(space: str = WHITE_SPACE) -> str:
    return f"[^{space}]+"


def simple() -> str:
    return f"[{WORD_HEAD}]+"
