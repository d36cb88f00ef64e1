"""Word segmentation with four states: begin, middle, end, single."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

BEGIN, MIDDLE, END, SINGLE = range(4)
_NO = -math.inf

# Log probabilities of the default model, in the order of the states.
START = (-0.5, _NO, _NO, -0.8)
UNKNOWN = (-0.6, -0.8, -0.6, -0.9)
STEP = -0.7
LEGAL = ((BEGIN, MIDDLE), (BEGIN, END), (MIDDLE, MIDDLE), (MIDDLE, END), (END, BEGIN), (END, SINGLE), (SINGLE, BEGIN), (SINGLE, SINGLE))


def _default_transitions() -> tuple[tuple[float, ...], ...]:
    return tuple(tuple(STEP if (a, b) in LEGAL else _NO for b in range(4)) for a in range(4))


@dataclass(frozen=True)
class HmmModel:
    """Log probabilities; ``emission`` maps a character to its four values, others take ``unknown``."""

    start: tuple[float, ...] = START
    transition: tuple[tuple[float, ...], ...] = field(default_factory=_default_transitions)
    emission: dict[str, tuple[float, ...]] = field(default_factory=dict)
    unknown: tuple[float, ...] = UNKNOWN

    def states(self, text: str) -> list[int]:
        """The best path that ends a word. Of equal paths the lower-numbered earlier state wins; a word end wins over a single sign."""
        if not text:
            return []
        emit = [self.emission.get(ch, self.unknown) for ch in text]
        best = [s + e for s, e in zip(self.start, emit[0])]
        trail: list[tuple[int, ...]] = []
        for e in emit[1:]:
            # max keeps the first of equals; where nothing is possible that is BEGIN
            came = tuple(max(range(4), key=lambda p, s=s: best[p] + self.transition[p][s]) for s in range(4))
            best = [best[p] + self.transition[p][s] + e[s] for s, p in enumerate(came)]
            trail.append(came)
        path = [SINGLE if best[SINGLE] > best[END] else END]
        for came in reversed(trail):
            path.append(came[path[-1]])
        return path[::-1]

    def segment(self, text: str) -> list[str]:
        """Words of ``text``; together they are the whole text."""
        words, at = [], 0
        for i, s in enumerate(self.states(text), 1):
            if s in (END, SINGLE):
                words.append(text[at:i])
                at = i
        return words + ([text[at:]] if at < len(text) else [])
