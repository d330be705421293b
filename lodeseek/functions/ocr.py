"""Corrections of optically confused characters: a beam search under rule constraints."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

# --- fixed values ---
CONFUSED = {"0": "O", "O": "0", "1": "lI", "l": "1I", "I": "1l"}
TOKEN = re.compile(r"[A-Za-z0-9_\-]{8,512}")
# --- end of fixed values ---


@dataclass(frozen=True)
class Constraint:
    rule_id: str
    prefixes: tuple[str, ...]
    min_length: int
    max_length: int
    charset: str | None = None

    def open_to(self, start: str) -> bool:
        """Whether a value that begins with ``start`` can still fit."""
        return len(start) <= self.max_length and (not self.prefixes or any(p.startswith(start) or start.startswith(p) for p in self.prefixes))

    def fits(self, value: str) -> bool:
        return self.open_to(value) and len(value) >= self.min_length and (self.charset is None or re.fullmatch(self.charset, value) is not None)


def constraints(rules: Iterable) -> list[Constraint]:
    return [Constraint(r.id, tuple(r.prefixes), r.min_length, r.max_length, r.charset) for r in rules]


def beam(token: str, limits: list[Constraint], width: int = 64) -> list[tuple[str, int, str]]:
    """(value, edits, rule) of the least edited values that fit a rule, at most ``width`` kept a step; the token itself is left out."""
    kept = {"": 0}
    # beyond the prefixes what is open stays open until a rule's greatest length is passed
    deep, ends = max((len(p) for x in limits for p in x.prefixes), default=0), {x.max_length + 1 for x in limits}
    for n, c in enumerate(token, 1):
        check = bool(limits) and (n <= deep or n in ends)
        if not check and c not in CONFUSED:
            kept = {v + c: cost for v, cost in kept.items()}
            continue
        grown: dict[str, int] = {}
        for start, cost in kept.items():
            for k, option in enumerate(c + CONFUSED.get(c, "")):
                v = start + option
                if not check or any(x.open_to(v) for x in limits):
                    grown[v] = min(grown.get(v, cost + 1), cost + (k > 0))
        kept = dict(sorted(grown.items(), key=lambda x: (x[1], x[0]))[:width])
    named = ((v, cost, next((x.rule_id for x in limits if x.fits(v)), None)) for v, cost in kept.items())
    return [(v, cost, rule) for v, cost, rule in named if rule is not None and v != token]


def variants(text: str, limits: list[Constraint], width: int = 32) -> list[tuple[str, int, str]]:
    """(text with one token corrected, edits, rule), at most ``width`` of them."""
    out: list[tuple[str, int, str]] = []
    for m in TOKEN.finditer(text):
        for v, cost, rule in beam(m[0], limits, width):
            out.append((text[: m.start()] + v + text[m.end() :], cost, rule))
            if len(out) == width:
                return out
    return out
