"""Units of Verilog and SystemVerilog sources, from a scan of their tokens."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

#: Words that open a unit, and those that open a block
UNIT_WORDS = ("module", "interface", "program")
BLOCK_WORDS = ("always", "initial", "always_comb", "always_ff", "always_latch")
OPEN_LINES = 50  # of a block without an end

_TOKEN = re.compile(r"\w+|[^\w\s]")


class Tokens:
    """Words and signs of a source with their places."""

    def __init__(self, source: str) -> None:
        found = list(_TOKEN.finditer(source))
        self.source = source
        self.text = [m[0] for m in found]
        self.start, self.end = [m.start() for m in found], [m.end() for m in found]
        self.breaks = [k for k, c in enumerate(source) if c == "\n"]
        self.at: dict[str, list[int]] = {}
        for k, t in enumerate(self.text):
            self.at.setdefault(t, []).append(k)

    def __getitem__(self, k: int) -> str:
        return self.text[k] if k < len(self.text) else ""

    def line(self, offset: int) -> int:
        return bisect_left(self.breaks, offset) + 1

    def every(self, words: tuple[str, ...]) -> list[int]:
        return sorted(k for w in words for k in self.at.get(w, ()))

    def following(self, word: str, k: int) -> int | None:
        """The first token after k that is the word."""
        places = self.at.get(word, [])
        n = bisect_right(places, k)
        return places[n] if n < len(places) else None

    def close_of(self, k: int, name: str) -> int:
        """Where a unit ends that token k closes: after its label, else at the next word, else after the token."""
        if (self[k + 1], self[k + 2]) == (":", name):
            return self.end[k + 2]
        return self.start[k + 1] if re.match(r"\w", self[k + 1]) else self.end[k]


def hardware_units(source: str) -> list[tuple[str, str, str, int, int, int]]:
    """(type, name, text, first line, last line, index) of the modules of a source, or if there are none of its blocks; nothing if there are neither."""
    t = Tokens(source)
    out = []
    for k in t.every(UNIT_WORDS):
        name = t[k + 1]
        if not re.match(r"\w", name) or t[k + 2] != "(":
            continue
        close = t.following("endmodule", k)
        stop = len(source) if close is None else t.close_of(close, name)
        out.append(("module", name, source[t.start[k] : stop], t.line(t.start[k]), t.line(stop), 0))
    if out:
        return out
    for n, k in enumerate(t.every(BLOCK_WORDS)):
        close = t.following("end", k)
        first = t.line(t.start[k])
        text = source[t.start[k] : t.end[close]] if close is not None else "\n".join(source[t.start[k] :].split("\n", OPEN_LINES)[:OPEN_LINES])
        out.append((t[k], f"{t[k]}_{n + 1}", text, first, first + text.count("\n"), n))
    return out
