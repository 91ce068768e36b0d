"""Line ranges that a language model proposes for the units of a file, moved to where declarations and units really begin and end."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, chain

#: What a line that declares each kind looks like, a line that declares anything, a template's head, an explicit instantiation
DECLARES = {
    "class": r"^\s*class\s+",
    "class_template": r"^\s*(?:template\s*<[^>]*>\s*)?class\s+",
    "struct": r"^\s*struct\s+",
    "struct_template": r"^\s*(?:template\s*<[^>]*>\s*)?struct\s+",
    "function": r"^\s*(?:[\w:<>,\s&*]+)\s+[A-Za-z_]\w*\s*\(",
    "function_template": r"^\s*(?:template\s*<[^>]*>\s*)?(?:[\w:<>,\s&*]+)\s+[A-Za-z_]\w*\s*\(",
    "concept": r"^\s*(?:template\s*<[^>]*>\s*)?concept\s+",
    "type_alias": r"^\s*using\s+",
    "namespace": r"^\s*namespace\s+",
}
DECLARES_ANY = r"^\s*(?:template\s*<[^>]*>\s*)?(?:class|struct|using|concept|namespace|(?:[\w:<>,\s&*]+)\s+[A-Za-z_]\w*\s*\()"
TEMPLATE_HEAD = r"^\s*template\s*<"
INSTANTIATION = r"^\s*template\s+class\s+\w+<[^;>]*>\s*;\s*$"
COMMENT = ("//", "/*", "*")
LINES_BEFORE, LINES_AFTER, LINES_AHEAD, LINES_TO_END = 2, 5, 9, 4  # how far a declaration and a unit's end are looked for
TEMPLATED = ("class", "function", "struct")

_KINDS = {k: re.compile(p) for k, p in DECLARES.items()}
_ANY, _HEAD, _MADE = re.compile(DECLARES_ANY), re.compile(TEMPLATE_HEAD), re.compile(INSTANTIATION, re.M)


def tolerant_json(raw: str | None) -> object:
    """The first JSON value that an answer holds: the whole answer, what a code fence opens with, or an object that starts at one of its braces. None if none reads."""
    if raw is None:
        return None
    text = raw.strip()
    try:
        return json.loads(text)
    except ValueError:
        fence = re.match(r"```\w*\s*", text)
    for at in chain([fence.end()] if fence else [], (m.start() for m in re.finditer(r"\{", text))):
        try:
            return json.JSONDecoder().raw_decode(text, at)[0]
        except ValueError:
            continue
    return None


@dataclass
class Range:
    """Lines first to last (from 1) of a unit of a kind and name; either may be empty."""

    first: int
    last: int
    kind: str
    name: str

    def holds(self, other: Range) -> bool:
        return other is not self and self.first < other.first and other.last < self.last

    def take_in(self, other: Range) -> None:
        """An overlapping range that ends later gives its end, and its kind and name where it has them."""
        if other.last > self.last:
            self.last, self.kind, self.name = other.last, other.kind or self.kind, other.name or self.name


class Lines:
    """What the lines of a file declare, and how deep in braces each of them stands."""

    def __init__(self, lines: list[str]) -> None:
        self.lines = lines
        self.depth = list(accumulate((x.count("{") - x.count("}") for x in lines), initial=0))  # before each line

    def _between(self, first: int, last: int) -> range:
        return range(max(1, first), min(len(self.lines), last) + 1)

    def declaration(self, line: int, kind: str) -> int:
        """The line near this one that declares the kind, else the next that declares anything, else the line itself."""
        named = (n for n in self._between(line - LINES_BEFORE, line + LINES_AFTER) if kind in _KINDS and _KINDS[kind].match(self.lines[n - 1]))
        other = (n for n in self._between(line, line + LINES_AHEAD) if not self.lines[n - 1].lstrip().startswith(COMMENT) and _ANY.match(self.lines[n - 1]))
        return next(chain(named, other), line)

    def end(self, first: int, last: int) -> int:
        """The last line if a brace ends it, else the first one that closes what opened since ``first``, else the last line."""
        if self.lines[last - 1].strip().endswith(("}", "};")):
            return last
        closing = (n for n in self._between(first, last + LINES_TO_END) if self.depth[n] == self.depth[first - 1] and re.search("[;}]", self.lines[n - 1]))
        return next(closing, last)

    def is_template(self, line: int) -> bool:
        return any(_HEAD.match(self.lines[n - 1]) for n in self._between(line - 4, line))

    def placed(self, first: int, last: int, kind: str, name: str) -> Range | None:
        """The proposed range where its unit really is; None outside the file and for instantiations."""
        if not 1 <= first <= min(last, len(self.lines)):
            return None
        start = self.declaration(first, kind)
        stop = self.end(start, max(start, min(last, len(self.lines))))
        if _MADE.search("\n".join(self.lines[start - 1 : stop]).strip()):
            return None
        return Range(start, stop, f"{kind}_template" if kind in TEMPLATED and self.is_template(start) else kind, name)


def _numbers(items: list) -> Iterator[tuple[int, int, str, str]]:
    for x in items:
        try:
            yield int(x.get("start_line", 0)), int(x.get("end_line", 0)), str(x.get("chunk_type") or ""), str(x.get("name") or "")
        except (AttributeError, TypeError, ValueError):
            continue


def proposed_ranges(items: list, lines: list[str], limit: int = 40) -> list[Range]:
    """Ranges that a model proposed, in order and apart: placed in the file, namespaces that hold others left out, overlapping ones made one."""
    file = Lines(lines)
    found = [r for x in _numbers(items) if (r := file.placed(*x))]
    found = [r for r in found if r.kind != "namespace" or not any(map(r.holds, found))]
    out: list[Range] = []
    for r in sorted(found, key=lambda r: (r.first, -r.last)):
        if out and r.first <= out[-1].last:
            out[-1].take_in(r)
        else:
            out.append(r)
    return out[:limit]
