"""A small C++ reader: tokens with places, then declarations by brace matching.

It knows what the chunker and the graph need (namespaces, classes, templates, aliases, concepts, functions, bases, members, calls) and skips the rest. It never
fails: what it can't read is stepped over up to the next semicolon or closing brace.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"//[^\n]*|/\*.*?(?:\*/|\Z)|(?P<pp>^[ \t]*\#(?:[^\n\\]|\\.|\\\n)*)|(?P<str>(?:u8|[uUL])?R\"(?P<d>[^(\s\\]{0,16})\(.*?\)(?P=d)\"|(?:u8|[uUL])?\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)+')"
    r"|(?P<id>[A-Za-z_]\w*)|(?P<num>\d[\w.']*)|(?P<op>::|->|\S)",
    re.S | re.M,
)
#: Words that are never the name of a call or of a type
_NOT_CALLS = frozenset("if for while switch return sizeof catch alignof decltype static_assert new delete throw noexcept defined typeid co_return co_await assert".split())
_NOT_TYPES = frozenset(
    "const volatile static inline constexpr consteval constinit virtual explicit friend mutable extern typename class struct enum union unsigned signed long short int char bool float double void auto "
    "register thread_local operator using public private protected final override noexcept return".split()
)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


@dataclass
class Token:
    text: str
    start: int
    end: int
    kind: str


@dataclass
class Unit:
    kind: str
    name: str
    start: int
    end: int
    line_start: int = 0
    line_end: int = 0
    template_start: int = -1
    has_body: bool = True
    children: list[Unit] = field(default_factory=list)
    bases: list[tuple[str, int]] = field(default_factory=list)  # name, line
    members: list[tuple[str, int]] = field(default_factory=list)
    parameters: list[tuple[str, int]] = field(default_factory=list)
    calls: list[tuple[str, int]] = field(default_factory=list)

    def walk(self):
        yield self
        for c in self.children:
            yield from c.walk()


def tokens_of(source: str) -> list[Token]:
    out = []
    for m in _TOKEN.finditer(source):
        if m.lastgroup in ("id", "num", "op", "str", "d"):
            kind = "str" if m.lastgroup in ("str", "d") else m.lastgroup
            out.append(Token(m[0], m.start(), m.end(), kind))
    return out


class Reader:
    def __init__(self, source: str) -> None:
        self.source = source
        self.t = tokens_of(source)
        self.breaks = [m.start() for m in re.finditer("\n", source)]
        self.match = self._matches()

    def line(self, at: int) -> int:
        return bisect_right(self.breaks, at - 1) + 1 if at else 1

    def _matches(self) -> dict[int, int]:
        """Token index of each opening bracket to that of its closing one; unclosed ones run to the end."""
        out, stack = {}, []
        for i, t in enumerate(self.t):
            if t.text in _OPEN and t.kind == "op":
                stack.append(i)
            elif t.text in _CLOSE and t.kind == "op":
                while stack and _OPEN[self.t[stack[-1]].text] != t.text:
                    out[stack.pop()] = i
                if stack:
                    out[stack.pop()] = i
        for i in stack:
            out[i] = len(self.t) - 1
        return out

    def text(self, i: int) -> str:
        return self.t[i].text if i < len(self.t) else ""

    def units(self) -> list[Unit]:
        return self._scope(0, len(self.t), None)

    def _angle(self, i: int) -> int:
        """Index after the ``<...>`` that starts at i."""
        depth = 0
        while i < len(self.t):
            x = self.t[i].text
            if x == "<":
                depth += 1
            elif x == ">":
                depth -= 1
                if depth == 0:
                    return i + 1
            elif x in ("(", "["):
                i = self.match.get(i, i)
            elif x in (";", "{"):
                return i
            i += 1
        return i

    def _skip(self, i: int, end: int) -> int:
        """After the next semicolon or brace block of this level."""
        while i < end:
            x = self.t[i].text
            if x == ";":
                return i + 1
            if x == "{":
                i = self.match[i] + 1
                return i + 1 if self.text(i) == ";" else i
            i = self.match[i] + 1 if x in _OPEN and self.t[i].kind == "op" else i + 1
        return end

    def _make(self, kind: str, name: str, first: int, last: int, template: int) -> Unit:
        last = min(last, len(self.t) - 1)
        u = Unit(kind, name, self.t[first].start, self.t[last].end, template_start=self.t[template].start if template >= 0 else -1)
        u.line_start, u.line_end = self.line(u.start), self.line(u.end - 1)
        return u

    def _scope(self, i: int, end: int, owner: Unit | None) -> list[Unit]:
        out: list[Unit] = []
        template = -1
        while i < end:
            x = self.t[i].text
            first = i
            if x in (";", "}"):
                i, template = i + 1, -1
                continue
            if x in ("public", "private", "protected") and self.text(i + 1) == ":":
                i += 2
                continue
            if x == "template" and self.text(i + 1) == "<":
                template = i if template < 0 else template
                i = self._angle(i + 1)
                if self.text(i) == "requires":
                    while i < end and self.t[i].text not in ("class", "struct", "concept", "using", "{", ";") and not (self.t[i].kind == "id" and self.text(i + 1) not in ("<", "(", "::", "&", "|") and i > first + 3):
                        i = self.match[i] + 1 if self.t[i].text == "(" else i + 1
                continue
            if x == "inline" and self.text(i + 1) == "namespace":
                i += 1
                x = "namespace"
            if x == "namespace":
                j, name = i + 1, []
                while j < end and self.t[j].text not in ("{", ";", "="):
                    name.append(self.t[j].text)
                    j += 1
                if self.text(j) == "{":
                    close = self.match[j]
                    u = self._make("namespace", "".join(name), first, close, template)
                    u.children = self._scope(j + 1, min(close, end), owner)
                    out.append(u)
                    i = close + 1
                else:
                    i = self._skip(j, end)
                template = -1
                continue
            if x == "using" and self.text(i + 2) == "=":
                close = self._skip(i, end)
                out.append(self._make("type_alias", self.text(i + 1), first, close - 1, template))
                i, template = close, -1
                continue
            if x == "concept":
                close = self._skip(i, end)
                out.append(self._make("concept", self.text(i + 1), first, close - 1, template))
                i, template = close, -1
                continue
            if x == "extern" and i + 1 < end and self.t[i + 1].kind == "str" and self.text(i + 2) == "{":
                out += self._scope(i + 3, min(self.match[i + 2], end), owner)
                i, template = self.match[i + 2] + 1, -1
                continue
            if x in ("class", "struct"):
                u, i2 = self._record(i, end, template)
                if u is not None:
                    out.append(u)
                    i, template = i2, -1
                    continue
            u, i2 = self._declaration(first, end, template, owner)
            if u is not None:
                out.append(u)
            i, template = max(i2, first + 1), -1
        return out

    def _record(self, i: int, end: int, template: int) -> tuple[Unit | None, int]:
        kind, j, name = self.t[i].text, i + 1, ""
        while j < end and (self.t[j].kind == "id" or self.t[j].text in ("::", "[")):
            if self.t[j].text == "[":
                j = self.match[j] + 1
                continue
            if self.t[j].text != "final" and self.t[j].kind == "id":
                name = self.t[j].text
            if self.text(j + 1) == "(":
                j = self.match[j + 1]
            j += 1
        if self.text(j) == "<":
            j = self._angle(j)
        bases: list[tuple[str, int]] = []
        if self.text(j) == ":":
            j += 1
            while j < end and self.t[j].text not in ("{", ";"):
                if self.t[j].kind == "id" and self.t[j].text not in ("public", "private", "protected", "virtual"):
                    start, full = j, self.t[j].text
                    while self.text(j + 1) == "::":
                        full += "::" + self.text(j + 2)
                        j += 2
                    bases.append((full, self.line(self.t[start].start)))
                    if self.text(j + 1) == "<":
                        j = self._angle(j + 1) - 1
                j += 1
        if self.text(j) == "{":
            close = self.match[j]
            u = self._make(kind, name, i, close, template)
            u.bases = bases
            u.children = self._scope(j + 1, min(close, end), u)
            i2 = close + 1
            while i2 < end and self.t[i2].text not in (";",) and self.t[i2].kind == "id":
                i2 += 1
            return u, i2
        if self.text(j) == ";":
            u = self._make(kind, name, i, max(i, j - 1), template)
            u.has_body = False
            return u, j + 1
        return None, i

    def _declaration(self, i: int, end: int, template: int, owner: Unit | None) -> tuple[Unit | None, int]:
        """A function with a body, or a declaration that is stepped over; members of a class leave their types."""
        first, j, paren, equals = i, i, -1, False
        while j < end:
            x = self.t[j].text
            if x == "operator" and paren < 0:
                while j + 1 < end and self.text(j + 1) != "(":
                    j += 1
                if self.text(j + 1) == "(" and self.text(j + 2) == ")" and self.text(j + 3) == "(":
                    j += 2
                j += 1
                continue
            if x == "(":
                if paren < 0 and not equals and j > first and (self.t[j - 1].kind == "id" or self.t[j - 1].kind == "op" and self.text(j - 1) not in ("=", ",")):
                    paren = j
                j = self.match[j] + 1
                continue
            if x == "=":
                equals = True
            if x == "<" and j > first and self.t[j - 1].kind == "id" and paren < 0 and not equals:
                k = self._angle(j)
                if k > j + 1:
                    j = k
                    continue
            if x == "[":
                j = self.match[j] + 1
                continue
            if x == ":" and paren >= 0:  # initializers of a constructor
                j += 1
                while j < end and self.t[j].text not in (";",):
                    if self.t[j].text == "(" or self.t[j].text == "{" and self.t[j - 1].kind == "id" and self.text(self.match[j] + 1) in (",", "{"):
                        j = self.match[j] + 1
                        continue
                    if self.t[j].text == "{":
                        break
                    j += 1
                continue
            if x == ";":
                if owner is not None and paren < 0:
                    owner.members += self._types(first, j, members=True)
                return None, j + 1
            if x == "{":
                close = self.match[j]
                if paren >= 0 and not equals:
                    name = self._function_name(first, paren)
                    u = self._make("function", name, first, close, template)
                    u.parameters = self._types(paren + 1, self.match[paren])
                    u.calls = self._calls(j + 1, close)
                    return u, close + 1
                j = close + 1
                if self.text(j) not in (";", ",", "=", "{") and not (j < end and self.t[j].kind == "id" and equals):
                    if self.text(j) == ";" or paren < 0 and self.text(first) not in ("enum", "union", "typedef"):
                        return None, j
                continue
            if x == "}":
                return None, j + 1
            j += 1
        return None, end

    def _function_name(self, first: int, paren: int) -> str:
        k = paren - 1
        if self.text(k) == ">":  # a specialization
            depth = 0
            while k > first:
                depth += {">": 1, "<": -1}.get(self.text(k), 0)
                k -= 1
                if depth == 0:
                    break
        for o in range(max(first, k - 4), k + 1):
            if self.text(o) == "operator":
                return self._qualified(o, first) + "".join(self.text(m) for m in range(o + 1, paren))
        return self._qualified(k, first)

    def _qualified(self, k: int, first: int) -> str:
        name = self.text(k)
        if k > first and self.text(k - 1) == "~":
            name, k = "~" + name, k - 1
        while k - 1 > first and self.text(k - 1) == "::" and self.t[k - 2].kind == "id":
            name = self.text(k - 2) + "::" + name
            k -= 2
        return name

    def _types(self, a: int, e: int, members: bool = False) -> list[tuple[str, int]]:
        """Type names of a parameter list or of a member declaration: names that another name, a sign or a template list follows."""
        out, j = [], a
        while j < e:
            t = self.t[j]
            if t.kind == "id" and t.text not in _NOT_TYPES:
                name, k = t.text, j
                while self.text(k + 1) == "::" and k + 2 < e and self.t[k + 2].kind == "id":
                    name += "::" + self.text(k + 2)
                    k += 2
                after = self.text(k + 1) if k + 1 < e else ""
                follows = k + 1 < e and (self.t[k + 1].kind == "id" and after not in ("final", "override") or after in ("&", "*", "<", "const"))
                if follows or not members and (after in (",", "") and (j == a or self.text(j - 1) in (",", "const", "("))):
                    out.append((name, self.line(t.start)))
                if members and follows and after != "<":
                    break
                j = k + 1
                continue
            if t.text == "=":
                while j < e and self.t[j].text != ",":
                    j = self.match[j] + 1 if self.t[j].text in _OPEN and self.t[j].kind == "op" else j + 1
                continue
            j += 1
        return out

    def _calls(self, a: int, e: int) -> list[tuple[str, int]]:
        out, seen = [], set()
        for j in range(a, e):
            t = self.t[j]
            if t.kind == "id" and self.text(j + 1) == "(" and t.text not in _NOT_CALLS:
                name = self._qualified(j, a - 1) if self.text(j - 1) == "::" else t.text
                before = self.t[j - 1] if j > a else None
                if before is not None and before.kind == "id" and before.text not in ("return", "else", "do", "throw", "co_return", "co_await"):
                    continue  # a declaration with constructor arguments
                if name not in seen:
                    seen.add(name)
                    out.append((name, self.line(t.start)))
        return out
