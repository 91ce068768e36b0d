"""License scans by patience alignment of a text with license templates.

Words unique to both sides anchor the alignment, the longest increasing run of anchors is kept, and every gap between anchors is aligned the
same way until it holds none; equal words at a gap's ends match too. Coverage is the share of a template's words that are aligned. A text may hold a
template anywhere and more than once: the alignment runs on stretches around the occurrences of so many of the template's rarest words that a covered copy must hold one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import batch_of, map_arrow, slices, stage_table, text_bytes
from corpusgraph.llm.decontam import words_of

LEAST_COVERAGE = 0.8
MOST_BYTES = 16 << 20  # of templates that travel with a task

#: Public license notices and texts
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of '
        "the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing '
        "permissions and limitations under the License."
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should "
        "have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and "
        'this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
        "THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
        'notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, '
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
}


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence."""
    tops: list[int] = []
    last: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before[i] = last[k - 1] if k else -1
        if k == len(tops):
            tops.append(v)
            last.append(i)
        else:
            tops[k], last[k] = v, i
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Aligned places of equal words in a and b, increasing on both sides."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {w: j for j, w in enumerate(b[b0:b1], b0) if nb[w] == 1 and na.get(w) == 1}
        anchors = [(i, at[w]) for i, w in enumerate(a[a0:a1], a0) if w in at]
        kept = [anchors[k] for k in increasing([j for _, j in anchors])]
        if not kept:
            continue
        out += kept
        edges = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False) if i + 1 < k and j + 1 < m]
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str) -> None:
        self.name, self.words = name, words_of(text.encode())
        self.counts = Counter(self.words)
        self.longest = len(self.words) + len(self.words) // 4 + 1  # words of a window that is tried in any case

    def reachable(self, here: dict[bytes, list[int]]) -> float:
        """Coverage that a text with these words can have at most."""
        return sum(min(n, len(here[w])) for w, n in self.counts.items() if w in here) / len(self.words)

    def best(self, text: list[bytes], here: dict[bytes, list[int]], least: float = LEAST_COVERAGE) -> tuple[int, int, int]:
        """(aligned words, first place, end) of the best stretch; the earliest of equals.

        Anchors are the words rarest in the text that together are more than a copy covered to ``least`` can lack. Around their occurrences wide stretches are aligned, and
        stretches of one template length and somewhat more, in which the words of a neighbouring copy don't hide what is unique. Where none of these is covered to
        ``least``, every window that could be is aligned.
        """
        size = len(self.words)
        spare, anchors = size - least * size + 1e-9, []
        for w in sorted(self.counts, key=lambda w: (len(here.get(w, ())), w)):
            anchors.append(w)
            spare -= self.counts[w]
            if spare < 0:
                break
        wanted = sorted(p for w in self.counts for p in here.get(w, ()))
        reach = size + size // 2 + 4
        spans: set[tuple[int, int]] = set()
        for w in anchors:
            last = None
            for p in here.get(w, ()):
                if last is None or p >= (last[0] + last[1]) // 2 + reach // 2:
                    last = max(0, p - reach), min(len(text), p + reach + 1)
                    spans.add(last)
                for o in (k for k, x in enumerate(self.words) if x == w):
                    for more in (0, max(1, size // 4)):
                        spans.add((max(0, p - o - more), min(len(text), p - o + size + more)))
        best = (0, 0, 0)
        for a, e in sorted(spans):
            if best[0] == size and a > best[1]:
                break
            if bisect_left(wanted, e) - bisect_left(wanted, a) < least * size - 1e-9:
                continue
            best = self._better(best, text, a, e)
        if best[0] < least * size - 1e-9:
            for a, e in self._around(anchors, here, len(text)):
                best = self._every_window(best, text, wanted[bisect_left(wanted, a) : bisect_left(wanted, e)], least)
        return best

    def _better(self, best: tuple[int, int, int], text: list[bytes], a: int, e: int) -> tuple[int, int, int]:
        found = align(text[a:e], self.words)
        if found and (len(found), -a - found[0][0]) > (best[0], -best[1]):
            return len(found), a + found[0][0], a + found[-1][0] + 1
        return best

    def _around(self, anchors: list[bytes], here: dict[bytes, list[int]], end: int) -> list[tuple[int, int]]:
        """Stretches that hold every window of at most ``longest`` words with an anchor in it; those that meet are one."""
        out: list[tuple[int, int]] = []
        for p in sorted(p for w in anchors for p in here.get(w, ())):
            a, e = max(0, p - self.longest + 1), min(end, p + self.longest)
            if out and a <= out[-1][1]:
                out[-1] = out[-1][0], e
            else:
                out.append((a, e))
        return out

    def _every_window(self, best: tuple[int, int, int], text: list[bytes], spots: list[int], least: float) -> tuple[int, int, int]:
        """Windows from one of the template's words to another, at most ``longest`` words apart, as soon as their words could cover the template to ``least``.

        A sliding count leaves out the starts from which no window can, nearly all of them in texts that hold no copy.
        """
        need = least * len(self.words) - 1e-9
        have: Counter[bytes] = Counter()
        n = right = 0
        for left, s in enumerate(spots):
            while right < len(spots) and spots[right] - s < self.longest:
                w = text[spots[right]]
                have[w] += 1
                n += have[w] <= self.counts[w]
                right += 1
            if n >= need:
                seen: Counter[bytes] = Counter()
                k = 0
                for p in spots[left:right]:
                    seen[text[p]] += 1
                    if seen[text[p]] <= self.counts[text[p]]:
                        k += 1
                        if k >= need and k > best[0]:
                            best = self._better(best, text, s, p + 1)
            w = text[s]
            n -= have[w] <= self.counts[w]
            have[w] -= 1
        return best


def scan_text(text: bytes, templates: list[Template], least: float = LEAST_COVERAGE) -> tuple[int, list[tuple[str, float, int, int, int]]]:
    """Number of words, and (name, coverage, aligned words, first word, end) of every template covered to ``least``, most aligned words first."""
    words = words_of(text)
    wanted = set().union(*(t.counts for t in templates)) if templates else set()
    here: dict[bytes, list[int]] = {}
    if not wanted.isdisjoint(words):
        for k, w in enumerate(words):
            if w in wanted:
                here.setdefault(w, []).append(k)
    out = []
    for t in templates:
        if here and t.words and t.reachable(here) >= least:
            n, a, e = t.best(words, here, least)
            if n >= least * len(t.words):
                out.append((t.name, n / len(t.words), n, a, e))
    return len(words), sorted(out, key=lambda x: (-x[2], -x[1], x[0]))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST_COVERAGE, most: int = MOST_BYTES) -> DataFrame:
    """One row per document row: doc_id, n_words, license, coverage, n_matched, first_word, end_word, licenses (all names found).

    license is the template with most aligned words (then the higher coverage, then the name), null if none is covered. Null text has no words.
    doc_id may be null or repeated. Very long texts are scanned whole. Other columns are not read. Empty: no rows. Templates travel with the tasks; lists above MOST_BYTES
    are scanned in parts, and the parts' answers joined row by row.
    """
    parts: list[dict[str, str]] = [{}]
    for name in sorted(templates):
        if parts[-1] and sum(map(len, parts[-1].values())) + len(templates[name]) > most:
            parts.append({})
        parts[-1][name] = templates[name]
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if len(parts) > 1:
        base = stage_table(base.withColumn("row", F.monotonically_increasing_id()), "texts")
        every = [_scan(base, part, least, "row") for part in parts]
        both = every[0]
        for other in every[1:]:
            o = other.select(F.col("row").alias("o_row"), F.struct(*(F.col(c).alias(c) for c in _BEST)).alias("o"), F.col("licenses").alias("o_licenses"))
            rank = lambda p: F.struct(F.coalesce(p("n_matched"), F.lit(-1)), p("coverage"), F.lit(0))
            wins = rank(lambda c: F.col("o." + c)) > rank(F.col)
            joined = both.join(o, F.col("row") == F.col("o_row"))
            both = joined.select("row", "doc_id", "n_words", *(F.when(wins, F.col("o." + c)).otherwise(F.col(c)).alias(c) for c in _BEST), F.concat("licenses", "o_licenses").alias("licenses"))
        return both.drop("row")
    return _scan(base, parts[0], least)


_BEST = ("license", "coverage", "n_matched", "first_word", "end_word")


def _scan(base: DataFrame, templates: dict[str, str], least: float, *carry: str) -> DataFrame:
    schema = pa.schema([*((c, pa.int64()) for c in carry), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("n_matched", pa.int64()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("licenses", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = [Template(n, t) for n, t in sorted(templates.items())]
        for b in slices(batches):
            rows = [scan_text(t, every, least) for t in text_bytes(b.column("text"))]
            best = [found[0] if found else (None,) * 5 for _, found in rows]
            name, coverage, n, a, e = zip(*best, strict=True)
            yield batch_of(schema, **{c: b.column(c) for c in carry}, doc_id=b.column("doc_id"), n_words=[k for k, _ in rows], license=name, coverage=coverage, n_matched=n, first_word=a, end_word=e, licenses=[[x[0] for x in found] for _, found in rows])

    return map_arrow(base, run, "".join(f"{c} long, " for c in carry) + "doc_id long, n_words long, license string, coverage double, n_matched long, first_word long, end_word long, licenses array<string>")
