"""Edit-aware token counts: a tree over the pre-tokens of a document, re-encoded only where an edit touches it.

Leaves are blocks of pre-tokens with their token counts; inner nodes of the segment tree hold characters, pre-tokens and tokens of their subtree.
An edit finds its place from the top by character sums, re-splits the touched pre-tokens with some context on the left and as much on the right as it
takes until a new boundary falls on an old one, counts only the new pre-tokens, and corrects the sums on the way up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.bpe import Coder
from corpusgraph.llm.common import batch_of, map_arrow, slices

BLOCK = 64  # pre-tokens of a leaf
Edit = tuple[int, int, str]  # characters [start, end) of the text as it is then become the string


class TokenTree:
    """Pre-tokens of one document and the sums over them."""

    def __init__(self, words: list[str], split: Callable[[str], list[str]], count: Callable[[list[str]], list[int]], block: int = BLOCK, context: int = 16) -> None:
        self.split, self.count, self.block, self.context = split, count, block, context
        self.recounted = 0
        self._build(words, count(words))

    def _build(self, words: list[str], counts: list[int]) -> None:
        b = self.block
        self.words = [words[k : k + b] for k in range(0, len(words), b)] or [[]]
        self.counts = [counts[k : k + b] for k in range(0, len(counts), b)] or [[]]
        self.size = 1 << (len(self.words) - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 3), np.int64)  # characters, pre-tokens, tokens
        for k in range(len(self.words)):
            self.sums[self.size + k] = self._leaf(k)
        level = self.size
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    def _leaf(self, k: int) -> tuple[int, int, int]:
        return sum(map(len, self.words[k])), len(self.words[k]), sum(self.counts[k])

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def pretokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 2])

    def text(self) -> str:
        return "".join(w for ws in self.words for w in ws)

    def find(self, at: int) -> tuple[int, int, int]:
        """(leaf, pre-token in it, where it starts) of the pre-token that holds character ``at``; past the end: the place after the last."""
        node, start = 1, 0
        if at >= self.chars:
            k = len(self.words) - 1
            return k, len(self.words[k]), self.chars
        while node < self.size:
            node *= 2
            if at - start >= self.sums[node, 0]:
                start += int(self.sums[node, 0])
                node += 1
        k = node - self.size
        for i, w in enumerate(self.words[k]):
            if at < start + len(w):
                return k, i, start
            start += len(w)
        raise AssertionError

    def _after(self, k: int, i: int) -> Iterator[tuple[int, int, str]]:
        while k < len(self.words):
            for j in range(i, len(self.words[k])):
                yield k, j, self.words[k][j]
            k, i = k + 1, 0

    def apply(self, start: int, end: int, new: str) -> None:
        """Replaces characters [start, end), held inside the text, by ``new``."""
        start = min(max(start, 0), self.chars)
        end = min(max(end, start), self.chars)
        first, i, left = self.find(max(0, start - self.context))
        if i == len(self.words[first]) and i:  # past the end: the last pre-token may grow
            i -= 1
            left -= len(self.words[first][i])
        head, tail = "", ""
        old_ends: dict[int, tuple[int, int]] = {}  # characters of the tail before an old boundary: the place after it
        stop, want, at = None, 4 * self.context, left
        rest = self._after(first, i)
        found = None
        while found is None:
            ended = True
            for k, j, w in rest:
                if at < start:
                    head += w[: max(0, start - at)]
                if at + len(w) > end:
                    tail += w[max(0, end - at) :]
                at += len(w)
                stop = (k, j + 1)
                if at >= end:
                    old_ends[at - end] = stop
                if len(tail) >= want:
                    ended = False
                    break
            words = self.split(head + new + tail)
            fixed = len(head) + len(new)
            place = 0
            for n, w in enumerate(words):
                place += len(w)
                # a boundary on an old one, with enough of the text after it to be sure of it
                if place >= fixed and place - fixed in old_ends and (ended or len(tail) - (place - fixed) >= self.context):
                    found = (words[: n + 1], old_ends[place - fixed])
                    break
            if found is None and ended:
                found = (words, stop or (first, i))
            want *= 4
        fresh, (last, j) = found
        counts = self.count(fresh)
        self.recounted += len(fresh)
        words = self.words[first][:i] + fresh + self.words[last][j:]
        numbers = self.counts[first][:i] + counts + self.counts[last][j:]
        if len(words) > 8 * self.block:
            before_w = [w for ws in self.words[:first] for w in ws]
            before_c = [c for cs in self.counts[:first] for c in cs]
            self._build(before_w + words + [w for ws in self.words[last + 1 :] for w in ws], before_c + numbers + [c for cs in self.counts[last + 1 :] for c in cs])
            return
        self.words[first], self.counts[first] = words, numbers
        for k in range(first + 1, last + 1):
            self.words[k], self.counts[k] = [], []
        for k in range(first, last + 1):
            node = self.size + k
            change = np.array(self._leaf(k), np.int64) - self.sums[node]
            while node:
                self.sums[node] += change
                node //= 2


#: What the query's edits replace, and by what
REDACT = regex.compile(r"[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]+|password=\S+|\bAKIA[0-9A-Z]{16}\b|[0-9a-f]{32,}")
REDACTED = "[REDACTED]"


def redaction_edits(text: str) -> list[Edit]:
    """From the end to the start, so that places stay right: redact personal data and secrets; then a title line at the start."""
    return [(m.start(), m.end(), REDACTED) for m in REDACT.finditer(text)][::-1] + [(0, 0, "# Document\n")]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64()), ("n_edits", pa.int64()), ("n_recounted", pa.int64()), ("n_tokens_after", pa.int64()), ("n_chars_after", pa.int64())])


def count_with_edits(docs: DataFrame, path: str, edits: Callable[[str], list[Edit]] = redaction_edits) -> DataFrame:
    """One row per document row: counts before, the edits, the pre-tokens that they made to be counted again, and counts after.

    Null text is empty; a very long one has a deeper tree. doc_id may be null or repeated. Other columns are not read. Empty: no rows. Edits beyond a text's end are held at its end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.get(path)
        for b in slices(batches, 256):
            texts = [t or "" for t in b.column("text").to_pylist()]
            words = [coder.vocabulary.words(t) if t else [] for t in texts]
            coder.counts(set().union(*words))

            def count(ws: list[str]) -> list[int]:
                if new := {w for w in ws if w not in coder.count}:
                    coder.count.update(zip(new, map(len, coder.encoder.ids_of(list(new))), strict=True))
                return [coder.count[w] for w in ws]

            rows = []
            for t, ws in zip(texts, words, strict=True):
                tree = TokenTree(ws, coder.vocabulary.words, count, context=coder.vocabulary.context)
                before = (tree.pretokens, tree.tokens)
                some = edits(t)
                for e in some:
                    tree.apply(*e)
                rows.append((*before, len(some), tree.recounted, tree.tokens, tree.chars))
            columns = dict(zip(_OUT.names[1:], zip(*rows, strict=True), strict=True)) if rows else {n: [] for n in _OUT.names[1:]}
            yield batch_of(_OUT, doc_id=b.column("doc_id"), **columns)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, ", ".join(f"{n} long" for n in _OUT.names))
