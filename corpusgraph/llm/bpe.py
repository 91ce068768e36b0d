"""Exact byte-level BPE with a memory-mapped transducer lexicon.

Frequent words of the corpus are compiled, with the ids that merging gives them, into a minimal acyclic transducer: words
share suffixes in the automaton, numbers on its arcs add up to the word's place, and the place leads to its ids. The file is shipped
once to every executor and memory-mapped by its Python workers. A batch's distinct words run through it together, one
byte of all of them at a step; words that it lacks are merged exactly, again all of them together, one merge of each at a step.
Without a lexicon every word is merged: results are the same.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import batch_of, map_arrow, share_bytes, slices, stage_table

#: Fixed value: the published pattern of byte-level pre-tokenizers
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEXICON_WORDS = 1 << 16
LEXICON_CHARS = 64  # of a piece in the lexicon, at most; longer ones are merged like all that it lacks
CACHE_WORDS = 800_000
_LONG = 48  # bytes; longer words merge one by one, through a heap


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in vocabulary files: itself where printable, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Vocabulary:
    """Ids, merges and added tokens of a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        to_bytes = lambda token: bytes(letters[c] for c in token)
        if odd := [t["content"] for t in spec["added_tokens"] if any(t.get(f) for f in ("lstrip", "rstrip", "single_word"))]:
            raise ValueError(f"added tokens that take in what stands around them are not supported: {odd[:3]}")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: t.encode() if t in self.special else to_bytes(t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.first = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        into = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.rank = {int(k): (n, int(i)) for n, (k, i) in enumerate(zip(key, into, strict=True))}
        order = np.argsort(key)
        self.key, self.key_rank, self.key_into = key[order], order, into[order]
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)

    @property
    def context(self) -> int:
        """Characters on which a boundary between pre-tokens may depend: the longest added token, or the look-ahead of the pattern."""
        return max(16, *map(len, self.special)) if self.special else 16

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text in order; their concatenation is the text. Added tokens stand alone."""
        if self.split is None or not any(s in text for s in self.special):
            return self.pattern.findall(text)
        out: list[str] = []
        for n, part in enumerate(self.split.split(text)):
            out += [part] if n % 2 else self.pattern.findall(part)
        return out

    def merge_one(self, word: bytes) -> list[int]:
        """Merges of lowest rank first, leftmost among equals, through a heap over a linked list: n log n for any length."""
        ids = self.first[np.frombuffer(word, np.uint8)].tolist()
        nxt, prv, rank = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)], self.rank
        heap = [(r[0], i, r[1], ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := rank.get(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, into, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = into, -1
            nxt[i] = nxt[j]
            if nxt[i] >= 0:
                prv[nxt[i]] = i
                if r := rank.get(into << 32 | ids[nxt[i]]):
                    heapq.heappush(heap, (r[0], i, r[1], into, ids[nxt[i]]))
            if prv[i] >= 0 and (r := rank.get(ids[prv[i]] << 32 | into)):
                heapq.heappush(heap, (r[0], prv[i], r[1], ids[prv[i]], into))
        return [x for x in ids if x >= 0]

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        ok = (self.key[at] == key) & (left >= 0) & (right >= 0)
        return np.where(ok, self.key_rank[at], 1 << 40), self.key_into[at]

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word; words of like length step together, one merge each at a time."""
        out: list[list[int]] = [[]] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(sizes > _LONG).tolist():
            out[i] = self.merge_one(words[i])
        for size in np.unique(sizes[(sizes > 0) & (sizes <= _LONG)]).tolist():
            every = np.flatnonzero(sizes == size)
            for at in range(0, len(every), 1 << 15):
                some = every[at : at + (1 << 15)]
                ids = self.first[np.frombuffer(b"".join(words[i] for i in some.tolist()), np.uint8)].reshape(len(some), size)
                for i, row in zip(some.tolist(), self._merge_matrix(ids), strict=True):
                    out[i] = row
        return out

    def _merge_matrix(self, ids: np.ndarray) -> list[list[int]]:
        n, size = ids.shape
        done = [None] * n
        at = np.arange(n)
        if size > 1:
            rank, into = (x.reshape(n, size - 1) for x in self._pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()))
        while size > 1 and len(at):
            best = rank.argmin(1)
            row = np.arange(len(at))
            open_ = rank[row, best] < 1 << 40
            if not open_.all():
                for i, r in zip(at[~open_].tolist(), ids[~open_].tolist(), strict=True):
                    done[i] = r
                at, ids, rank, into, best = at[open_], ids[open_], rank[open_], into[open_], best[open_]
                row = np.arange(len(at))
                if not len(at):
                    break
            new = into[row, best]
            # drop column best + 1 of ids, and of the pairs
            column = np.arange(size - 1)
            ids = np.take_along_axis(ids, column + (column > best[:, None]), 1)
            ids[row, best] = new
            size -= 1
            if size > 1:
                column = np.arange(size - 1)
                keep = column + (column >= best[:, None])
                rank, into = np.take_along_axis(rank, keep, 1), np.take_along_axis(into, keep, 1)
                for side in (best - 1, best):
                    ok = np.flatnonzero((side >= 0) & (side < size - 1))
                    rank[ok, side[ok]], into[ok, side[ok]] = self._pair_ranks(ids[ok, side[ok]], ids[ok, side[ok] + 1])
        for i, r in zip(at.tolist(), ids.tolist(), strict=True):
            done[i] = r
        return done

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids, special ones kept; bytes that aren't UTF-8 become replacement characters. Unknown ids are skipped."""
        return b"".join(self.bytes_of.get(i, b"") for i in ids).decode("utf-8", "replace")


class Transducer:
    """Minimal acyclic automaton over bytes; numbers on the arcs of a word add up to its place among the sorted words."""

    FIELDS = ("arc", "target", "number", "final", "offset", "ids")

    @staticmethod
    def compile(entries: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
        """Sorted words go in one by one; the part of the last word that the next doesn't share is replaced by equal states that are there (Daciuk and others, 2000)."""
        words = sorted(entries)
        final, arcs = [False], [{}]
        register: dict[tuple, int] = {}
        path: list[tuple[int, int]] = []  # (state, byte) of the last word that isn't fixed yet

        def fix(down_to: int) -> None:
            while len(path) > down_to:
                state, byte = path.pop()
                child = arcs[state][byte]
                same = register.setdefault((final[child], tuple(arcs[child].items())), child)
                arcs[state][byte] = same

        last = b""
        for w in words:
            common = len(os.path.commonprefix([last, w]))
            fix(common)
            state = arcs[path[-1][0]][path[-1][1]] if path else 0
            for b in w[common:]:
                arcs.append({})
                final.append(False)
                arcs[state][b] = len(arcs) - 1
                path.append((state, b))
                state = len(arcs) - 1
            final[state] = True
            last = w
        fix(0)
        # states in use, renumbered; words below each
        number, order, todo = {0: 0}, [0], [0]
        while todo:
            for t in arcs[todo.pop()].values():
                if t not in number:
                    number[t] = len(order)
                    order.append(t)
                    todo.append(t)
        below: dict[int, int] = {}
        stack = [(0, False)]
        while stack:
            s, seen = stack.pop()
            if s in below:
                continue
            if seen:
                below[s] = final[s] + sum(below[t] for t in arcs[s].values())
            else:
                stack.append((s, True))
                stack += [(t, False) for t in arcs[s].values() if t not in below]
        rows = []
        for s in order:
            n = int(final[s])
            for b, t in arcs[s].items():
                rows.append((number[s] << 8 | b, number[t], n))
                n += below[t]
        rows.sort()
        arc, target, num = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
        lengths = np.array([len(entries[w]) for w in words], np.int64)
        return {"arc": arc, "target": target.astype(np.int32), "number": num.astype(np.int32), "final": np.array([final[s] for s in order], np.uint8), "offset": np.r_[0, np.cumsum(lengths)].astype(np.int64), "ids": np.array([i for w in words for i in entries[w]], np.int32)}

    @staticmethod
    def dump(tables: dict[str, np.ndarray]) -> bytes:
        """A file: a head of 1024 bytes that says where each table stands, then the tables."""
        head, at, parts = [], 0, []
        for n in Transducer.FIELDS:
            head.append((n, tables[n].dtype.str, len(tables[n]), at))
            parts.append(tables[n].tobytes().ljust(-(-tables[n].nbytes // 64) * 64, b"\0"))
            at += len(parts[-1])
        return json.dumps(head).encode().ljust(1024) + b"".join(parts)

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            head = json.loads(f.read(1024))
        for n, kind, count, at in head:
            setattr(self, n, np.memmap(path, np.dtype(kind), "r", 1024 + at, (count,)) if count else np.zeros(0, np.dtype(kind)))

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """Place of each word, or -1."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        x = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(sizes) - sizes
        state, place = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        live = np.arange(len(words)) if len(self.arc) else np.zeros(0, np.int64)
        found = np.full(len(words), -1, np.int64)
        step = 0
        while len(live):
            ends = sizes[live] == step
            e = live[ends]
            e = e[self.final[state[e]] == 1]
            found[e] = place[e]
            live = live[~ends]
            key = state[live] << 8 | x[start[live] + step]
            at = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
            ok = self.arc[at] == key
            live, at = live[ok], at[ok]
            state[live] = self.target[at]
            place[live] += self.number[at]
            step += 1
        return found

    def ids_at(self, place: int) -> list[int]:
        return self.ids[self.offset[place] : self.offset[place + 1]].tolist()


class Encoder:
    """Words to ids: through the lexicon, and what it lacks by merging."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Transducer | None = None) -> None:
        self.vocabulary, self.lexicon = vocabulary, lexicon

    def ids_of(self, words: list[str]) -> list[list[int]]:
        special = self.vocabulary.special
        out: list[list[int]] = [[special[w]] if w in special else [] for w in words]
        at = [k for k, w in enumerate(words) if w not in special]
        raw = [words[k].encode() for k in at]
        if self.lexicon is not None and raw:
            place = self.lexicon.look_up(raw)
            for k in np.flatnonzero(place >= 0).tolist():
                out[at[k]] = self.lexicon.ids_at(int(place[k]))
            rest = np.flatnonzero(place < 0).tolist()
            at, raw = [at[k] for k in rest], [raw[k] for k in rest]
        for k, ids in zip(at, self.vocabulary.merge_many(raw), strict=True):
            out[k] = ids
        return out

    def encode(self, text: str) -> list[int]:
        words = self.vocabulary.words(text)
        new = list(dict.fromkeys(words))
        ids = dict(zip(new, self.ids_of(new), strict=True))
        return [i for w in words for i in ids[w]]


class Coder:
    """An encoder with what it printed and decoded before, for as many words as CACHE_WORDS; one lives as long as its Python worker."""

    _made: dict[tuple[str, str | None], Coder] = {}

    @staticmethod
    def get(path: str, lexicon: str | None = None) -> Coder:
        if (path, lexicon) not in Coder._made:
            Coder._made = {(path, lexicon): Coder(path, lexicon)}
        return Coder._made[path, lexicon]

    def __init__(self, path: str, lexicon: str | None) -> None:
        self.vocabulary = Vocabulary(path)
        self.encoder = Encoder(self.vocabulary, Transducer(SparkFiles.get(lexicon)) if lexicon else None)
        size = max(self.vocabulary.bytes_of) + 1
        self.number = [b"%d" % i for i in range(size)]
        self.bytes_of = [self.vocabulary.bytes_of.get(i, b"") for i in range(size)]
        self.printed: dict[str, bytes] = {}
        self.decoded: dict[str, bytes] = {}
        self.count: dict[str, int] = {}

    def learn(self, words: set[str]) -> None:
        """Fills printed and decoded for all of the words."""
        new = list(words.difference(self.printed))
        if len(self.printed) + len(new) > CACHE_WORDS and self.printed:
            self.printed.clear()
            self.decoded.clear()
            new = list(words)
        number, bytes_of = self.number, self.bytes_of
        for w, ids in zip(new, self.encoder.ids_of(new), strict=True):
            self.printed[w] = b",".join([number[i] for i in ids])
            self.decoded[w] = b"".join([bytes_of[i] for i in ids])

    def counts(self, words: set[str]) -> dict[str, int]:
        """Number of ids of each word."""
        new = list(words.difference(self.count))
        if len(self.count) + len(new) > CACHE_WORDS and self.count:
            self.count.clear()
            new = list(words)
        self.count.update(zip(new, map(len, self.encoder.ids_of(new)), strict=True))
        return self.count


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each piece between spaces occurs over all documents; all pieces count, those that a batch saw once too."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            pieces = pc.value_counts(pc.list_flatten(pc.split_pattern(b.column("text"), " ")))
            yield batch_of(schema, word=pieces.field("values"), n=pieces.field("counts"))

    return map_arrow(docs.select("text"), run, "word string, n long").where("word is not null").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_bins(often: dict[int, int], size: int) -> tuple[int | None, int | None, int]:
    """(least bin of which all words fit, the bin below it, words of that one that still fit) of counts by bin."""
    room, least = size, None
    for c in sorted(often, reverse=True):
        if often[c] > room:
            return least, c, room
        room, least = room - often[c], c
    return least, None, 0


def frequent_words(counts: DataFrame, size: int) -> list[str]:
    """The most frequent words of (word, n), ``size`` at most, whatever the counts are.

    Counts are binned by sixteenths of an octave, a thousand bins at any input; of the first bin that doesn't fit, a share chosen by the words' hash.
    """
    bin_ = F.floor(F.log2("n") * 16).cast("int")
    often = {r.c: r.k for r in counts.groupBy(bin_.alias("c")).agg(F.count("*").alias("k")).collect()}
    least, part, room = frequent_bins(often, size)
    chosen = F.lit(False) if least is None else bin_ >= least
    if part is not None:
        share = max(0, room - 4 * int(room**0.5))  # hashing deals unevenly: stay below the room
        chosen = chosen | (bin_ == part) & (F.pmod(F.xxhash64("word"), F.lit(often[part])) < share)
    return sorted(r.word for r in counts.where(chosen).limit(size).collect())


def build_lexicon(docs: DataFrame, path: str, size: int = LEXICON_WORDS) -> str:
    """Compiles the most frequent words, ``size`` at most (a few MB at any input), and ships the file to all executors; returns its name."""
    vocabulary = Vocabulary(path)
    short = word_counts(docs).where(F.length("word") <= LEXICON_CHARS)  # before the shuffle: a text without spaces doesn't travel
    top = frequent_words(stage_table(short, "words"), size)
    words = [w for w in dict.fromkeys(p for t in top for p in vocabulary.words(" " + t)) if w not in vocabulary.special]
    raw = [w.encode() for w in words]
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    return share_bytes(docs.sparkSession, name, Transducer.dump(Transducer.compile(dict(zip(raw, vocabulary.merge_many(raw), strict=True)))))


_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def _rows(path: str, lexicon: str | None, columns: list[str]):
    schema = pa.schema([_ENCODED.field(c) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.get(path, lexicon)
        for b in slices(batches, 256):
            words = [coder.vocabulary.words(t) if t else [] for t in b.column("text").to_pylist()]
            coder.learn(set().union(*words))
            out: dict[str, list] = {c: [] for c in columns if c != "doc_id"}
            for ws in words:
                ids = b",".join(map(coder.printed.__getitem__, ws))
                if "n_tokens" in out:
                    out["n_tokens"].append(ids.count(b",") + 1 if ids else 0)
                if "ids_sha256" in out:
                    out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                if "ids" in out:
                    out["ids"].append(np.array(ids.split(b",") if ids else [], np.int32))
                if "decoded" in out or "decoded_sha256" in out:
                    raw = b"".join(map(coder.decoded.__getitem__, ws))
                    text = raw.decode("utf-8", "replace")
                    if "decoded_sha256" in out:
                        out["decoded_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
                    if "decoded" in out:
                        out["decoded"].append(text)
            yield batch_of(schema, doc_id=b.column("doc_id"), **out)

    return run


def encode_documents(docs: DataFrame, path: str, lexicon: str | None = None, columns: tuple[str, ...] = ("doc_id", "n_tokens", "ids")) -> DataFrame:
    """One row per document row with the wanted of: doc_id, n_tokens, ids (array), decoded (text of the ids), ids_sha256, decoded_sha256.

    Null text is empty: no ids. Very long texts are encoded whole. doc_id may be null or repeated, one row each; other columns of docs are not read. Empty: no rows.
    ``path``: the tokenizer file, at the same place on every executor; ``lexicon``: what build_lexicon returned.
    """
    sql = {"doc_id": "long", "n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _rows(path, lexicon, list(columns)), ", ".join(f"{c} {sql[c]}" for c in columns))


def append_tokens(docs: DataFrame, path: str, lexicon: str | None = None) -> DataFrame:
    """docs with n_tokens and ids of its texts; columns of these names that docs has are replaced. Null text has no ids."""
    base = docs.drop("n_tokens", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.get(path, lexicon)
        for b in slices(batches, 256):
            words = [coder.vocabulary.words(t) if t else [] for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            coder.learn(set().union(*words))
            ids = [np.array(x.split(b",") if x else [], np.int32) for x in (b",".join(map(coder.printed.__getitem__, ws)) for ws in words)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(map(len, ids)), pa.int64()), pa.array(ids, pa.list_(pa.int32()))], [*b.schema.names, "n_tokens", "ids"])

    return map_arrow(base, run, f"{base.schema.simpleString()[7:-1]}, n_tokens bigint, ids array<int>")
