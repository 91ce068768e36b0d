"""Substring deduplication across documents by longest-previous-factor arrays over sharded suffix arrays.

A byte goes if it lies in a ``width``-byte string that also starts in a document of a smaller doc_id. Suffixes whose first
``width`` bytes are equal must meet in one shard, so the shard key is the least hash of the strings of ``GRAM`` bytes inside
those bytes: equal strings have equal minima, and neighbouring starts mostly share one. Starts of one document that share
a minimum form a run; runs, not single suffixes, travel.

1. Documents are packed into compressed pages, a table bucketed by page: texts move once, and later joins bring matches to them.
2. Each task sends the place of its runs to the shard of their key. Copies of whole runs are settled where they meet, in a task or in a shard: equal bytes in a smaller document are a match.
3. A shard tells which keys several documents hold; only runs of these fetch their bytes.
4. A shard's bytes, one copy of each run, are one text: its suffix array, the common prefixes of neighbours in it, and for every suffix the longest factor shared with the
   previous and with the next smaller position (positions in the order of doc_id). A suffix whose longest previous factor has ``width`` bytes has an earlier match.
5. Matches of a page join it, and its texts are cut.

Hashes only bring together what may be equal; every match is one of bytes. A key under which a task sees many different contents (a passage that is followed by
other words in each document) is hot: its runs are split into single starts, whose key is the hash of all their bytes, so that they spread over all shards.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import batch_of, map_arrow, parts_for, slices, stage_table, staged_path

WIDTH = 50
GRAM = 16
HOT = 32  # different contents of one key in a task from which its runs are split
PAGE_BYTES = 1 << 20  # of text in a page; a longer text has a page of its own
_PIECE = 50  # starts of a run at most
_STARTS = 1 << 18  # starts hashed at once
_FLUSH = 1 << 18  # runs that a task holds before it sends; about 150 bytes of memory each then
_FETCHED = 1 << 24  # bytes of runs that a task holds before it sends
_SORTED = 1 << 17  # suffixes in one suffix array, or as many as one key has
_LEN_BITS = 8
_T = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.uint64(0x9E3779B97F4A7C15)
_C = np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _C
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_B), n, 1 << 64))


def _strings(x: np.ndarray, width: int, powers: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """The hash of the ``width`` bytes at every start; powers gets those of shorter strings."""
    powers = {} if powers is None else powers
    powers[1] = _T[x]
    n = 1
    while 2 * n <= width:
        h = powers[n]
        powers[2 * n] = h[:-n] * _power(n) + h[n:]
        n *= 2
    whole, have = None, 0
    for bit in sorted(powers, reverse=True):
        if width & bit:
            part = powers[bit]
            whole = part if whole is None else whole[: len(x) - width + 1 + (width - have - bit)] * _power(bit) + part[have : have + len(x) - have - bit + 1][: len(x) - have - bit + 1]
            have += bit
    return whole[: len(x) - width + 1]


def _hashes(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For every start of ``width`` bytes: the least hash of the GRAM-byte strings in it, and its own hash."""
    powers: dict[int, np.ndarray] = {}
    whole = _strings(x, width, powers)
    least = _mix(powers[GRAM])
    n, span = 1, width - GRAM + 1
    while 2 * n <= span:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    if span > n:
        least = np.minimum(least[: -(span - n)], least[span - n :])
    return least[: len(x) - width + 1], whole


def runs(docs: list[tuple[int, bytes]], width: int = WIDTH) -> Iterator[tuple[np.ndarray, ...]]:
    """For blocks of documents (number, bytes): arrays number, start, starts, key, content of their runs."""
    held, size = [], 0

    def block() -> tuple[np.ndarray, ...]:
        lengths = np.array([len(t) for _, t, _ in held])
        x = np.frombuffer(b"".join(t for _, t, _ in held), np.uint8)
        least, whole = _hashes(x, width)
        owner = np.repeat(np.arange(len(held)), lengths)
        valid = owner[: len(least)] == owner[width - 1 :]
        cut = np.empty(len(least), bool)
        cut[0] = True
        np.not_equal(least[1:], least[:-1], out=cut[1:])
        cut[1:] |= valid[1:] != valid[:-1]
        cut[1:] |= owner[1 : len(least)] != owner[: len(least) - 1]
        first = np.flatnonzero(cut)
        size = np.diff(np.r_[first, len(least)])
        ok = valid[first]
        first, size = first[ok], size[ok]
        if (size > _PIECE).any():
            pieces = -(-size // _PIECE)
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first, size = np.repeat(first, pieces) + nth * _PIECE, np.minimum(np.repeat(size, pieces) - nth * _PIECE, _PIECE)
        content = _mix(whole[first] * _C + _mix(whole[first + size - 1] + size.astype(np.uint64)))
        base = np.cumsum(lengths) - lengths
        o = owner[first]
        return np.array([k for k, _, _ in held])[o], first - base[o] + np.array([s for _, _, s in held])[o], size, _mix(least[first] + _B), content

    for number, text in docs:
        for at in range(0, len(text) - width + 1, _STARTS):
            part = text[at : at + _STARTS + width - 1] if len(text) > _STARTS else text
            held.append((number, part, at))
            size += len(part)
            if size >= _STARTS:
                yield block()
                held, size = [], 0
    if held:
        yield block()


def longest_previous(order: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Longest previous factors in suffix order: of suffix order[k] the longest prefix that it shares with a suffix of smaller rank.

    common[k] is the common prefix of order[k - 1] and order[k]. In suffix order the best partner is the nearest suffix of smaller rank, on one
    side or the other; its common prefix is the least of those on the way, which the pointer jumps carry along.
    """

    def one_side(values: np.ndarray, shared: np.ndarray) -> np.ndarray:
        at, low = np.arange(-1, len(values) - 1), shared.copy()
        todo = np.flatnonzero(at >= 0)
        while len(todo):
            todo = todo[values[at[todo]] >= values[todo]]
            low[todo] = np.minimum(low[todo], low[at[todo]])
            at[todo] = at[at[todo]]
            todo = todo[at[todo] >= 0]
        return np.where(at >= 0, low, 0)

    values = rank[order]
    ahead = np.r_[common[1:], 0]
    return np.maximum(one_side(values, common), one_side(values[::-1], ahead[::-1])[::-1])


def suffix_array(x: np.ndarray, start: np.ndarray, rank: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): suffixes at ``start`` by their first ``width`` bytes, then rank; and the common prefix of neighbours, ``width`` at most."""
    padded = np.r_[x, np.zeros(8, np.uint8)]
    columns = []
    for w in range(0, width, 8):
        word = np.zeros(len(start), np.uint64)
        for b in range(8):
            word = (word << np.uint64(8)) | (padded[start + w + b].astype(np.uint64) if w + b < width else np.uint64(0))
        columns.append(word)
    order = np.lexsort((rank, *columns[::-1]))
    common = np.zeros(len(order), np.int64)
    open_ = np.arange(1, len(order))
    for c in columns:
        differ = c[order[open_]] ^ c[order[open_ - 1]]
        same = differ == 0
        high = differ[~same]
        lead = np.zeros(len(high), np.int64)  # whole bytes before the first that differs
        for b in range(1, 8):
            lead += (high >> np.uint64(64 - 8 * b)) == 0
        common[open_[~same]] += lead
        open_ = open_[same]
        common[open_] += 8
    return order, np.minimum(common, width)


def _several(hashes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Ascending places of the hashes that more than one rank has."""
    order = np.argsort(hashes)
    h, r = hashes[order], rank[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    shared = np.minimum.reduceat(r, first) != np.maximum.reduceat(r, first)
    return np.sort(order[np.repeat(shared, np.diff(np.r_[first, len(h)]))])


def earlier_matches(keys: np.ndarray, rank_of: np.ndarray, texts: bytes, counts: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(content, place) of the suffixes whose longest previous factor has ``width`` bytes.

    Contents of counts[i] + width - 1 bytes stand in texts one after the other, in order of their keys; content i is of the document of rank rank_of[i], and suffixes start
    at its first counts[i] bytes. Equal suffixes have equal keys, so suffix arrays of whole keys are as good as one of all; and a suffix whose first ``width`` bytes
    have a hash that no other document has is left out of them, as it has no match.
    """
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.r_[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), len(keys)]
    total, ends = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(counts + width - 1)]
    found = []
    k = 0
    while k < len(edge) - 1:
        m = max(k + 1, int(np.searchsorted(total[edge], total[edge[k]] + _SORTED, side="right")) - 1)
        a, e = edge[k], edge[m]
        k = m
        x = np.frombuffer(texts[ends[a] : ends[e]], np.uint8)
        c = counts[a:e]
        item = np.repeat(np.arange(a, e), c)
        place = np.arange(len(item)) - np.repeat(np.cumsum(c) - c, c)
        start = ends[item] - ends[a] + place
        some = _several(_strings(x, width)[start], rank_of[item])
        if len(some):
            item, place, rank = item[some], place[some], rank_of[item[some]]
            order, common = suffix_array(x, start[some], rank, width)
            hit = np.sort(order[longest_previous(order, common, rank) >= width])
            found.append((item[hit], place[hit]))
    return tuple(np.concatenate([f[n] for f in found]) if found else np.zeros(0, np.int64) for n in range(2))


_CODER: dict[str, object] = {}


def _packed(*arrays: np.ndarray) -> bytes:
    """64-bit numbers, for each array all first bytes before all second ones, compressed."""
    coder = _CODER.setdefault("c", zstandard.ZstdCompressor(level=1))
    return coder.compress(b"".join(x.astype(np.int64, copy=False).view(np.uint8).reshape(-1, 8).T.tobytes() for x in arrays))


def _unpacked(blobs: list[bytes], arrays: int) -> list[np.ndarray]:
    coder = _CODER.setdefault("d", zstandard.ZstdDecompressor())
    parts = [np.frombuffer(coder.decompress(b), np.uint8) for b in blobs]
    return [np.concatenate([np.ascontiguousarray(p.reshape(arrays, 8, -1)[n].T).view(np.int64).ravel() for p in parts]) if parts else np.zeros(0, np.int64) for n in range(arrays)]


def _pages(docs: DataFrame, n: int) -> DataFrame:
    """(page, blob): rows of docs, of which the first column is a long and another is text, packed in Arrow streams; bucketed by page."""
    spark = docs.sparkSession
    text_at = docs.columns.index("text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page", pa.int64()), ("blob", pa.binary())])
        held: list[pa.RecordBatch] = []
        size, number = 0, TaskContext.get().partitionId() << 32

        def page() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(whole)
            return batch_of(schema, page=[number], blob=[sink.getvalue().to_pybytes()])

        for b in slices(batches, 32):
            held.append(b)
            size += b.column(text_at).nbytes
            if size >= PAGE_BYTES:
                yield page()
                held, size, number = [], 0, number + 1
        if held:
            yield page()

    name = f"cg_pages_{uuid.uuid4().hex}"
    packed = map_arrow(docs, pack, "page long, blob binary").repartition(n, "page")
    packed.write.bucketBy(n, "page").option("compression", "none").option("path", staged_path(spark, name)).format("parquet").saveAsTable(name)
    pages = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # only its name: the files stay, and the plan has found them
    return pages


def _page(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all().combine_chunks().to_batches()[0]


class _Texts:
    """Texts of a page, one after the other."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        raw = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
        self.ids = batch.column(0).to_pylist()
        self.texts = [b"" if t is None else t for t in raw]
        self.nulls = [t is None for t in raw]
        self.sizes = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        self.base = np.cumsum(self.sizes) - self.sizes


_SENT = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("page", pa.int64()), ("blob", pa.binary())])
_SENT_SQL = "shard int, kind int, page long, blob binary"
_RUNS, _MATCHES, _SPLIT, _MARKS = range(4)  # kinds: runs; matches; runs of hot keys; hot keys


def _spot(offset: np.ndarray, count: np.ndarray) -> np.ndarray:
    return (offset.astype(np.int64) << _LEN_BITS) | count.astype(np.int64)


def _offset(spot: np.ndarray) -> np.ndarray:
    return spot >> _LEN_BITS


def _count(spot: np.ndarray) -> np.ndarray:
    return spot & ((1 << _LEN_BITS) - 1)


def _shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _by(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ends of the stretches of equal values."""
    cut = np.r_[0, np.flatnonzero(values[1:] != values[:-1]) + 1, len(values)] if len(values) else np.zeros(1, np.int64)
    return zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)


def _same_bytes(x: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, at_once: int = 1 << 18) -> np.ndarray:
    """Whether x holds the same ``size`` bytes at places a and b."""
    out = np.ones(len(a), bool)
    ends = np.cumsum(size)
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + at_once, side="right")))
        n = size[at:to]
        first = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(first, n)
        out[at:to] = np.logical_and.reduceat(x[np.repeat(a[at:to], n) + step] == x[np.repeat(b[at:to], n) + step], first)
        at = to
    return out


def _places(page: np.ndarray, spot: np.ndarray, kind: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Rows of places by page; their shard only spreads them."""
    order = np.argsort(page, kind="stable")
    page, spot = page[order], spot[order]
    for a, e in _by(page):
        yield batch_of(_SENT, shard=[int(page[a]) % shards], kind=[kind], page=[int(page[a])], blob=[_packed(spot[a:e])])


def _find_runs(shards: int, width: int) -> Callable:
    def flush(parts: list[list[np.ndarray]], pages: list[int], ids: list[int], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        number, start, count, key, content = (np.concatenate([p.pop(0) for p in parts]) for _ in range(5))  # a column's parts go as it is joined
        page, doc, offset = np.array(pages)[number, 0], np.array(ids, np.int64)[number], np.array(pages)[number, 1] + start
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        at = (np.cumsum(sizes) - sizes)[number] + start
        spot = _spot(offset, count)
        del number, start, offset
        order = np.lexsort((doc, key ^ (content * _B)))
        both = (key ^ (content * _B))[order]
        first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
        least = np.empty(len(order), np.int64)  # the copy in the smallest document
        least[order] = np.repeat(order[first], np.diff(np.r_[first, len(order)]))
        del order, both, first
        later = np.flatnonzero((doc > doc[least]) & (count == count[least]))
        if len(later):
            later = later[_same_bytes(np.frombuffer(b"".join(texts), np.uint8), at[later], at[least[later]], count[later] + width - 1)]
            yield from _places(page[later], spot[later], _MATCHES, shards)
            stay = np.ones(len(key), bool)
            stay[later] = False
            page, doc, spot, key, content = page[stay], doc[stay], spot[stay], key[stay], content[stay]
        del at, count, least, later
        order = np.lexsort((content, key))
        page, doc, spot, key, content = page[order], doc[order], spot[order], key[order], content[order]
        group = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        new = np.r_[True, (key[1:] != key[:-1]) | (content[1:] != content[:-1])]
        hot = np.add.reduceat(new.astype(np.int64), group) >= HOT
        if hot.any():
            marks = key[group[hot]]
            shard = _shard_of(marks, shards)
            for a, e in _by(shard):
                yield batch_of(_SENT, shard=[int(shard[a])], kind=[_MARKS], page=[0], blob=[_packed(marks[a:e].view(np.int64))])
            split = np.repeat(hot, np.diff(np.r_[group, len(key)]))
            yield from _places(page[split], spot[split], _SPLIT, shards)
            page, doc, spot, key = page[~split], doc[~split], spot[~split], key[~split]
        shard = _shard_of(key, shards)
        for a, e in _by(shard):
            k = key[a:e]
            steps = np.r_[k[:1], np.diff(k)].view(np.int64)
            yield batch_of(_SENT, shard=[int(shard[a])], kind=[_RUNS], page=[0], blob=[_packed(steps, doc[a:e], page[a:e], spot[a:e])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, pages, ids, texts, n = [], [], [], [], 0
        for b in batches:
            for number, blob in zip(b.column("page").to_pylist(), b.column("blob"), strict=True):
                p = _Texts(_page(blob.as_buffer()))
                rows = []
                for i, t, base in zip(p.ids, p.texts, p.base.tolist(), strict=True):
                    if i is not None and len(t) >= width:
                        rows.append((len(ids), t))
                        ids.append(i)
                        pages.append((number, base))
                        texts.append(t)
                for x in runs(rows, width):
                    parts.append(list(x))
                    n += len(x[0])
                if n >= _FLUSH:
                    yield from flush(parts, pages, ids, texts)
                    parts, pages, ids, texts, n = [], [], [], [], 0
        if n:
            yield from flush(parts, pages, ids, texts)

    return run


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Lists of the rows of one shard, from rows sorted by shard."""
    held: list[dict] = []
    for b in batches:
        for row in b.to_pylist():
            if held and held[0]["shard"] != row["shard"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


_FOUND = pa.schema([("page", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])
_FOUND_SQL = "page long, kind int, blob binary"


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a shard finds for each page: matches, and runs whose bytes are wanted because several documents hold their key."""
    for rows in _by_shard(batches):
        through = [r for r in rows if r["kind"] in (_MATCHES, _SPLIT)]
        if through:
            yield batch_of(_FOUND, **{c: [r[c] for r in through] for c in ("page", "kind", "blob")})
        parts = [_unpacked([r["blob"]], 4) for r in rows if r["kind"] == _RUNS]
        if not parts:
            continue
        key = np.concatenate([np.cumsum(p[0].view(np.uint64), dtype=np.uint64) for p in parts])
        doc, page, spot = (np.concatenate([p[n] for p in parts]) for n in (1, 2, 3))
        marks = _unpacked([r["blob"] for r in rows if r["kind"] == _MARKS], 1)[0].view(np.uint64)
        order = np.argsort(key, kind="stable")
        key, doc, page, spot = key[order], doc[order], page[order], spot[order]
        group = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[group, len(key)])
        hot = np.isin(key[group], marks)
        shared = np.minimum.reduceat(doc, group) != np.maximum.reduceat(doc, group)
        for kind, chosen in ((_SPLIT, hot), (_RUNS, shared & ~hot)):
            some = np.repeat(chosen, sizes)
            k, p, s = key[some].view(np.int64), page[some], spot[some]
            order = np.argsort(p, kind="stable")
            k, p, s = k[order], p[order], s[order]
            ends = list(_by(p))
            for at in range(0, len(ends), 4096):
                few = ends[at : at + 4096]
                yield batch_of(_FOUND, page=[int(p[a]) for a, _ in few], kind=[kind] * len(few), blob=[_packed(s[a:e], k[a:e]) if kind == _RUNS else _packed(s[a:e]) for a, e in few])


_BYTES = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("page", pa.int64()), ("blob", pa.binary()), ("texts", pa.binary())])
_BYTES_SQL = "shard int, kind int, page long, blob binary, texts binary"


def _fetch(shards: int, width: int) -> Callable:
    """The wanted bytes of each page, by shard; copies within a task are settled here."""

    def flush(rows: list[tuple[int, int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda r: r[1])
        first: dict[tuple[int, bytes], int] = {}
        later = [r for r in rows if first.setdefault((r[0], r[4]), r[1]) < r[1]]
        if later:
            page, spot = np.array([r[2] for r in later]), np.array([r[3] for r in later])
            for b in _places(page, spot, _MATCHES, shards):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.binary())], schema=_BYTES)
        rows = [r for r in rows if first[r[0], r[4]] == r[1]]
        rows.sort(key=lambda r: r[0] & ((1 << 64) - 1))
        key, doc, page, spot = (np.array([r[n] for r in rows], np.int64) for n in range(4))
        shard = _shard_of(key.view(np.uint64), shards)
        coder = zstandard.ZstdCompressor(level=1)
        for a, e in _by(shard):
            yield batch_of(_BYTES, shard=[int(shard[a])], kind=[_RUNS], page=[0], blob=[_packed(key[a:e], doc[a:e], page[a:e], spot[a:e])], texts=[coder.compress(b"".join(r[4] for r in rows[a:e]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in slices(batches, 8):
            for number, blob, kinds, blobs in zip(b.column("page").to_pylist(), b.column("blob"), b.column("kinds").to_pylist(), b.column("blobs").to_pylist(), strict=True):
                p = _Texts(_page(blob.as_buffer()))
                whole = b"".join(p.texts)
                spot, key = _unpacked([x for k, x in zip(kinds, blobs, strict=True) if k == _RUNS], 2)
                owner = np.searchsorted(p.base, _offset(spot), side="right") - 1
                ends = _offset(spot) + _count(spot) + width - 1
                for k, s, o, a, e in zip(key.tolist(), spot.tolist(), owner.tolist(), _offset(spot).tolist(), ends.tolist(), strict=True):
                    rows.append((k, p.ids[o], number, s, whole[a:e]))
                size += int((ends - _offset(spot)).sum())
                spot = _unpacked([x for k, x in zip(kinds, blobs, strict=True) if k == _SPLIT], 1)[0]
                owner = np.searchsorted(p.base, _offset(spot), side="right") - 1
                for s, o in zip(spot.tolist(), owner.tolist(), strict=True):
                    for a in range(s >> _LEN_BITS, (s >> _LEN_BITS) + (s & ((1 << _LEN_BITS) - 1))):
                        t = whole[a : a + width]
                        k = xxhash.xxh64_intdigest(t)
                        rows.append((k - (1 << 64) if k >> 63 else k, p.ids[o], number, a << _LEN_BITS | 1, t))
                        size += width
                if size >= _FETCHED:
                    yield from flush(rows)
                    rows, size = [], 0
        if rows:
            yield from flush(rows)

    return run


def _copies(key: np.ndarray, doc: np.ndarray, texts: bytes, offsets: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which runs have all their bytes as a run of a smaller document, and which have a key with runs of other bytes."""
    by = np.lexsort((doc, key))
    docs, starts, ends = doc[by].tolist(), offsets[by].tolist(), (offsets[by] + lengths[by]).tolist()
    copy, differ = np.zeros(len(key), bool), np.zeros(len(key), bool)
    groups = [(a, e) for a, e in _by(key[by]) if e > a + 1]
    open_: list[tuple[int, int]] = []
    later: list[int] = []
    for at, to in groups:
        first: dict[bytes, int] = {}
        for i in range(at, to):
            if first.setdefault(texts[starts[i] : ends[i]], docs[i]) < docs[i]:
                later.append(i)
        if len(first) > 1:
            open_.append((at, to))
    copy[by[later]] = True
    for at, to in open_:
        differ[by[at:to]] = True
    return copy, differ


def _match(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdDecompressor()
        for rows in _by_shard(batches):
            through = [r for r in rows if r["kind"] == _MATCHES]
            if through:
                yield batch_of(_FOUND, **{c: [r[c] for r in through] for c in ("page", "kind", "blob")})
            rows = [r for r in rows if r["kind"] == _RUNS]
            if not rows:
                continue
            key, doc, page, spot = _unpacked([r["blob"] for r in rows], 4)
            texts = b"".join(coder.decompress(r["texts"]) for r in rows)
            counts = _count(spot)
            lengths = counts + width - 1
            offsets = np.cumsum(lengths) - lengths
            copy, differ = _copies(key, doc, texts, offsets, lengths)
            some = np.flatnonzero(differ & ~copy)
            some = some[np.argsort(key[some], kind="stable")]
            mine = b"".join([texts[a:e] for a, e in zip(offsets[some].tolist(), (offsets[some] + lengths[some]).tolist(), strict=True)])
            item, place = earlier_matches(key[some], doc[some], mine, counts[some], width)
            item = some[item]
            at = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1)]) if len(item) else item
            count = np.diff(np.r_[at, len(item)])
            found = np.r_[spot[copy], _spot(_offset(spot[item[at]]) + place[at], count)]
            of = np.r_[page[copy], page[item[at]]]
            if not len(found):
                continue
            order = np.argsort(of, kind="stable")
            found, of = found[order], of[order]
            ends = list(_by(of))
            yield batch_of(_FOUND, page=[int(of[a]) for a, _ in ends], kind=[_MATCHES] * len(ends), blob=[_packed(found[a:e]) for a, e in ends])

    return run


def spans_of(spots: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte spans that the matched runs cover."""
    start = _offset(spots)
    order = np.argsort(start)
    start = start[order]
    end = np.maximum.accumulate(start + _count(spots[order]) + width - 1)
    first = np.r_[True, start[1:] > end[:-1]]
    return start[first], end[np.r_[np.flatnonzero(first)[1:] - 1, len(end) - 1]]


def spans_by_text(p: _Texts, blobs: list[bytes] | None, width: int = WIDTH) -> Iterator[tuple[list[int], list[int]]]:
    """For each text of a page the starts and ends of its maximal removed spans."""
    spots = np.sort(_unpacked(blobs or [], 1)[0])
    edge = np.searchsorted(_offset(spots), np.r_[p.base, p.base[-1:] + p.sizes[-1:] + 1])
    for k, base in enumerate(p.base.tolist()):
        mine = spots[edge[k] : edge[k + 1]]
        yield tuple((x - base).tolist() for x in spans_of(mine, width)) if len(mine) else ([], [])


def without(text: bytes, starts: list[int], ends: list[int]) -> bytes:
    return b"".join(text[x:y] for x, y in zip([0, *ends], [*starts, len(text)], strict=True)) if starts else text


def matches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(page, blob, blobs): the pages of docs (first column a long id, one column text) with the packed places that have an earlier match."""
    n = parts_for(docs, "text")
    shards = 4 * n
    pages = _pages(docs, n)
    dealt = lambda df: df.repartition(n, "shard").sortWithinPartitions("shard")
    settled = stage_table(map_arrow(dealt(map_arrow(pages, _find_runs(shards, width), _SENT_SQL)), _settle, _FOUND_SQL), "runs")
    wanted = settled.where(F.col("kind") != _MATCHES).groupBy("page").agg(F.collect_list("kind").alias("kinds"), F.collect_list("blob").alias("blobs"))
    fetched = map_arrow(pages.join(wanted.hint("shuffle_hash"), "page"), _fetch(shards, width), _BYTES_SQL)
    later = map_arrow(dealt(fetched), _match(width), _FOUND_SQL)
    found = settled.where(F.col("kind") == _MATCHES).unionByName(later).groupBy("page").agg(F.collect_list("blob").alias("blobs"))
    return pages.join(found.hint("shuffle_hash"), "page", "left").select("blob", "blobs")


def deduplicate(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per document row: doc_id, n_bytes, kept (binary), starts and ends (arrays of the maximal removed byte spans).

    Null text is empty. A row with a null doc_id has no order: it keeps all its bytes and removes none elsewhere. Rows of one doc_id don't remove
    each other's bytes (neither is smaller). Texts shorter than ``width`` bytes stay whole, very long ones are cut like any other. Strings are judged on the input, not on what
    is left. Other columns of docs are not read. Empty: no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 8):
            for blob, blobs in zip(b.column("blob"), b.column("blobs").to_pylist(), strict=True):
                p = _Texts(_page(blob.as_buffer()))
                starts, ends = zip(*spans_by_text(p, blobs, width), strict=True)
                yield batch_of(schema, doc_id=p.ids, n_bytes=p.sizes, kept=list(map(without, p.texts, starts, ends)), starts=starts, ends=ends)

    found = matches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width)
    return map_arrow(found, cut, "doc_id long, n_bytes long, kept binary, starts array<long>, ends array<long>")


def cut_documents(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with what repeats earlier documents cut from text; n_chars, if it is there, follows. Columns and their order stay.

    A character that is cut in its middle goes. Rows of which nothing is left go; rows that were empty or null before stay. Null and repeated doc_ids and very long texts are as in
    deduplicate. Empty: no rows.
    """
    names = ["_cg_id", *("text" if c == "text" else f"c{k}" for k, c in enumerate(docs.columns))]
    plain = docs.select(F.col("doc_id").cast("long").alias("_cg_id"), *(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names[1:], strict=True)))
    text_at = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 8):
            for blob, blobs in zip(b.column("blob"), b.column("blobs").to_pylist(), strict=True):
                batch = _page(blob.as_buffer())
                p = _Texts(batch)
                texts, stay = [], []
                for t, null, (a, e) in zip(p.texts, p.nulls, spans_by_text(p, blobs, width), strict=True):
                    left = without(t, a, e).decode("utf-8", "ignore") if a else t.decode("utf-8", "replace")
                    texts.append(None if null else left)
                    stay.append(bool(left) or not a)
                columns = [pa.array(texts, c.type) if k == text_at else c for k, c in enumerate(batch.columns)][1:]
                yield pa.RecordBatch.from_arrays(columns, names[1:]).filter(pa.array(stay, pa.bool_()))

    kinds = {n: plain.schema[n].dataType.simpleString() for n in names[1:]}
    done = map_arrow(matches(plain, width), cut, ", ".join(f"{n} {k}" for n, k in kinds.items()))
    as_before = lambda f, n: F.length("text").cast(f.dataType) if f.name == "n_chars" else F.col(n)
    return done.select(*(as_before(f, n).alias(f.name) for f, n in zip(docs.schema, names[1:], strict=True)))


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
