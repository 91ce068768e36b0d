"""SimHash near-duplicate classes: fingerprints of word shingles, linked within a Hamming radius through sharded BK-trees.

Two 64-bit fingerprints that differ in at most two bits agree on at least two of their four 16-bit blocks. Every
distinct fingerprint therefore goes to six shards, one for each pair of blocks (32 fixed bits), and every link lies
inside a shard. A shard's BK-tree keeps children by their integer distance to the parent; a search follows only edges
within the radius. A shard of more than ``max_shard`` fingerprints is dealt anew by two of four 8-bit blocks of its
other 32 bits, which leaves at most 2**16 fingerprints in one tree. A tree yields a spanning star for each class
in it (one row a fingerprint at most), never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.llm.common import batch_of, has_repeats, map_arrow, parts_of, slices, stage_table, text_bytes
from corpusgraph.llm.components import connected_components

SEED = 42
RADIUS = 2
SHINGLE_WORDS = 3
_BLOCK = 1 << 16


def simhash64(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """Fingerprint of one UTF-8 text: A-Z lower-cased, words between ASCII white space, shingles with repeats."""
    ws = text.lower().split()
    if not ws:
        return 0
    shingles = [b" ".join(ws)] if len(ws) < words else map(b" ".join, zip(*(ws[i:] for i in range(words)), strict=False))
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), _BLOCK):
        ones += np.unpackbits(h[at : at + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, text_key, fp) of every row; null text is empty, its fingerprint zero. text_key tells rows of one doc_id apart."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            fp = np.array([simhash64(t, words) for t in text_bytes(b.column("text"))], np.uint64).view(np.int64)
            yield batch_of(schema, doc_id=b.column("doc_id"), text_key=b.column("text_key"), fp=fp)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text"), run, "doc_id long, text_key long, fp long")


class BKTree:
    """Children by their Hamming distance to the parent."""

    __slots__ = ("value", "children")

    def __init__(self) -> None:
        self.value: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int, radius: int) -> list[int]:
        """Inserts x; returns the nodes within radius that were there."""
        value, children, found = self.value, self.children, []
        new = len(value)
        if new:
            todo, at = [0], 0
            while True:  # the path of the insertion
                d = (value[at] ^ x).bit_count()
                nxt = children[at].get(d)
                if nxt is None:
                    break
                at = nxt
            while todo:
                i = todo.pop()
                d = (value[i] ^ x).bit_count()
                if d <= radius:
                    found.append(i)
                kids = children[i]
                if len(kids) > 2 * radius:
                    todo.extend(kids[e] for e in range(d - radius, d + radius + 1) if e in kids)
                else:
                    todo.extend(k for e, k in kids.items() if abs(e - d) <= radius)
            children[at][(value[at] ^ x).bit_count()] = new
        value.append(x)
        children.append({})
        return found


def linked(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """(value, least value of its class) of every value of a class of two or more; values are distinct and sorted."""
    root = list(range(len(values)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    if len(values) == 2:
        return [(values[1], values[0])] if (values[0] ^ values[1]).bit_count() <= radius else []
    tree = BKTree()
    for i, x in enumerate(values):
        for j in tree.add(x, radius):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [(values[i], values[r]) for i in range(len(values)) if (r := find(i)) != i]


def _signed(x) -> np.ndarray:
    return np.array(x, np.uint64).view(np.int64)


def _masks(bits: list[int], count: int) -> list[int]:
    """Masks of each pair of ``count`` equal blocks of the given bit positions."""
    step = len(bits) // count
    blocks = [sum(1 << b for b in bits[i * step : (i + 1) * step]) for i in range(count)]
    return [a | b for a, b in combinations(blocks, 2)]


_FIRST = _masks(list(range(64)), 4)


def _shards(max_shard: int | None):
    """Map over rows sorted by (shard, fp): links of each shard, or the rows of a larger one with their next shard."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("mask", pa.int64()), ("shard", pa.int64())])

    def done(mask: int, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        if max_shard is not None and len(values) > max_shard:
            free = [b for b in range(64) if not mask >> b & 1]
            for more in _masks(free, 4):
                m = np.uint64(mask | more)
                yield batch_of(schema, a=values.view(np.int64), b=pa.nulls(len(values), pa.int64()), mask=np.full(len(values), m).view(np.int64), shard=(values & m).view(np.int64))
        elif found := linked(values.tolist()):
            a, b = zip(*found, strict=True)
            yield batch_of(schema, a=_signed(a), b=_signed(b), mask=np.zeros(len(a), np.int64), shard=np.zeros(len(a), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            mask, shard, fp = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("mask", "shard", "fp"))
            cut = np.flatnonzero((mask[1:] != mask[:-1]) | (shard[1:] != shard[:-1])) + 1
            starts, ends = np.r_[0, cut], np.r_[cut, len(fp)]
            if last == (mask[0], shard[0]):
                held.append(fp[: ends[0]])
                starts, ends = starts[1:], ends[1:]
            if not len(starts):
                continue
            if held:
                yield from done(int(last[0]), np.concatenate(held))
            for k in np.flatnonzero(ends[:-1] - starts[:-1] > 1):
                yield from done(int(mask[starts[k]]), fp[starts[k] : ends[k]])
            last, held = (mask[starts[-1]], shard[starts[-1]]), [fp[starts[-1] :]]
        if held:
            yield from done(int(last[0]), np.concatenate(held))

    return run


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, "mask", "shard").sortWithinPartitions("mask", "shard", "fp")


def links(distinct_fps: DataFrame, max_shard: int = 4096) -> DataFrame:
    """(a, b): links between different fingerprints that connect whatever chains of distance RADIUS or less connect."""
    as_long = lambda m: m - (1 << 64) if m >> 63 else m
    keyed = distinct_fps.select("fp", F.explode(F.array(*(F.lit(as_long(m)).cast("long") for m in _FIRST))).alias("mask"))
    keyed = keyed.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("shard"), "fp")
    schema = "a long, b long, mask long, shard long"
    parts = parts_of(distinct_fps, 24 * len(_FIRST))
    first = stage_table(map_arrow(_dealt(keyed, parts), _shards(max_shard), schema), "shards")
    over = first.where("b is null").select("mask", "shard", F.col("a").alias("fp"))
    second = map_arrow(_dealt(over, parts), _shards(None), schema)
    return first.where("b is not null").select("a", "b").unionByName(second.select("a", "b"))


def near_duplicate_classes(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per document row: doc_id, text_key, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links. Null text: fingerprint zero, linked like any other; equal
    fingerprints are linked. Rows with a null doc_id keep their row and take the class's smallest doc_id (null if there
    is none). Very long texts are read whole, their shingles in blocks. Repeated doc_ids: one output row a row. Other columns of docs, whatever their names, are not read. Empty: no rows.
    """
    fps = stage_table(fingerprints(docs, words), "fps")
    firsts = stage_table(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fp")
    comps = connected_components(links(firsts.select("fp")))
    rooted = firsts.join(comps, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    tops = rooted.where("root <> fp").groupBy("root").agg(F.min("first_id").alias("least"))
    tops = tops.join(firsts.select(F.col("fp").alias("root"), "first_id"), "root").select("root", F.least("least", "first_id").alias("component_id"))
    moved = rooted.join(tops, "root").select(F.col("fp").alias("k"), "component_id")
    named = firsts.join(moved, F.col("fp") == F.col("k"), "left").select(F.col("fp").alias("k"), F.coalesce("component_id", "first_id").alias("component_id"))
    out = fps.join(named, F.col("fp") == F.col("k"))
    return out.select("doc_id", "text_key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


BANDS = 16  # pairs of min-hashes; texts of similarity 0.8 share none of them once in ten million
BINS = 512  # of a sketch: its similarity has a standard deviation of 0.018 at most
MARGIN = 0.06  # nearer to the wanted similarity than this, exact sets decide instead of sketches
HOT = 8_000  # nodes of a shard; larger ones are dealt out, their leaders meet, then parts of different classes meet in pairs
SETTLED = 512  # doubtful nodes of a shard whose sets one task compares
PEEK = 64  # bins of a sketch that are looked at first
_RNG = np.random.default_rng(8)
_MUL = _RNG.integers(0, 1 << 63, 2 * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, 2 * BANDS, dtype=np.uint64)


def sketch_of(u: np.ndarray) -> bytes:
    """One byte for each of BINS ranges of hashes: 0 if it is empty, else 1 to 255 from its least hash. u: sorted distinct hashes."""
    out = np.zeros(BINS, np.uint8)
    if len(u):
        bins = (u >> np.uint64(64 - 9)).astype(np.int64)
        first = np.r_[0, np.flatnonzero(bins[1:] != bins[:-1]) + 1]
        out[bins[first]] = (u[first] & np.uint64(0xFFFF)) % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def _bins(many: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins that are full and equal in rows of ``many`` and in ``one``, and bins that are full in either; eight are counted at once."""
    any_ = (many | one) > 0
    same = (many == one) & any_
    return tuple(np.bitwise_count(x.view(np.uint64)).sum(1, dtype=np.int64) for x in (same, any_))


def similarities(many: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Jaccard similarities of shingle sets from their sketches: rows of ``many`` with ``one``."""
    same, any_ = _bins(many, one)
    return np.where(any_ == 0, 1.0, np.maximum(0.0, (same / np.maximum(any_, 1) - 1 / 255) / (1 - 1 / 255)))


def _shingle_hashes(text: bytes, words: int) -> np.ndarray:
    ws = text.lower().split()
    shingles = ([b" ".join(ws)] if ws else []) if len(ws) < words else map(b" ".join, zip(*(ws[i:] for i in range(words)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64)


def _signature(text: bytes, words: int) -> tuple[int, int, list[int], bytes]:
    h = _shingle_hashes(text, words)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), _BLOCK):
        ones += np.unpackbits(h[at : at + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    fp = int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0]) if len(h) else 0
    u = np.unique(h)
    least = np.full(2 * BANDS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(u), 8192):
        least = np.minimum(least, (u[None, at : at + 8192] * _MUL[:, None] + _ADD[:, None]).min(1))
    node = xxhash.xxh64_intdigest(u.tobytes(), SEED)
    pairs = least.view(np.uint8).reshape(BANDS, 16)
    keys = [xxhash.xxh64_intdigest(pairs[k].tobytes(), k) for k in range(BANDS)]
    return fp, node, keys, sketch_of(u)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("fp", pa.int64()), ("node", pa.int64()), ("keys", pa.list_(pa.int64())), ("sketch", pa.binary())])


def _signatures(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            rows = [_signature(t, words) for t in text_bytes(b.column("text"))]
            fp, node, keys, sketch = zip(*rows, strict=True)
            yield batch_of(_SIGNED, doc_id=b.column("doc_id"), text_key=b.column("text_key"), fp=fp, node=_signed(node), keys=list(_signed(keys)), sketch=sketch)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text"), run, "doc_id long, text_key long, fp long, node long, keys array<long>, sketch binary")


class Rows:
    """Growing arrays of numbers, the least similarity wanted of each, and the first PEEK bins of their sketches."""

    __slots__ = ("number", "floor", "part", "size")

    def __init__(self) -> None:
        self.number, self.floor, self.part, self.size = np.zeros(4, np.int64), np.zeros(4), np.zeros((4, PEEK), np.uint8), 0

    def add(self, number: int, floor: float, sketch: np.ndarray) -> None:
        if self.size == len(self.number):
            self.number, self.floor, self.part = (np.concatenate([x, np.zeros_like(x)]) for x in (self.number, self.floor, self.part))
        self.number[self.size], self.floor[self.size], self.part[self.size] = number, floor, sketch[:PEEK]
        self.size += 1

    def similar(self, sketches: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, similarities) of those that reach their floor; a look at a part of the sketches comes first."""
        number, floor = self.number[: self.size], self.floor[: self.size]
        if self.size > 8:
            same, any_ = _bins(self.part[: self.size], sketches[i, :PEEK])
            near = np.flatnonzero((any_ < 24) | (same >= (floor - 0.4) * any_))
            number, floor = number[near], floor[near]
        if not len(number):
            return number, floor
        s = similarities(sketches[number], sketches[i])
        keep = s >= floor
        return number[keep], s[keep]


class Classes:
    """Disjoint sets of numbers."""

    __slots__ = ("up",)

    def __init__(self, size: int) -> None:
        self.up = list(range(size))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def unite(self, a: int, b: int) -> bool:
        x, y = self.find(a), self.find(b)
        self.up[max(x, y)] = min(x, y)
        return x != y


def leader_links(sketches: np.ndarray, least: float, roots: list[int] | None = None) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """(links, doubtful nodes, leaders) of a shard's nodes in order; sketches has a row for each. Nodes of equal roots are one class from the start.

    A node that is surely similar to a leader joins it; one that is not, but to a member of a leader, is linked to the member and leads itself. As members
    are within ``least`` of their leader, the leader of a similar member isn't far off (distances of sets add up), and only such leaders' members are
    looked at. Pairs at the threshold are doubtful; a node that has only such links leads itself, so that no sure link is hidden by them. Both nodes of
    every doubtful pair between classes are given, so that their sets can decide each such pair and no list is longer than the shard.
    """
    every = Rows()  # all leaders
    leaders: list[int] = []
    members: dict[int, Rows] = {}
    followed = np.zeros(len(sketches), bool)  # leaders with members
    classes = Classes(len(sketches))
    find = classes.find
    first: dict[int, int] = {}
    for i, r in enumerate(roots or ()):
        classes.unite(first.setdefault(r, i), i)
    links: list[tuple[int, int]] = []
    doubtful = np.zeros(len(sketches), bool)

    def join(a: int, b: int) -> None:
        if classes.unite(a, b):
            links.append((a, b))

    sure, low = least + MARGIN, least - MARGIN
    far = max(0.0, 2 * least - 1) - MARGIN
    place: dict[int, int] = {}  # of a leader among all

    for i in range(len(sketches)):
        home = -1
        numbers, values = every.similar(sketches, i)
        for j in numbers[values >= sure].tolist():
            join(j, i)
            home = j if home < 0 else home
        maybe = [numbers[values >= low]]
        for j in numbers[followed[numbers]].tolist():
            if find(j) != find(i):
                close, t = members[j].similar(sketches, i)
                if len(t) and t.max() >= sure:
                    join(int(close[t.argmax()]), i)
                else:
                    maybe.append(close)
        near = np.concatenate(maybe)
        if any(find(j) != find(i) for j in near.tolist()):
            doubtful[i] = True
            doubtful[[j for j in near[~doubtful[near]].tolist() if find(j) != find(i)]] = True
        if home >= 0:
            if home not in members:
                members[home], followed[home] = Rows(), True
                every.floor[place[home]] = far
            members[home].add(i, low, sketches[i])
        else:
            place[i] = every.size
            every.add(i, low, sketches[i])
            leaders.append(i)
    return links, np.flatnonzero(doubtful).tolist(), leaders


def _linked_shards(least: float):
    """Rows sorted by (key, salt, first_id): links between nodes (kind 0), nodes of doubtful pairs (1), and the leaders of shards that were dealt out (2).

    Links are between the nodes' roots where these are given. The doubtful of a shard that was dealt out are left to the blocks of its parts.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("kind", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> Iterator[pa.RecordBatch]:
            if len(held) > 1 or held and held[0][2] > 1:
                nodes, key = [r[3] for r in held], held[0][0]
                roots = None if held[0][5] is None else [r[5] for r in held]
                names = roots or nodes
                links, doubtful, leaders = leader_links(np.frombuffer(b"".join(r[4] for r in held), np.uint8).reshape(-1, BINS), least, roots)
                rows = [(names[i], names[j], key, 0) for i, j in links]
                rows += [(nodes[i], nodes[i], key, 1) for i in doubtful] if held[0][2] == 1 else []
                rows += [(nodes[i], nodes[i], key, 2) for i in leaders] if held[0][2] > 1 else []
                if rows:
                    yield batch_of(schema, **dict(zip(("a", "b", "key", "kind"), zip(*rows, strict=True), strict=True)))

        for b in slices(batches, 4096):
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "salt", "salts", "node", "sketch", "root")), strict=True):
                if held and held[0][:2] != row[:2]:
                    yield from done()
                    held.clear()
                held.append(row)
        yield from done()

    return run


def exact_links(roots: list[int], sketches: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links between a shard's nodes of different roots whose sets (sorted distinct hashes) are similar enough: a pair is left out only if links already connect it
    or its sketches tell that it is surely not similar."""
    first: dict[int, int] = {}
    classes = Classes(len(roots))
    for i, r in enumerate(roots):
        classes.unite(first.setdefault(r, i), i)
    links = []
    for i in range(1, len(roots)):
        s = similarities(sketches[:i], sketches[i])
        near = np.flatnonzero(s >= least - MARGIN)
        todo = near[np.argsort(-s[near], kind="stable")].tolist()
        size = 1
        while todo := [j for j in todo if classes.find(j) != classes.find(i)]:
            some, todo = todo[:size], todo[size:]
            size = min(64, 2 * size)
            many = np.concatenate([sets[j] for j in some])
            lengths = np.array([len(sets[j]) for j in some])
            same = np.zeros(len(some), np.int64)
            if len(sets[i]) and len(many):
                hit = sets[i][np.minimum(np.searchsorted(sets[i], many), len(sets[i]) - 1)] == many
                same = np.diff(np.r_[0, np.cumsum(hit)][np.r_[0, np.cumsum(lengths)]])
            for k in np.flatnonzero(same >= least * (lengths + len(sets[i]) - same) - 1e-9):
                if classes.unite(some[k], i):
                    links.append((some[k], i))
    return links


def _settled_shards(least: float):
    """Rows sorted by key: links between the roots of nodes, by their sets."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                roots = [r[1] for r in held]
                found = exact_links(roots, np.frombuffer(b"".join(r[2] for r in held), np.uint8).reshape(-1, BINS), [np.frombuffer(r[3], np.uint64) for r in held], least)
                if found:
                    yield batch_of(schema, a=[roots[i] for i, _ in found], b=[roots[j] for _, j in found])

        for b in slices(batches, 512):
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "root", "sketch", "hashes")), strict=True):
                if held and held[0][0] != row[0]:
                    yield from done()
                    held.clear()
                held.append(row)
        yield from done()

    return run


def _settled(docs: DataFrame, nodes: DataFrame, marks: DataFrame, rooted: DataFrame, words: int, least: float, parts: int, most: int) -> DataFrame:
    """(a, b): links between roots, from the sets of the doubtful nodes (node, key) that share a key; keys of more than ``most`` nodes are dealt out. Only the texts of these nodes are read in full."""
    marks = marks.distinct().join(rooted.select("node", "root"), "node")
    open_ = marks.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    marks = stage_table(marks.join(open_, "key", "left_semi").select("key", "node", "root"), "doubtful")
    large = marks.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > most).select("key")
    if large.limit(1).count():  # families at the threshold: their pairs are tried in blocks, as those of large shards are
        dealt = _blocks(marks.join(large, "key"), max(1, most // 2)).select("key", "node", "root")
        marks = stage_table(marks.join(large, "key", "left_anti").unionByName(dealt), "doubtful")
    wanted = nodes.select("node", "k").join(marks.select("node").distinct(), "node", "left_semi")  # one text of each node
    texts = docs.select(F.xxhash64("text").alias("k"), "text").join(wanted, "k").select("node", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.int64()), ("hashes", pa.binary())])
        for b in slices(batches, 512):
            yield batch_of(schema, node=b.column("node"), hashes=[np.unique(_shingle_hashes(t, words)).tobytes() for t in text_bytes(b.column("text"))])

    every = map_arrow(texts, sets, "node long, hashes binary").groupBy("node").agg(F.first("hashes").alias("hashes"))
    full = marks.join(nodes.select("node", "first_id", "sketch").join(every, "node"), "node").select("key", "first_id", "node", "root", "sketch", "hashes")
    return map_arrow(full.repartition(parts, "key").sortWithinPartitions("key", "first_id", "node"), _settled_shards(least), "a long, b long")


def _blocks(rows: DataFrame, half: int) -> DataFrame:
    """Rows (key, node, root) of large shards, once for each block of two parts of a shard (key is then the block).

    A class of more than ``half`` nodes has parts of its own, others share parts; every two parts meet, but for those of one and the same class. So a large class costs
    rows in proportion to what isn't in it, and no pair of different classes is left out.
    """
    sizes = rows.groupBy("key", "root").agg(F.count("*").alias("c"))
    mixed = sizes.where(F.col("c") <= half).groupBy("key").agg(F.sum("c").alias("m"))
    own = F.col("c") > half
    salt = F.when(own, F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / half))).otherwise(F.pmod(F.xxhash64("root", "key"), F.ceil(F.col("m") / half)))
    dealt = sizes.join(mixed, "key", "left").select("key", "root", "c", "m")
    dealt = rows.join(dealt, ["key", "root"]).select("key", "node", "root", F.when(own, F.col("root")).alias("owner"), salt.alias("part_salt"))
    dealt = stage_table(dealt.withColumn("part", F.xxhash64(F.coalesce("owner", F.lit(0)), F.col("owner").isNull(), "part_salt")), "parts")
    parts = dealt.select("key", "part", "owner").distinct()
    other = parts.select(F.col("key").alias("k"), F.col("part").alias("q"), F.col("owner").alias("q_owner"))
    differ = F.col("owner").isNull() | F.col("q_owner").isNull() | (F.col("owner") != F.col("q_owner"))
    pairs = parts.join(other, (F.col("key") == F.col("k")) & (F.col("part") <= F.col("q")) & differ).withColumn("block", F.xxhash64("key", "part", "q"))
    pairs = pairs.select("key", "block", F.explode(F.array_distinct(F.array("part", "q"))).alias("part"))
    out = dealt.join(pairs, ["key", "part"]).select(F.col("block").alias("key"), "node", "root")
    return out.withColumn("salt", F.lit(0)).withColumn("salts", F.lit(1))


def _rooted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, first_id, root) with the roots that edges (a, b) between roots connect made one."""
    comps = connected_components(edges).select(F.col("node").alias("_cg_node"), F.col("root").alias("top"))
    return nodes.join(comps, F.col("root") == F.col("_cg_node"), "left").select("node", "first_id", F.coalesce("top", "root").alias("root"))


def similar_classes(docs: DataFrame, words: int = 5, similarity: float = 0.8, hot: int = HOT) -> DataFrame:
    """One row per document row: doc_id, text_key, fingerprint, component_id; texts link at a Jaccard similarity of their shingle sets of ``similarity`` or more.

    Texts of one shingle set are one node. Nodes that share a pair of min-hashes meet in a shard, where sketches find
    candidates among leaders and their members, and decide clear cases and the sets themselves, brought to the shard, every pair between classes within MARGIN of the threshold. A shard above ``hot`` nodes is dealt out by the nodes' hash,
    its parts' leaders meet in a second round under two pairs of min-hashes, and then all its nodes of different classes in blocks. Nulls, repeats and empty texts are as in near_duplicate_classes; all texts without words are one class.
    """
    signed = stage_table(_signatures(docs, words), "signatures")
    nodes = stage_table(signed.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("text_key").alias("k"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), "nodes")
    schema = "a long, b long, key long, kind int"
    n = parts_of(nodes, BANDS * (BINS + 64))

    def searched(rows: DataFrame) -> DataFrame:
        full = rows.join(nodes.select("node", "first_id", "sketch"), "node").select("key", "salt", "salts", "node", "first_id", "sketch", "root")
        return map_arrow(full.repartition(n, "key", "salt").sortWithinPartitions("key", "salt", "first_id", "node"), _linked_shards(similarity), schema)

    def meeting(keyed: DataFrame, most: int) -> DataFrame:
        """Links within the keys that several nodes share; keys of more than ``most`` nodes are dealt out."""
        shared = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
        shared = shared.select("key", F.ceil(F.col("c") / most).cast("int").alias("salts"))
        rows = keyed.join(shared, "key").withColumn("salt", F.pmod(F.xxhash64("node", "key"), F.col("salts")).cast("int"))
        return searched(rows.withColumn("root", F.lit(None).cast("long")))

    keyed = nodes.select("node", F.explode("keys").alias("key")).distinct()
    first = stage_table(meeting(keyed, hot), "shards")
    # leaders of parts of a large shard meet where they also share another pair of min-hashes: this only makes large classes one before blocks are searched
    leaders = first.where("kind = 2").select(F.col("a").alias("node"), F.col("key").alias("large")).join(nodes.select("node", "keys"), "node")
    leaders = leaders.select("node", "large", F.explode("keys").alias("other")).where("large <> other").select("node", F.xxhash64("large", "other").alias("key")).distinct()
    links_ = stage_table(first.where("kind < 2").unionByName(meeting(leaders, hot).where("kind < 2")), "links")
    rooted = stage_table(_rooted(nodes.select("node", "first_id", F.col("node").alias("root")), links_.where("kind = 0").select("a", "b")), "roots")
    marks = links_.where("kind = 1").select(F.col("a").alias("node"), "key")
    over = keyed.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("key")
    if over.limit(1).count():
        blocks = stage_table(searched(_blocks(keyed.join(over, "key").join(rooted.select("node", "root"), "node"), max(1, hot // 2))), "blocks")
        rooted = stage_table(_rooted(rooted, blocks.where("kind = 0").select("a", "b")), "roots")
        marks = marks.unionByName(blocks.where("kind = 1").select(F.col("a").alias("node"), "key"))
    rooted = _rooted(rooted, _settled(docs, nodes, marks, rooted, words, similarity, n, min(hot, SETTLED)))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("node").alias("k"), "component_id")
    out = signed.select("doc_id", "text_key", "fp", "node").join(named, F.col("node") == F.col("k"))
    return out.select("doc_id", "text_key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first_of_class(docs: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """docs without all but one row of each near-duplicate class: the row of the smallest doc_id stays.

    classes: what near_duplicate_classes (the default) or similar_classes gives for docs. Columns and their order stay. A class without any doc_id keeps the row of its smallest text hash; of rows alike in doc_id
    and text one stays, of rows that share doc_id and class but not text that of the smaller text hash.
    """
    repeated = has_repeats(docs, "doc_id")
    classes = near_duplicate_classes(docs) if classes is None else classes
    keep = classes.where("doc_id = component_id or component_id is null")
    if repeated:
        group = F.when(F.col("component_id").isNull(), F.col("fingerprint"))
        keep = keep.groupBy("component_id", group.alias("g"), "doc_id").agg(F.min("text_key").alias("text_key"))
    keep = keep.select(F.col("doc_id").alias("_cg_id"), F.col("text_key").alias("_cg_key"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_cg_id")) & (F.xxhash64("text") == F.col("_cg_key"))
    out = docs.join(keep, same, "left_semi")
    if repeated:
        w = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.monotonically_increasing_id())
        out = out.withColumn("_cg_rn", F.row_number().over(w)).where("_cg_rn = 1").drop("_cg_rn")
    return out
