"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of immutable segments, each over the words of a bounded run of documents: its terms, and for every
term the ascending positions at which it stands (as differences). Documents are apart by more positions than a
window has words, so no match crosses them. A search takes the windows of the test items in blocks of bounded size, each broadcast and let go before the next; in each segment a
window starts from the postings of its rarest term there, shifted by the term's place, and intersects them with those of the next
rarest term, until all terms have agreed. Segments are independent: no shuffle, and frequent words or passages skew nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import Growing, batch_of, map_arrow, slices, stage_table, text_bytes

WINDOW = 10
SEGMENT_BYTES = 8 << 20
BLOCK_WORDS = 2_000_000  # words of test items in one broadcast block
#: A-Z to a-z; every other ASCII byte but digits and letters is a gap between words
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


_SEGMENT = pa.schema([("segment", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("text_keys", pa.list_(pa.int64())), ("starts", pa.binary()), ("lengths", pa.binary()), ("terms", pa.binary()), ("counts", pa.binary()), ("gaps", pa.binary())])
_SEGMENT_SQL = "segment long, doc_ids array<long>, text_keys array<long>, starts binary, lengths binary, terms binary, counts binary, gaps binary"


def build_segments(docs: DataFrame, window: int = WINDOW, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The stored index of every row of docs (doc_id may be null or repeated; null text has no words)."""

    def segment(rows: list[tuple], number: int) -> pa.RecordBatch:
        words: list[bytes] = []
        lengths = []
        for _, _, ws in rows:
            words += ws
            lengths.append(len(ws))
        index = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids = np.fromiter(map(index.__getitem__, words), np.int32, len(words))
        lengths = np.array(lengths, np.int64)
        place = np.arange(len(rows), dtype=np.int64) * window
        starts = np.cumsum(lengths) - lengths + place
        positions = np.arange(len(words), dtype=np.int64) + np.repeat(place, lengths)
        order = np.argsort(ids, kind="stable")
        gaps = np.diff(positions[order], prepend=0).astype(np.int64)
        if len(gaps) == 0 or max(gaps.max(), -gaps.min()) < 1 << 31:
            gaps = gaps.astype(np.int32)
        return batch_of(_SEGMENT, segment=[number], doc_ids=[[r[0] for r in rows]], text_keys=[[r[1] for r in rows]], starts=[starts.tobytes()], lengths=[lengths.tobytes()], terms=[b" ".join(index)], counts=[np.bincount(ids, minlength=len(index)).astype(np.int64).tobytes()], gaps=[gaps.tobytes()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, number = [], 0, 0
        for b in slices(batches, 512):
            first = b.column("row")[0].as_py() if b.num_rows else 0
            for i, k, t in zip(b.column("doc_id").to_pylist(), b.column("text_key").to_pylist(), text_bytes(b.column("text")), strict=True):
                if not rows:
                    number = first
                rows.append((i, k, words_of(t)))
                first += 1
                size += len(t)
                if size >= segment_bytes:
                    yield segment(rows, number)
                    rows, size = [], 0
        if rows:
            yield segment(rows, number)

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text", F.monotonically_increasing_id().alias("row"))
    return stage_table(map_arrow(base, run, _SEGMENT_SQL), "postings")


class Segment:
    """One row of the index in memory."""

    def __init__(self, row: dict) -> None:
        self.doc_ids, self.text_keys = row["doc_ids"], row["text_keys"]
        self.starts, self.lengths = (np.frombuffer(row[n], np.int64) for n in ("starts", "lengths"))
        terms = row["terms"].split(b" ") if row["terms"] else []
        self.term = {t: i for i, t in enumerate(terms)}
        self.counts = np.frombuffer(row["counts"], np.int64)
        gaps = np.frombuffer(row["gaps"], np.int32 if len(row["gaps"]) == 4 * self.counts.sum() else np.int64)
        self.positions = np.cumsum(gaps, dtype=np.int64)
        self.size = int(self.starts[-1] + self.lengths[-1]) + 1 if len(self.starts) else 1
        self.first = np.cumsum(self.counts) - self.counts
        self.keys = np.repeat(np.arange(len(terms), dtype=np.int64), self.counts) * self.size + self.positions

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.first[term] : self.first[term] + self.counts[term]]

    def phrases(self, local: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact occurrences (phrase, start) of rows of local term numbers; -1: a term that isn't here, -2: past the end."""
        alive = np.flatnonzero((local != -1).all(1) & (local[:, 0] != -2))
        if not len(alive):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        terms = local[alive]
        df = np.where(terms == -2, np.iinfo(np.int64).max, self.counts[np.maximum(terms, 0)])
        rare = np.argsort(df, axis=1, kind="stable")
        at = np.arange(len(alive))
        t = terms[at, rare[:, 0]]
        n = self.counts[t]
        phrase = np.repeat(at, n)
        index = np.repeat(self.first[t] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        start = self.positions[index] - rare[phrase, 0]
        ok = start >= 0
        phrase, start = phrase[ok], start[ok]
        for step in range(1, terms.shape[1]):
            if not len(phrase):
                break
            column = rare[phrase, step]
            t = terms[phrase, column]
            key = t * self.size + start + column
            found = np.searchsorted(self.keys, key)
            ok = (t == -2) | (self.keys[np.minimum(found, len(self.keys) - 1)] == key) & (start + column < self.size)
            phrase, start = phrase[ok], start[ok]
        return alive[phrase], start

    def near(self, terms: list[int], span: int) -> list[int]:
        """Starts of the minimal stretches, each in one document, of at most ``span`` words that hold all the given terms, in any order."""
        wanted: dict[int, int] = {}
        for t in terms:
            wanted[t] = wanted.get(t, 0) + 1
        if not wanted or -1 in wanted:
            return []
        rare = min(wanted, key=lambda t: self.counts[t])
        around = self.postings(rare)
        spots = []
        for t in wanted:
            p = self.postings(t)
            near = np.searchsorted(around, p - span + 1) < np.searchsorted(around, p + span)  # within reach of the rarest term
            spots += [(int(x), t) for x in p[near]]
        spots.sort()
        have = dict.fromkeys(wanted, 0)
        found, left, missing = [], 0, len(terms)
        for x, t in spots:
            have[t] += 1
            missing -= have[t] <= wanted[t]
            while have[spots[left][1]] > wanted[spots[left][1]]:
                have[spots[left][1]] -= 1
                left += 1
            if not missing and x - spots[left][0] < span:
                found.append((spots[left][0], x))
        first, last = np.array(found, np.int64).reshape(-1, 2).T
        return list(dict.fromkeys(first[self.owners(first) == self.owners(last)].tolist()))

    def owners(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1


class Block:
    """Windows of some test items: distinct rows of term numbers, and the items of each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        rows: dict[tuple[int, ...], set[int]] = {}
        self.items = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.items)}
        for i, text in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text))
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                rows.setdefault(ids[at : at + window], set()).add(number[i])
        self.rows = np.array([r + (-2,) * (window - len(r)) for r in rows], np.int64).reshape(-1, window)
        self.owner = [np.array(sorted(x), np.int64) for x in rows.values()]
        self.length = np.array([len(r) for r in rows], np.int64)

    def local(self, segment: Segment) -> np.ndarray:
        here = np.array([segment.term.get(w, -1) for w in self.vocabulary] + [-2], np.int64)
        return here[np.where(self.rows == -2, len(here) - 1, self.rows)]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, e in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((a, e))
    return out


_HITS = pa.schema([("segment", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
_HITS_SQL = "segment long, row long, doc_id long, text_key long, n_words long, starts array<long>, ends array<long>, items array<string>"


def _search(block) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        for batch in slices(batches, 1):
            for row in batch.to_pylist():
                s = Segment(row)
                n = len(s.starts)
                phrase, start = s.phrases(b.local(s)) if len(b.rows) else (np.zeros(0, np.int64),) * 2
                starts, ends, items = [[] for _ in range(n)], [[] for _ in range(n)], [[] for _ in range(n)]
                if len(phrase):
                    change = np.zeros(s.size + int(b.length.max()) + 1, np.int64)
                    np.add.at(change, start, 1)
                    np.add.at(change, start + b.length[phrase], -1)
                    on = np.r_[False, np.cumsum(change) > 0]
                    edge = np.flatnonzero(on[1:] != on[:-1])
                    owner = s.owners(edge[::2])
                    for o, a, e in zip(owner.tolist(), edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                        starts[o].append(a - int(s.starts[o]))
                        ends[o].append(e - int(s.starts[o]))
                    pairs = np.unique(np.stack([s.owners(start), phrase]), axis=1)
                    sets: dict[int, set[int]] = {}
                    for o, p in zip(*pairs.tolist(), strict=True):
                        sets.setdefault(o, set()).update(b.owner[p].tolist())
                    for o, x in sets.items():
                        items[o] = [b.items[k] for k in sorted(x)]
                yield batch_of(_HITS, segment=[row["segment"]] * n, row=range(n), doc_id=row["doc_ids"], text_key=row["text_keys"], n_words=s.lengths, starts=starts, ends=ends, items=items)

    return run


def blocks_of(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> tuple[int, Iterator[Block]]:
    """How many blocks of test items there are, and each in turn, of about block_words words at most; an item goes to the block of its id's hash. Items without id take no part."""
    base = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where("item_id is not null")
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // (6 * block_words)))
    parts = (base if n == 1 else base.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) for k in range(n))
    return n, (Block([(r.item_id, r.text.encode()) for r in part.collect()], window) for part in parts)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, segments: DataFrame | None = None) -> DataFrame:
    """One row per document row: doc_id, text_key, n_words, starts and ends (word spans hit, merged), items (ids as strings, sorted, distinct).

    A window is ``window`` consecutive words of an item, or all of a shorter item's words. Null or empty texts have no words. Repeated or null
    doc_ids: one row each. Very long texts have segments of their own. Items without words or id are never hit; items of one id count once. Other columns aren't read. Empty
    documents: no rows; empty benchmark: no hits. ``segments``: an index that build_segments made before, used instead of docs.
    """
    segments = build_segments(docs, window) if segments is None else segments
    spark = segments.sparkSession
    n, blocks = blocks_of(benchmark, window, block_words)
    if n == 1:
        return map_arrow(segments, _search(spark.sparkContext.broadcast(next(blocks))), _HITS_SQL).select("doc_id", "text_key", "n_words", "starts", "ends", "items")
    every = Growing(spark, "hits")
    for k, block in enumerate(blocks):
        shared = spark.sparkContext.broadcast(block)
        hits = map_arrow(segments, _search(shared), _HITS_SQL)
        every.append(hits.where("size(starts) > 0") if k else hits)  # the first block's rows stand for all documents
        shared.destroy()
    found = every.read()
    found = found.groupBy("segment", "row").agg(F.first("doc_id").alias("doc_id"), F.first("text_key").alias("text_key"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            spans = [_merged(list(zip(a, e, strict=True))) for a, e in zip(b.column("starts").to_pylist(), b.column("ends").to_pylist(), strict=True)]
            yield batch_of(pa.schema([f for f in _HITS if f.name not in ("segment", "row")]), starts=[[a for a, _ in x] for x in spans], ends=[[e for _, e in x] for x in spans], **{n: b.column(n) for n in ("doc_id", "text_key", "n_words", "items")})

    return map_arrow(found.select("doc_id", "text_key", "n_words", "starts", "ends", "items"), merge, "doc_id long, text_key long, n_words long, starts array<long>, ends array<long>, items array<string>")


def phrase_matches(segments: DataFrame, phrases: list[str], span: int = 0) -> DataFrame:
    """(phrase, doc_id, start): exact occurrences of phrases of any length, or with span > 0 the stretches of at most span words with all their words."""
    texts = [words_of(p.encode()) for p in phrases]
    schema = pa.schema([("phrase", pa.string()), ("doc_id", pa.int64()), ("start", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for row in batch.to_pylist():
                s = Segment(row)
                out = []
                for name, ws in zip(phrases, texts, strict=True):
                    ids = [s.term.get(w, -1) for w in ws]
                    if not ids:
                        continue
                    hits = np.array(s.near(ids, span), np.int64) if span else s.phrases(np.array([ids], np.int64))[1]
                    for x, o in zip(hits.tolist(), s.owners(hits).tolist(), strict=True):
                        out.append((name, s.doc_ids[o], x - int(s.starts[o])))
                if out:
                    p, d, x = zip(*out, strict=True)
                    yield batch_of(schema, phrase=p, doc_id=d, start=x)

    return map_arrow(segments, run, "phrase string, doc_id long, start long")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the rows that hold a window of a benchmark item; columns and other rows stay as they are."""
    hit = contamination(docs, benchmark, window).where(F.size("items") > 0).select(F.col("doc_id").alias("_cg_id"), F.col("text_key").alias("_cg_key")).distinct()
    return docs.join(hit, F.col("doc_id").cast("long").eqNullSafe(F.col("_cg_id")) & (F.xxhash64("text") == F.col("_cg_key")), "left_anti")


def items_sha256(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
