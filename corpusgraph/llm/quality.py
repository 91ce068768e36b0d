"""Document quality with a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Bytes become short vectors, learned filters run over every
place of a chunk, the strongest answer of each filter in the chunk goes through a small dense layer to a chunk score, and mean, largest and
smallest chunk score give one probability. Everything is learned by gradient descent on a bounded, documented sample of labelled rows: in each round every task
takes some steps on the whole texts of its rows, and the driver averages what they learned.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import batch_of, labelled_sample, map_arrow, slices, stage_table, text_bytes

TAPS = 8  # bytes that a filter sees
PLACES = 256  # places of a filter in a chunk
CHUNK = PLACES + TAPS  # bytes; a chunk starts PLACES after the one before, the last ends with the text
DIM, FILTERS, HIDDEN = 8, 32, 16
FIT_ROWS = 3000  # labelled rows of each class that training may read
ROUNDS, STEPS = 32, 40  # rounds of training, and steps of each task in one
BATCH, RATE = 24, 0.02
PART_ROWS, PART_BYTES = 800, 32 << 20  # of the sample in one task, about
_PAD = 256


@dataclass
class Model:
    emb: np.ndarray  # (257, DIM), the last is padding
    w: np.ndarray  # (TAPS * DIM, FILTERS)
    b: np.ndarray
    u: np.ndarray  # (FILTERS, HIDDEN)
    c: np.ndarray
    v: np.ndarray  # (HIDDEN,)
    d: np.ndarray  # (3,) of mean, largest, smallest
    e: np.ndarray  # (1,)

    @staticmethod
    def start(seed: int = 7) -> Model:
        r = np.random.default_rng(seed)
        n = lambda *s, by: (r.standard_normal(s) * by).astype(np.float32)
        emb = n(257, DIM, by=0.5)
        emb[_PAD] = 0
        return Model(emb, n(TAPS * DIM, FILTERS, by=0.25), np.zeros(FILTERS, np.float32), n(FILTERS, HIDDEN, by=0.2), np.zeros(HIDDEN, np.float32), n(HIDDEN, by=0.3), np.array([1, 0.1, 0.1], np.float32), np.zeros(1, np.float32))


def chunks_of(text: bytes, only: np.ndarray | None = None) -> np.ndarray:
    """(chunks, CHUNK) of byte numbers; an empty text is one chunk of padding. only: numbers of the wanted chunks."""
    x = np.frombuffer(text, np.uint8)
    n = max(1, -(-(len(x) - TAPS) // PLACES))
    which = np.arange(n) if only is None else only
    if len(x) <= CHUNK:
        out = np.full((1, CHUNK), _PAD, np.int64)
        out[0, : len(x)] = x
        return out[np.zeros(len(which), np.int64)] if only is not None else out
    start = np.minimum(which * PLACES, len(x) - CHUNK)
    return x[start[:, None] + np.arange(CHUNK)].astype(np.int64)


def strongest(m: Model, chunks: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Strongest answer of each filter in each chunk, without its constant, and if wanted the first place of it."""
    v = m.emb[chunks].reshape(len(chunks), CHUNK * DIM)
    out = at = None
    for r in range(TAPS):  # places r, r + TAPS, ...: windows side by side, no copy of each
        part = np.ascontiguousarray(v[:, r * DIM : (r + PLACES) * DIM]).reshape(-1, TAPS * DIM) @ m.w
        part = part.reshape(len(chunks), PLACES // TAPS, FILTERS)
        top = part.max(1)
        if places:
            here = part.argmax(1) * TAPS + r
            at = here if out is None else np.where((top > out) | (top == out) & (here < at), here, at)
        out = top if out is None else np.maximum(out, top)
    return out, at


def pooled(m: Model, chunks: np.ndarray) -> np.ndarray:
    """Strongest answer of each filter in each chunk."""
    return strongest(m, chunks)[0] + m.b


def chunk_scores(m: Model, chunks: np.ndarray) -> np.ndarray:
    p = np.maximum(pooled(m, chunks), 0)
    return np.tanh(p @ m.u + m.c) @ m.v


def probabilities(m: Model, texts: list[bytes], at_once: int = 512) -> np.ndarray:
    """One probability of each text; chunks of all texts run through the filters at_once by at_once."""
    held: list[np.ndarray] = []
    size, counts, scores = 0, [], []

    def flush() -> None:
        nonlocal size
        if held:
            scores.append(chunk_scores(m, np.concatenate(held)))
            held.clear()
            size = 0

    for t in texts:
        n = max(1, -(-(len(t) - TAPS) // PLACES))
        counts.append(n)
        for at in range(0, n, at_once):
            part = chunks_of(t, np.arange(at, min(n, at + at_once)))
            held.append(part)
            size += len(part)
            if size >= at_once:
                flush()
    flush()
    if not counts:
        return np.zeros(0)
    s, n = np.concatenate(scores).astype(np.float64), np.array(counts)
    first = np.cumsum(n) - n
    z = m.d[0] * np.add.reduceat(s, first) / n + m.d[1] * np.maximum.reduceat(s, first) + m.d[2] * np.minimum.reduceat(s, first) + m.e[0]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _gradients(m: Model, chunks: np.ndarray, docs: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Cross-entropy of documents (chunk i belongs to docs[i], ascending) and its gradients."""
    n = len(y)
    window = np.lib.stride_tricks.sliding_window_view(chunks, TAPS, 1)[:, :PLACES]
    best, at = strongest(m, chunks, True)
    raw = best + m.b
    p = np.maximum(raw, 0)
    a = np.tanh(p @ m.u + m.c)
    s = a @ m.v
    count = np.bincount(docs, minlength=n)
    first = np.cumsum(count) - count
    mean, most, least = np.add.reduceat(s, first) / count, np.maximum.reduceat(s, first), np.minimum.reduceat(s, first)
    z = m.d[0] * mean + m.d[1] * most + m.d[2] * least + m.e[0]
    q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    loss = -np.mean(y * np.log(q + 1e-9) + (1 - y) * np.log(1 - q + 1e-9))
    dz = (q - y) / n
    g = {"d": np.array([dz @ mean, dz @ most, dz @ least]), "e": np.array([dz.sum()])}
    ds = (dz * m.d[0] / count)[docs]
    for part, weight in ((most, m.d[1]), (least, m.d[2])):
        tied = s == part[docs]
        ds = ds + np.where(tied, (dz * weight)[docs] / np.add.reduceat(tied, first)[docs], 0)
    g["v"] = a.T @ ds
    da = ds[:, None] * m.v * (1 - a * a)
    g["u"], g["c"] = p.T @ da, da.sum(0)
    dp = (da @ m.u.T) * (raw > 0)
    g["b"] = dp.sum(0)
    seen = window[np.arange(len(chunks))[:, None], at]  # (chunks, FILTERS, TAPS)
    g["w"] = np.einsum("cf,cfk->kf", dp, m.emb[seen].reshape(*seen.shape[:2], -1))
    back = dp[:, :, None, None] * m.w.T.reshape(1, FILTERS, TAPS, DIM)
    flat = seen.reshape(-1)
    g["emb"] = np.stack([np.bincount(flat, back[..., k].reshape(-1), 257) for k in range(DIM)], 1)
    g["emb"][_PAD] = 0
    return float(loss), g


def _some(text: bytes, r: np.random.Generator) -> np.ndarray:
    """What a step sees of a row: a random share of its chunks, or at times a short cut of the text, so that short texts are learned as well."""
    if r.random() < 0.25 and text:
        n = min(len(text), int(r.integers(8, 160)))
        at = r.integers(0, len(text) - n + 1)
        return chunks_of(text[at : at + n])
    n = max(1, -(-(len(text) - TAPS) // PLACES))
    return chunks_of(text) if n == 1 else chunks_of(text, np.sort(r.choice(n, r.integers(1, n + 1), replace=False)))


@dataclass
class State:
    """A model in training, with Adam's first and second moments."""

    model: Model
    one: dict[str, np.ndarray]
    two: dict[str, np.ndarray]

    @staticmethod
    def start() -> State:
        m = Model.start()
        return State(m, *({f.name: np.zeros_like(getattr(m, f.name), np.float64) for f in fields(m)} for _ in range(2)))

    @staticmethod
    def mean(states: list[State], weights: list[int]) -> State:
        out = State.start()
        w = np.array(weights) / sum(weights)
        for f in (f.name for f in fields(Model)):
            setattr(out.model, f, sum(k * getattr(s.model, f) for k, s in zip(w, states, strict=True)).astype(np.float32))
            out.one[f], out.two[f] = (sum(k * getattr(s, n)[f] for k, s in zip(w, states, strict=True)) for n in ("one", "two"))
        return out

    def steps(self, texts: list[bytes], labels: np.ndarray, first: int, count: int, total: int, seed: list[int]) -> None:
        """Steps first + 1 to first + count of ``total``, on shuffled batches of the texts; the rate falls to zero at the end."""
        m, r = self.model, np.random.default_rng(seed)
        order = np.zeros(0, np.int64)
        for step in range(first + 1, first + count + 1):
            while len(order) < BATCH:
                order = np.r_[order, r.permutation(len(labels))]
            some, order = order[:BATCH], order[BATCH:]
            parts = [_some(texts[i], r) for i in some]
            _, g = _gradients(m, np.concatenate(parts), np.repeat(np.arange(len(some)), [len(x) for x in parts]), labels[some].astype(np.float64))
            now = RATE * (1 - step / (total + 1))
            for f in g:
                x = getattr(m, f)
                d = g[f] + (1e-4 * x if f in ("u", "v", "w") else 0)
                self.one[f] = 0.9 * self.one[f] + 0.1 * d
                self.two[f] = 0.99 * self.two[f] + 0.01 * d * d
                x -= (now * (self.one[f] / (1 - 0.9**step)) / (np.sqrt(self.two[f] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, column: str = "quality", rounds: int = ROUNDS) -> Model:
    """Trains on the whole texts of at most ``rows`` labelled rows of each class. Without any: a model that says 0.5.

    The sample is dealt to tasks of about PART_ROWS rows and PART_BYTES bytes, whatever the cluster; a round is one job, from whose tasks only models return.
    Null texts are empty. Labels without a document, documents without a label and rows with a null id or label take no part; a document row or a label that
    is repeated counts once for each pair of equal ids.
    """
    sample = stage_table(labelled_sample(docs, labels, column, held_out(F.col("doc_id")), rows).select("y", F.col("_cg_id").alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")), "sample")
    count, size = sample.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    state = State.start()
    if not count:
        state.model.d[:] = 0
        return state.model
    tasks = max(1, round(count / PART_ROWS), -(-(size or 0) // PART_BYTES))
    dealt = sample.repartition(tasks).persist(StorageLevel.MEMORY_AND_DISK)  # in turn: even parts, however ids hash
    schema = pa.schema([("task", pa.int32()), ("n", pa.int64()), ("state", pa.binary())])

    def one_round(start: State, number: int) -> list:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = sorted((r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("id", "y", "text")), strict=True)))
            if mine:
                task = TaskContext.get().partitionId()
                s = pickle.loads(pickle.dumps(start))  # a worker runs several tasks of a round
                s.steps([t for _, _, t in mine], np.array([y for _, y, _ in mine]), number * STEPS, STEPS, rounds * STEPS, [3, number, task])
                yield batch_of(schema, task=[task], n=[len(mine)], state=[pickle.dumps(s)])

        return sorted(map_arrow(dealt, run, "task int, n long, state binary").collect(), key=lambda r: r.task)

    for number in range(rounds):
        got = one_round(state, number)
        state = State.mean([pickle.loads(r.state) for r in got], [r.n for r in got])
    dealt.unpersist()
    return state.model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row. Only text is read; null is empty, an empty text is scored like any other, a very long one in blocks of chunks. Repeated rows score alike. Empty table: no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            yield batch_of(schema, doc_id=b.column("doc_id"), score=probabilities(shared.value, text_bytes(b.column("text"))))

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs without the rows that score below the threshold; all columns, whatever their names, pass through in the same task. Null text is empty. Empty table: no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            p = probabilities(shared.value, text_bytes(b.column(b.schema.get_field_index("text"))))
            yield b.filter(pa.array(p >= threshold))

    return docs.mapInArrow(run, docs.schema)
