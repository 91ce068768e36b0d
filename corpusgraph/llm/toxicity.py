"""Toxicity of texts whose words may be disguised: a noisy channel restores them, then the restored words are scored.

A disguised word is a lattice: a digit or sign stands for a letter, a repeated letter may be one letter, gaps between single letters may
be no gaps. The best path under a character trigram model and the costs of the channel is the restored text. The model is counted over all
documents; its table has a fixed size (CLASSES ** 3). Words and word beginnings that mark toxic rows come from a bounded, documented
sample of labelled rows. Words without any disguise have a lattice of one path and are taken as they are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import batch_of, labelled_sample, map_arrow, slices, stage_table

#: What signs stand for
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c"}
CLASSES = 64  # 0: between words; a-z; Latin letters to U+00FF; the last: other letters
FIT_ROWS = 6000  # labelled rows of each class that the fit may read
MIN_SIGNS = 4  # different documents that must show a feature
LEAST_WEIGHT = 1.5
PREFIXES = range(4, 9)
CACHE = 400_000
DOUBLED = 4.0  # what it costs to read a doubled letter as one

_GAP_RUN = re.compile(r"(?<!\S)\S{1,2}(?:\s+\S{1,2}){2,}(?!\S)")
_SIGN = re.compile("[" + re.escape("".join(LEET)) + "]")
_LETTERS = re.compile(r"[^\W\d_]+")
_DOUBLE = re.compile(r"([^\W\d_])\1")
_JOINED = re.compile(r"\w(?:[.\-_*~]\w){2,}\Z")
_HEAD, _TAIL = "\"'([{<*#%&-_", ".,;:?!\"')]}>*#%&$-_|"
_BARE_HEAD, _BARE_TAIL = ("".join(c for c in x if c not in LEET) for x in (_HEAD, _TAIL))


def _class_table() -> np.ndarray:
    t = np.zeros(0x250, np.uint8)
    n = 1
    for c in range(0x250):
        if chr(c).isalpha() and chr(c) == chr(c).lower() and c < 0x100:
            t[c] = min(n, CLASSES - 2)
            n += 1
        elif chr(c).isalpha():
            t[c] = CLASSES - 1
    return t


_CLASS = _class_table()


def class_of(ch: str) -> int:
    c = ord(ch)
    return int(_CLASS[c]) if c < len(_CLASS) else (CLASSES - 1 if ch.isalpha() else 0)


def _classes(text: str) -> np.ndarray:
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    k = _CLASS[np.minimum(x, len(_CLASS) - 1)]
    far = np.flatnonzero(x >= len(_CLASS))
    if len(far):
        k[far] = [CLASSES - 1 if chr(c).isalpha() else 0 for c in x[far].tolist()]
    return k


def class_blocks(text: str, size: int = 1 << 20) -> Iterator[np.ndarray]:
    """Classes of a text between two gaps, runs of gaps as one, in blocks of ``size`` signs; a block begins with the last two classes before it, so that its trigrams go on."""
    carry = np.zeros(1, np.uint8)
    for at in range(0, max(1, len(text)), size):
        k = np.r_[carry, _classes(text[at : at + size])]
        if at + size >= len(text):
            k = np.r_[k, np.uint8(0)]
        k = k[np.r_[True, (k[1:] > 0) | (k[:-1] > 0)]]
        yield k.astype(np.int64)
        carry = k[-2:]


def classes_of(text: str) -> np.ndarray:
    """Classes of a lower-cased text between two gaps; a run of gaps counts once."""
    return next(class_blocks(text, max(1, len(text))))


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of class trigrams over all documents; a task sends one row for each trigram that it saw."""
    schema = pa.schema([("code", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for b in slices(batches, 128):
            for t in b.column("text").to_pylist():
                for k in class_blocks(t or ""):
                    code = (k[:-2] * CLASSES + k[1:-1]) * CLASSES + k[2:]
                    total += np.bincount(code, minlength=CLASSES**3) if len(code) > 20_000 else 0
                    if len(code) <= 20_000:
                        np.add.at(total, code, 1)
        seen = np.flatnonzero(total)
        yield batch_of(schema, code=seen, n=total[seen])

    out = np.zeros(CLASSES**3, np.int64)
    for r in map_arrow(docs.select("text"), run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[r.code] = r.n
    return out


def log_model(counts: np.ndarray, weight: float = 3.0) -> np.ndarray:
    """log P(third | first two), shorter contexts mixed in by ``weight`` observations."""
    n3 = counts.reshape(CLASSES, CLASSES, CLASSES).astype(np.float64)
    n2, n1 = n3.sum(0), n3.sum((0, 1))
    p1 = (n1 + 1) / (n1.sum() + CLASSES)
    p2 = (n2 + weight * p1) / (n2.sum(1, keepdims=True) + weight)
    return np.log((n3 + weight * p2[None]) / (n3.sum(2, keepdims=True) + weight)).astype(np.float32)


def lattice(raw: str) -> list[list[tuple[str, float]]]:
    """For each sign of a lower-cased string its readings (a letter, a gap or nothing) with their costs."""
    out = []
    for ch, run, length in ((ch, k, len(g)) for ch, g in ((c, list(x)) for c, x in groupby(raw)) for k in range(1, len(g) + 1)):
        if ch in LEET:
            options = [(c, 0.7) for c in LEET[ch]] + [(" ", 7.0)]
            if run > 1:
                options.append(("", 0.2))
        elif ch.isalpha():
            options = [(ch, 2.0 if run > 2 else 0.0)]
            if run > 1:
                options.append(("", 0.2 if length > 2 else DOUBLED))
        elif ch.isspace():
            options = [("", 0.5), (" ", 1.5)]
        elif ch in ".-_*~":
            options = [("", 0.2), (" ", 1.2)]
        else:
            options = [(" ", 0.0)]
        out.append(options)
    return out


def restore(raw: str, model: np.ndarray) -> str:
    """Viterbi path through the lattice; states are the last two classes."""
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for options in lattice(raw):
        nxt: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in states.items():
            for text, cost in options:
                if not text or (text == " " and b == 0):
                    key, s, p = (a, b), score - cost, path
                else:
                    c = class_of(text)
                    key, s, p = (b, c), score - cost + float(model[a, b, c]), (path, text)
                if key not in nxt or s > nxt[key][0]:
                    nxt[key] = (s, p)
        states = nxt
    _, path = max(((s + float(model[a, b, 0]), p) for (a, b), (s, p) in states.items()), key=lambda x: x[0])
    out = []
    while path is not None:
        path, c = path
        out.append(c)
    return "".join(out[::-1])


def undoubled(word: str, model: np.ndarray) -> str | None:
    """Best reading of letters with one doubled pair, None if it is the word itself: the two paths of its lattice differ in few trigrams."""
    at = _DOUBLE.search(word).start()
    a, b, c = (class_of(word[at - 1]) if at else 0), class_of(word[at]), (class_of(word[at + 2]) if at + 2 < len(word) else 0)
    gain = float(model[a, b, c]) - float(model[a, b, b]) - float(model[b, b, c]) - DOUBLED
    return word[:at] + word[at + 1 :] if gain > 0 else None


def disguised(token: str) -> list[str]:
    """Parts of a lower-cased token whose lattice has more than one path: without signs around it, and with those that can be letters."""
    out = []
    core = token.rstrip(_TAIL).lstrip(_HEAD)
    if core.isalpha():
        if _DOUBLE.search(core):
            out.append(core)
    elif len(core) > 2 and any(c.isalpha() for c in core) and (_SIGN.search(core) or _JOINED.match(core) or _DOUBLE.search(core)):
        out.append(core)
    wide = token.rstrip(_BARE_TAIL).lstrip(_BARE_HEAD)
    if len(wide) > 2 and wide != core and any(c.isalpha() for c in wide):
        out.append(wide)
    return out


def reading(core: str, model: np.ndarray) -> str:
    """Best reading of a disguised part."""
    if core.isalpha() and sorted(len(list(g)) for _, g in groupby(core))[-2:] in ([2], [1, 2]):
        return undoubled(core, model) or core
    return restore(core, model)


def words_of_token(token: str, model: np.ndarray) -> list[str]:
    """Words of a token: as written, and as restored if it is disguised."""
    out = _LETTERS.findall(token)
    for core in disguised(token):
        out += reading(core, model).split()
    return out


def gap_runs(text: str, model: np.ndarray) -> list[str]:
    """Words restored from single signs, or pieces of two among at least as many single ones, between gaps."""
    out: list[str] = []
    for m in _GAP_RUN.finditer(text):
        sizes = list(map(len, m[0].split()))
        if 2 * sizes.count(1) >= len(sizes):
            out += restore(" ".join(m[0].split()), model).split()
    return out


def features(word: str) -> list[str]:
    """The word, and its beginnings from the longest on."""
    return ["=" + word, *("^" + word[:n] for n in reversed(PREFIXES) if n <= len(word))]


@dataclass
class Model:
    chars: np.ndarray
    weights: dict[str, float]  # log of how much likelier a toxic row shows the feature
    line: np.ndarray  # of inputs(), the last is the constant

    def of_word(self, word: str) -> float:
        """What the most special feature of a word says that the fit has seen often enough."""
        for f in features(word):
            if (w := self.weights.get(f)) is not None:
                return w
        return 0.0


TOP = 4


def inputs(found: list[float], words: int) -> list[float]:
    """What the final score sees of a text: its strongest words, the sum of the others, and if it has any its length."""
    top = sorted(found, reverse=True)
    return [*(top + [0.0] * TOP)[:TOP], math.log1p(sum(top[TOP:])), math.log1p(words) if top else 0.0, 1.0]


class Scorer:
    """What a model says of texts, with what it said of tokens before; one lives as long as its model in a Python worker."""

    @staticmethod
    def of(model: Model) -> Scorer:
        if (it := model.__dict__.get("_scorer")) is None:
            it = model.__dict__["_scorer"] = Scorer(model)
        return it

    def __init__(self, model: Model) -> None:
        self.model = model
        self.seen: dict[str, float] = {}
        self.marked = {f[1:] for f, w in model.weights.items() if f[0] == "=" and w > 0}
        self.heads = {f[1:5] for f in model.weights}  # no other word has a feature

    def of_word(self, word: str) -> float:
        return self.model.of_word(word) if word[:4] in self.heads else 0.0

    def token(self, token: str) -> float:
        plain = token if token.isalpha() else token.rstrip(_BARE_TAIL).lstrip(_BARE_HEAD)
        if plain.isalpha():  # letters between signs that can't be letters
            if not _DOUBLE.search(plain):
                return self.of_word(plain)
            token = plain
        return max(map(self.of_word, words_of_token(token, self.model.chars)), default=0.0)

    def split_words(self, tokens: list[str]) -> set[str]:
        """Marking words that a gap splits in two, where the lattice of both pieces reads them as one."""
        marked = self.marked
        out = {a + " " + b for a, b in zip(tokens, tokens[1:], strict=False) if a + b in marked}
        return {w for x in out for w in restore(x, self.model.chars).split() if w in marked}

    def inputs(self, texts: list[str]) -> np.ndarray:
        low = [t.lower() for t in texts]
        lists = [t.split() for t in low]
        sets = list(map(set, lists))
        if len(self.seen) > CACHE:
            self.seen.clear()
        for t in set().union(*sets) - self.seen.keys():
            self.seen[t] = self.token(t)
        out = []
        for text, every, tokens in zip(low, lists, sets, strict=True):
            found = [w for w in map(self.seen.__getitem__, tokens) if w > 0]
            more = set(gap_runs(text, self.model.chars)) | self.split_words(every)
            found += [x for w in more if (x := self.of_word(w)) > 0]
            out.append(inputs(found, len(tokens)))
        return np.array(out).reshape(len(out), TOP + 3)

    def __call__(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(texts) @ self.model.line, -30, 30)))


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def choose(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Weights of the features that mark toxic rows.

    counts: (feature, different toxic documents, clean rows). A beginning goes if a longer one is nearly as frequent: it would only
    match more. Both counts are taken a standard deviation to the careful side. A word that is frequent enough to be judged alone, and isn't toxic, stays with weight 0 under a toxic beginning.
    """
    weight = lambda t, n: math.log((t - math.sqrt(t) + 0.5) / (toxic + 1)) - math.log((n + math.sqrt(n) + 0.5) / (clean + 1))
    good = {f: (t, n) for f, t, n in counts if t >= MIN_SIGNS and weight(t, n) >= LEAST_WEIGHT}
    longer: dict[str, int] = {}
    for f, (t, _) in good.items():
        if f[0] == "^":
            longer[f[:-1]] = max(longer.get(f[:-1], 0), t)
    out = {f: weight(t, n) for f, (t, n) in good.items() if f[0] == "=" or longer.get(f, 0) < 0.9 * t}
    for f, t, n in counts:
        if f[0] == "=" and f not in good and t + n >= 4 * MIN_SIGNS and any("^" + f[1 : 1 + k] in out for k in PREFIXES):
            out[f] = 0.0
    return out


def fit_line(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 0.5, rounds: int = 60) -> np.ndarray:
    """Weighted logistic regression by damped Newton steps; all but the constant are pulled to zero."""
    w = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], penalty)
    pull[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + pull * w
        h = (x * (weight * (p * (1 - p) + 1e-4))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 4.0 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Character model over all documents; features and final line from at most ``rows`` labelled rows of each class.

    A toxic document counts for a feature once for each longest word of such documents, so that copies of one document aren't
    evidence. The line is weighted to the share of toxic rows among all labels that may be learned from. Without labels of both kinds: every score is 0.
    """
    spark = docs.sparkSession
    chars = log_model(trigram_counts(docs))
    shared = spark.sparkContext.broadcast(chars)
    sample = stage_table(labelled_sample(docs, labels, "toxic", held_out(F.col("doc_id")), rows).select("y", "text"), "sample")
    schema = pa.schema([("y", pa.int32()), ("feature", pa.string()), ("sign", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list[str]] = {}
        for b in slices(batches, 64):
            ys, fs, signs = [], [], []
            for y, t in zip(b.column("y").to_pylist(), b.column("text").to_pylist(), strict=True):
                low = (t or "").lower()
                words = set(gap_runs(low, shared.value))
                for token in set(low.split()):
                    if token not in cache:
                        if len(cache) > CACHE:
                            cache.clear()
                        cache[token] = words_of_token(token, shared.value)
                    words.update(cache[token])
                sign = min(words, key=lambda w: (-len(w), w), default="")
                found = {f for w in words for f in features(w)} | {""}
                ys += [y] * len(found)
                fs += found
                signs += [sign if y else ""] * len(found)
            yield batch_of(schema, y=ys, feature=fs, sign=signs)

    seen = map_arrow(sample, run, "y int, feature string, sign string")
    each = seen.groupBy("feature", "y", "sign").agg(F.count("*").alias("c"))
    counts = stage_table(each.groupBy("feature").agg(F.count(F.when(F.col("y") == 1, 1)).alias("t"), F.sum(F.when(F.col("y") == 0, F.col("c")).otherwise(0)).alias("n")), "features")
    total = counts.where("feature = ''").first()
    if total is None or not total.t or not total.n:
        return Model(chars, {}, np.r_[np.zeros(TOP + 2), -30.0])
    toxic, clean = F.lit(float(total.t + 1)), F.lit(float(total.n + 1))
    likely = F.log((F.col("t") - F.sqrt("t") + 0.5) / toxic) - F.log((F.col("n") + F.sqrt("n") + 0.5) / clean) >= LEAST_WEIGHT
    good = counts.where((F.col("feature") != "") & (F.col("t") >= MIN_SIGNS) & likely)
    starts = good.where("feature like '^%'").select(F.expr("substring(feature, 2)").alias("s"))
    # words under a toxic beginning that are often enough to be judged alone
    words = counts.where(F.col("feature").startswith("=") & (F.col("t") + F.col("n") >= 4 * MIN_SIGNS))
    words = words.withColumn("s", F.explode(F.array(*(F.substring("feature", 2, k) for k in PREFIXES))))
    good = good.unionByName(words.join(starts, "s", "left_semi").drop("s")).distinct()
    m = Model(chars, choose([(r.feature, r.t, r.n) for r in good.collect()], total.t, total.n), np.zeros(TOP + 3))
    shown = spark.sparkContext.broadcast(m)
    of = pa.schema([("y", pa.int32()), ("x", pa.list_(pa.float64()))])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer.of(shown.value)
        for b in slices(batches, 128):
            yield batch_of(of, y=b.column("y"), x=list(scorer.inputs([t or "" for t in b.column("text").to_pylist()])))

    got = map_arrow(sample, look, "y int, x array<double>").collect()  # 2 * rows short rows
    x, y = np.array([r.x for r in got]), np.array([r.y for r in got], np.float64)
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    every = {r.toxic: r["count"] for r in labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("toxic").count().collect()}
    weight = np.where(y == 1, every[1] / (y == 1).sum(), every[0] / (y == 0).sum())
    m.line = fit_line(x, y, weight * len(y) / weight.sum())
    return m


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row. Only text is read; null is empty, and an empty text is scored like any other. Very long texts are scored whole. Repeated rows score alike. Empty table: no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer.of(shared.value)
        for b in slices(batches, 128):
            yield batch_of(schema, doc_id=b.column("doc_id"), score=scorer([t or "" for t in b.column("text").to_pylist()]))

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")


def restored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the restored text: disguised tokens and runs of single signs replaced by their best reading."""
    shared = docs.sparkSession.sparkContext.broadcast(model.chars)
    schema = pa.schema([("doc_id", pa.int64()), ("restored", pa.string())])

    def word(m: re.Match) -> str:
        cores = disguised(m[0].strip("!|("))  # at the ends of a token these are taken as signs
        return m[0].replace(cores[0], reading(cores[0], shared.value)) if cores else m[0]

    def one(text: str) -> str:
        chars = shared.value
        run = lambda m: restore(" ".join(m[0].split()), chars) if 2 * (sizes := list(map(len, m[0].split()))).count(1) >= len(sizes) else m[0]
        return re.sub(r"\S+", word, _GAP_RUN.sub(run, text.lower()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            yield batch_of(schema, doc_id=b.column("doc_id"), restored=[one(t or "") for t in b.column("text").to_pylist()])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, restored string")


def entropy(text: str, model: np.ndarray) -> float:
    """Mean negative log probability of a text's classes, in nats."""
    k = classes_of(text)
    return float(-model[k[:-2], k[1:-1], k[2:]].mean()) if len(k) > 2 else math.nan
