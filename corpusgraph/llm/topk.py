"""Exact inner-product top-k with norm buckets and local cosine thresholds.

Candidates are ordered by length into buckets. A query's k-th best product so far is its bar; divided by its length and by the
greatest length in a bucket it is the cosine that a vector of the bucket must reach there. Above 1 the bucket is skipped, high ones prune by the range
that the query's strongest coordinate leaves to a candidate's, low ones by length alone. What is left is verified with exact integer products.

Queries go in blocks of bounded bytes, one after the other: a block is broadcast, its results are written, and it is let go before the next. The seeds
that give first bars are the SEEDS longest vectors, a fixed number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.llm.common import Growing, batch_of, map_arrow, parts_of, slices, stage_table

SCALE = 256
SEEDS = 1024
BLOCK_BYTES = 16 << 20  # of a block of queries, in the driver and in each worker
BUCKET = 512
COORDINATE_FROM = 0.6  # local cosine from which the coordinate range prunes more than it costs

_READY = pa.schema([("uid", pa.int64()), ("vec_id", pa.int64()), ("norm", pa.float64()), ("v", pa.binary())])
_READY_SQL = "uid long, vec_id long, norm double, v binary"


def integers(x) -> np.ndarray:
    return np.floor(SCALE * np.asarray(x, np.float64))


def ready(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Rows that take part, as integers (in doubles), with their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            rows = []
            for u, i, e in zip(b.column("uid").to_pylist(), b.column("id").to_pylist(), b.column("e"), strict=True):
                if i is None or not e.is_valid or e.values.null_count:
                    continue
                x = integers(e.values.to_numpy(zero_copy_only=False))
                if np.isfinite(x).all():
                    rows.append((u, i, float(np.sqrt(np.dot(x, x))), x.tobytes()))
            if rows:
                u, i, n, v = zip(*rows, strict=True)
                yield batch_of(_READY, uid=u, vec_id=i, norm=n, v=v)

    base = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("e"))
    return map_arrow(base, run, _READY_SQL)


def matrix(rows: list[bytes], width: int | None = None) -> np.ndarray:
    """Vectors of different lengths are padded with zeros."""
    width = max((len(r) // 8 for r in rows), default=0) if width is None else width
    if all(len(r) == 8 * width for r in rows):
        return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), width)
    out = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        x = np.frombuffer(r, np.float64)[:width]
        out[k, : len(x)] = x
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, as int64: in doubles where they are exact, else in whole numbers (held at the ends of a long)."""
    n = min(a.shape[1], b.shape[1])
    a, b = a[:, :n], b[:, :n]
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(n, 1)
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = [[max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(p, q, strict=True)))) for q in b] for p in a]
    return np.array(whole, np.int64).reshape(len(a), len(b))


class Best:
    """The k best (score, -vec_id, -uid) of each query, and its bar."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.query, self.score, self.vec, self.uid = (np.zeros(0, np.int64) for _ in range(4))
        self.bar = np.full(n, np.iinfo(np.int64).min)
        self.bar_id = np.full(n, np.iinfo(np.int64).max)

    def add(self, query: np.ndarray, score: np.ndarray, vec: np.ndarray, uid: np.ndarray) -> None:
        if not len(query):
            return
        q, s, v, u = (np.r_[a, b] for a, b in ((self.query, query), (self.score, score), (self.vec, vec), (self.uid, uid)))
        order = np.lexsort((u, v, ~s, q))  # ~s falls as s grows, at the ends of a long as well
        q, s, v, u = q[order], s[order], v[order], u[order]
        first = np.r_[0, np.flatnonzero(q[1:] != q[:-1]) + 1]
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        keep = rank < self.k
        self.query, self.score, self.vec, self.uid = q[keep], s[keep], v[keep], u[keep]
        full = rank == self.k - 1
        self.bar[q[full]], self.bar_id[q[full]] = s[full], v[full]


def search_bucket(q: np.ndarray, q_uid: np.ndarray, q_norm: np.ndarray, best: Best, floor: np.ndarray, c: np.ndarray, c_uid: np.ndarray, c_id: np.ndarray, c_norm: np.ndarray) -> dict[str, int]:
    """Adds a bucket's candidates; floor: bars known from elsewhere, as scores. Returns how many queries each pruning took."""
    top = c_norm.max() * (1 + 1e-12)
    bar = np.maximum(best.bar, floor).astype(np.float64)
    reach = q_norm * top
    local = np.where(reach > 0, bar / np.where(reach > 0, reach, 1), np.where(bar > 0, 2.0, -2.0))
    live = local <= 1 + 1e-12
    coordinate = live & (local >= COORDINATE_FROM)
    by_length = np.flatnonzero(live & ~coordinate)
    done = {"skipped": int((~live).sum()), "coordinate": int(coordinate.sum()), "length": len(by_length)}

    def take(query: np.ndarray, at: np.ndarray, score: np.ndarray) -> None:
        low = np.maximum(best.bar[query], floor[query])
        ok = (score > low) | (score == low) & ((best.bar[query] < low) | (c_id[at] <= best.bar_id[query]))
        ok &= c_uid[at] != q_uid[query]
        best.add(query[ok], score[ok], c_id[at[ok]], c_uid[at[ok]])

    for s in range(0, len(by_length), 1024):
        some = by_length[s : s + 1024]
        need = np.where(q_norm[some] > 0, bar[some] / np.where(q_norm[some] > 0, q_norm[some], 1), -1)
        use = c_norm * (1 + 1e-12) >= need.min()
        at = np.flatnonzero(use)
        p = products(q[some], c[at])
        low = np.maximum(best.bar[some], floor[some])
        a, b = np.nonzero(p >= low[:, None])
        take(some[a], at[b], p[a, b])
    picked = np.flatnonzero(coordinate)
    if len(picked):
        n = min(q.shape[1], c.shape[1])
        unit = c[:, :n] / np.where(c_norm > 0, c_norm, 1)[:, None]
        queries, places, scores = [], [], []
        for k in picked.tolist():
            x = q[k, :n] / q_norm[k]
            f = int(np.abs(x).argmax())
            t = min(1.0, local[k])
            half = np.sqrt(max(0.0, (1 - t * t) * (1 - x[f] * x[f]))) + 1e-9
            low, high = x[f] * t - half, x[f] * t + half
            if x[f] >= t:
                high = 2.0
            if -x[f] >= t:
                low = -2.0
            at = np.flatnonzero((unit[:, f] >= low) & (unit[:, f] <= high))
            if len(at):
                queries.append(np.full(len(at), k))
                places.append(at)
                scores.append(products(q[k : k + 1], c[at])[0])
        if queries:
            take(np.concatenate(queries), np.concatenate(places), np.concatenate(scores))
    return done


_OUT = pa.schema([("query_uid", pa.int64()), ("query_id", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64()), ("uid", pa.int64())])
_OUT_SQL = "query_uid long, query_id long, score long, vec_id long, uid long"


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, ids, norm, q, floor = shared.value
        best = Best(len(uid), k)
        for b in slices(batches, BUCKET):
            if b.num_rows and len(uid):
                search_bucket(q, uid, norm, best, floor, matrix(b.column("v").to_pylist()), *(b.column(c).to_numpy(zero_copy_only=False) for c in ("uid", "vec_id", "norm")))
        for at in range(0, len(best.query), 65536):
            s = slice(at, at + 65536)
            yield batch_of(_OUT, query_uid=uid[best.query[s]], query_id=ids[best.query[s]], score=best.score[s], vec_id=best.vec[s], uid=best.uid[s])

    return run


def top_products(vectors: DataFrame, k: int = 5, every: int = 50, id_column: str = "vec_id", column: str = "embedding", block: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, the k other rows of largest integer inner product.

    Components x become floor(256 x). Ties go to the smaller vec_id. Rows with a null id, a null vector, or a null or non-finite component take no
    part. Vectors of different lengths meet in the components they share. Rows of one id are different rows: each is a candidate, and each a query of
    its own. Fewer than k candidates: all of them. Empty: no rows. Other columns are not read. block: queries in a block, else as many as BLOCK_BYTES holds.
    """
    spark = vectors.sparkSession
    rows = stage_table(ready(vectors, id_column, column), "vectors")
    widest = rows.agg(F.max(F.octet_length("v"))).first()[0] or 8
    buckets = stage_table(rows.repartitionByRange(parts_of(rows, widest + 24), F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id"), "buckets")
    seeds = rows.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).collect()
    seed = matrix([r.v for r in seeds])
    seed_uid = np.array([r.uid for r in seeds], np.int64)
    queries = rows.where(F.col("vec_id") % every == 0)
    block = block or max(256, BLOCK_BYTES // max(8, widest))
    blocks = max(1, -(-queries.count() * 5 // (4 * block)))  # hashing deals unevenly: aim at four fifths of a block

    def hits(n: int) -> tuple[DataFrame, Broadcast]:
        part = (queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == n)).collect()
        q = matrix([r.v for r in part])
        uid, ids, norm = np.array([r.uid for r in part], np.int64), np.array([r.vec_id for r in part], np.int64), np.array([r.norm for r in part])
        floor = np.full(len(part), np.iinfo(np.int64).min)
        if len(part) and len(seeds) > k:
            p = products(q, seed)
            p[uid[:, None] == seed_uid[None]] = np.iinfo(np.int64).min
            floor = np.partition(p, len(seeds) - k, axis=1)[:, len(seeds) - k]
        shared = spark.sparkContext.broadcast((uid, ids, norm, q, floor))
        w = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "uid")
        best = map_arrow(buckets, _search(shared, k), _OUT_SQL).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), shared

    if blocks == 1:
        return hits(0)[0]
    folder = Growing(spark, "hits")
    for n in range(blocks):
        found, shared = hits(n)
        folder.append(found)
        shared.destroy()
    return folder.read()
