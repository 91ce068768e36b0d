import math
import random

import numpy as np

from corpusgraph.llm import topk as T


def brute(rows, k=5, every=50):
    ok = [(n, i, [math.floor(256 * x) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in ok:
        if i % every == 0:
            c = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, j, v in ok if m != n)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(c[:k])]
    return sorted(out)


def test_matches_brute_force(spark):
    r = random.Random(1)
    f = lambda: float(np.float32(r.gauss(0, 1)))
    rows = [(i, [f() for _ in range(8)]) for i in range(700)]
    rows += [(700 + i, rows[3][1]) for i in range(80)] + [(900 + i, [0.0] * 8) for i in range(60)] + [(1000 + i, [x * 40 for x in rows[i][1]]) for i in range(30)]
    rows += [(2000, None), (2050, [1.0, None] + [0.0] * 6), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (None, [1.0] * 8), (2200, [1.0, 2.0]), (2250, []), (-50, [f() for _ in range(8)]), (50, rows[7][1]), (50, rows[7][1]), (7, rows[7][1])]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<float>, score int")
    for block in (4096, 5):
        assert sorted(tuple(x) for x in T.top_products(df, block=block).collect()) == brute(rows)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(x) for x in T.top_products(df).collect()] == [(0, 1, 1, 256 * 512)]
    assert T.top_products(df.limit(0)).count() == 0


def test_large_components():
    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**20, 5.0]])
    assert T.products(a, b).tolist() == [[2**60 + 15]]


def test_large_scores_are_told_apart():
    best = T.Best(1, 2)
    for score in (2**60, 2**60 + 1, -(2**63), 2**60 + 2, 2**60 + 1):
        best.add(np.array([0]), np.array([score]), np.array([score & 7]), np.array([0]))
    assert best.score.tolist() == [2**60 + 2, 2**60 + 1] and best.bar[0] == 2**60 + 1


def test_pruning_is_used():
    r = np.random.default_rng(0)
    c = np.floor(r.standard_normal((512, 16)) * 256)
    norm = np.sqrt((c * c).sum(1))
    q = c[:40] + np.floor(r.standard_normal((40, 16)) * 9)
    q_norm = np.sqrt((q * q).sum(1))
    ids = np.arange(512)
    best = T.Best(40, 1)
    floor = np.full(40, np.iinfo(np.int64).min)
    first = T.search_bucket(q, np.arange(1000, 1040), q_norm, best, floor, c, ids, ids, norm)
    again = T.search_bucket(q, np.arange(1000, 1040), q_norm, best, floor, c, ids + 5000, ids + 5000, norm)
    small = T.search_bucket(q, np.arange(1000, 1040), q_norm, best, floor, np.floor(c / 9), ids + 9000, ids + 9000, norm / 9)
    assert first["length"] == 40 and again["coordinate"] > 20 and small["skipped"] > 30
    assert sorted(zip(best.query.tolist(), best.score.tolist())) == [(k, int((q[k] @ c.T).max())) for k in range(40)]


def test_sql(spark):
    from corpusgraph.llm.op9 import ORACLE_SQL, QUERIES
    from tests.oracle import compare

    assert compare(spark, QUERIES["op9_exact_top_k"], ORACLE_SQL["op9_exact_top_k"], "/root/testdata/sf0.001") == 50
