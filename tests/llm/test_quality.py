import numpy as np
from pyspark.sql import functions as F

from corpusgraph.llm import quality as Q


def brute(m, text):
    """Plain loops over every place of every chunk."""
    x = list(text)
    starts = [0] if len(x) <= Q.CHUNK else [min(k * Q.PLACES, len(x) - Q.CHUNK) for k in range(-(-(len(x) - Q.TAPS) // Q.PLACES))]
    scores = []
    for s in starts:
        c = (x[s : s + Q.CHUNK] + [256] * Q.CHUNK)[: Q.CHUNK]
        top = np.full(Q.FILTERS, -np.inf)
        for p in range(Q.PLACES):
            top = np.maximum(top, np.concatenate([m.emb[b] for b in c[p : p + Q.TAPS]]) @ m.w + m.b)
        scores.append(np.tanh(np.maximum(top, 0) @ m.u + m.c) @ m.v)
    z = m.d @ [np.mean(scores), max(scores), min(scores)] + m.e[0]
    return 1 / (1 + np.exp(-z))


def test_network_matches_plain_loops():
    m = Q.Model.start()
    texts = [b"", b"a", b"x" * 263, b"x" * 264, bytes(range(256)) * 3, "é ß".encode() * 200, b"q" * 265]
    got = Q.probabilities(m, texts, at_once=2)
    assert np.allclose(got, [brute(m, t) for t in texts], atol=1e-4)


def test_gradients():
    m = Q.Model.start()
    for f in ("emb", "w", "b", "u", "c", "v", "d", "e"):
        setattr(m, f, getattr(m, f).astype(np.float64))
    r = np.random.default_rng(0)
    chunks = r.integers(97, 103, (5, Q.CHUNK))
    docs, y = np.array([0, 0, 1, 2, 2]), np.array([1.0, 0.0, 1.0])
    _, g = Q._gradients(m, chunks, docs, y)
    for f, at in (("w", (3, 2)), ("u", (1, 1)), ("v", (4,)), ("d", (1,)), ("e", (0,)), ("b", (5,)), ("emb", (98, 2))):
        x = getattr(m, f)
        old = x[at]
        x[at] = old + 1e-5
        up = Q._gradients(m, chunks, docs, y)[0]
        x[at] = old - 1e-5
        down = Q._gradients(m, chunks, docs, y)[0]
        x[at] = old
        assert abs((up - down) / 2e-5 - g[f][at]) < 1e-3 * max(1, abs(g[f][at])), f


def test_held_out_accuracy(spark):
    from corpusgraph.llm.op4 import op4_quality_classifier

    out = op4_quality_classifier(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(out) > 80 and np.mean([r.predicted == r.quality for r in out]) > 0.97
    import zlib

    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and 0 <= r.score <= 1 for r in out)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a fine text", 0.1), (1, "a fine text", 0.2), (None, None, 0.3), (2, "", 0.4), (3, "x " * 200_000, 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None), (3, 0)], "doc_id long, quality int")
    m = Q.fit(docs, labels, rounds=2)
    out = Q.score(docs, m).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    none = Q.fit(docs, labels.limit(0))
    assert {r.score for r in Q.score(docs, none).collect()} == {0.5}
    kept = Q.keep_good(docs, none)
    assert kept.columns == docs.columns and kept.count() == 5
    assert Q.score(docs.limit(0), m).count() == 0
    assert docs.select(Q.held_out(F.col("doc_id")).alias("h")).where("h is null").count() == 0


def test_training_sees_whole_texts_in_any_number_of_tasks(spark, monkeypatch):
    """Only bytes far into long texts tell the classes apart; one task or several learn them."""
    r = np.random.default_rng(4)
    text = lambda y: "".join(r.choice(list("abcdef "), 3000)) + ("xyz" * 90 if y else "mno" * 90) + "".join(r.choice(list("abcdef "), 600))
    rows = [(i, text(i % 2), i % 2) for i in range(90)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, quality int")
    for size in (800, 20):
        monkeypatch.setattr(Q, "PART_ROWS", size)
        p = {x.doc_id: x.score for x in Q.score(docs, Q.fit(docs, labels, rounds=8)).collect()}
        assert np.mean([(p[i] >= 0.5) == y for i, _, y in rows]) > 0.95
