import hashlib
import random

import numpy as np

from corpusgraph.llm import suffix_dedup as D


def brute(rows, w=50):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - w + 1):
                g = b[p : p + w]
                least[g] = min(least.get(g, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - w + 1):
                if least[b[p : p + w]] < i:
                    gone[p : p + w] = b"\1" * w
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["the", "on", "er", "ß", "an", "é"]) for _ in range(r.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(r.randint(8, 30)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [text(r.randint(0, 40))]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(passages), text(r.randint(0, 20))]
        rows.append((i * 3 % 61, " ".join(parts)))
    rows += [(200 + i, r.choice(rows)[1]) for i in range(8)]
    rows += [(300, None), (301, ""), (302, "a" * 49), (303, "a" * 50), (304, "a" * 500), (305, "ab" * 300), (306, "ab" * 40), (307, "b" + "a" * 120)]
    p = "x" * 3 + passages[0]
    rows += [(None, p * 3), (310, p * 5), (310, p * 4), (310, p * 4), (309, passages[1]), (311, passages[1] * 3)]
    r.shuffle(rows)
    return rows


def query(df):
    from pyspark.sql import functions as F

    out = D.deduplicate(df).select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("r"), F.size("starts").alias("s"), F.sha2("kept", 256).alias("h"))
    return sorted([tuple(x) for x in out.collect()], key=str)


def test_matches_brute_force(spark):
    for seed in (1, 2):
        rows = rows_of(seed)
        df = spark.createDataFrame([(a, b, "k", "o") for a, b in rows], "doc_id long, text string, key string, occ string").repartition(5)
        assert query(df) == brute(rows)


def test_empty(spark):
    assert D.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_text(spark):
    r = random.Random(9)
    long = "".join(r.choice("abcdef ") for _ in range(700_000))
    rows = [(1, long[300_000:300_200]), (2, long), (3, "zz" + long[261_000:263_000] + "qq")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x[0]: x[2] for x in query(df)}
    assert got == {1: 0, 2: 200, 3: 2000}


def test_longest_previous_factors():
    r = np.random.default_rng(3)
    for _ in range(150):
        n, width = int(r.integers(1, 60)), int(r.integers(1, 20))
        x = np.r_[r.integers(97, 99, n), np.arange(30)].astype(np.uint8)
        rank = r.integers(0, 6, n)
        at = np.arange(n)
        order, common = D.suffix_array(x, at, rank, width)
        cut = lambda k: bytes(x[k : k + width])
        assert [(cut(k), rank[k]) for k in order] == sorted((cut(k), rank[k]) for k in at)
        shared = lambda a, b: next((i for i in range(width) if cut(a)[i] != cut(b)[i]), width)
        assert common.tolist() == [0, *(shared(a, b) for a, b in zip(order, order[1:]))]
        want = [max((shared(k, j) for j in at if rank[j] < rank[k]), default=0) for k in order]
        assert D.longest_previous(order, common, rank).tolist() == want


def test_equal_hashes_of_different_bytes_are_told_apart(spark, monkeypatch):
    """Keys and contents of a few values only: nearly all runs collide, and bytes decide."""
    real = D.runs

    def few(rows, width):
        for number, start, count, key, content in real(rows, width):
            yield number, start, count, key % np.uint64(3) << np.uint64(62), content % np.uint64(2)

    monkeypatch.setattr(D, "runs", few)
    rows = rows_of(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert query(df) == brute(rows)


def test_hot_keys_are_split(spark, monkeypatch):
    r = random.Random(8)
    text = lambda n: "".join(r.choice("abcdefghijk ") for _ in range(n))
    passage = text(90)
    rows = [(i, text(r.randint(0, 60)) + passage + text(r.randint(0, 80))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)
    for hot in (2, 8, 32):
        monkeypatch.setattr(D, "HOT", hot)
        assert query(df) == want


def test_small_pages_and_flushes(spark, monkeypatch):
    for name, value in (("PAGE_BYTES", 300), ("_FLUSH", 20), ("_FETCHED", 500), ("_SORTED", 64)):
        monkeypatch.setattr(D, name, value)
    rows = rows_of(6)
    assert query(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_whole_table(spark):
    """A small table against brute force over every 50-byte string."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert query(df) == brute(rows)


def WIDTH_CUT(rows, w=50):  # noqa: N802
    """Texts by doc_id with what earlier documents hold cut, from every string of w bytes."""
    least, out = {}, {}
    for i, t in rows:
        b = t.encode()
        for p in range(len(b) - w + 1):
            least[b[p : p + w]] = min(least.get(b[p : p + w], i), i)
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - w + 1):
            if least[b[p : p + w]] < i:
                gone[p : p + w] = b"\1" * w
        out[i] = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
    return out


def test_cut_keeps_all_columns(spark):
    p = "the passage that both documents hold, of more than fifty bytes, é and all"
    rows = [(1, "a " + p, "x", 5), (2, p + " b", None, 6), (3, p, "z", 7), (4, None, "n", 8), (4, "", "e", 9), (None, p, "i", 10)]
    df = spark.createDataFrame([(*r, {"k": [r[0]]}) for r in rows], "doc_id int, text string, `a.b` string, n_chars int, c2 map<string, array<int>>")
    out = D.cut_documents(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    got = sorted(((r.doc_id, r.text, r["a.b"], r.n_chars, r.c2["k"]) for r in out.collect()), key=str)
    assert got == sorted([(1, "a " + p, "x", len(p) + 2, [1]), (2, " b", None, 2, [2]), (4, None, "n", None, [4]), (4, "", "e", 0, [4]), (None, p, "i", len(p), [None])], key=str)
    assert D.cut_documents(df.limit(0)).count() == 0


def test_no_table_stays_in_the_catalog(spark):
    D.deduplicate(spark.createDataFrame(rows_of(1), "doc_id long, text string")).count()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("cg_")]


def test_sql(spark):
    from corpusgraph.llm.op10 import ORACLE_SQL, QUERIES
    from tests.oracle import compare

    assert compare(spark, QUERIES["op10_suffix_array_dedup"], ORACLE_SQL["op10_suffix_array_dedup"], "/root/testdata/sf0.001") == 200


def test_memory_of_a_task_that_finds_runs():
    """A task of 8 MB of text, half of it copies, holds less than 60 MB more at once, so that two beside a full heap fit an executor."""
    import tracemalloc

    import pyarrow as pa

    r = np.random.default_rng(1)
    texts = [bytes(r.integers(97, 123, 4000, dtype=np.uint8)).decode() for _ in range(1000)] * 2
    pages = []
    for at in range(0, 2000, 250):
        rows = pa.record_batch({"doc_id": pa.array(range(at, at + 250), pa.int64()), "text": texts[at : at + 250]})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_batch(rows)
        pages.append(sink.getvalue().to_pybytes())
    batch = pa.record_batch({"page": pa.array(range(8), pa.int64()), "blob": pages})
    tracemalloc.start()
    try:
        sent = sum(b.num_rows for b in D._find_runs(40, 50)(iter([batch])))
        assert sent and tracemalloc.get_traced_memory()[1] < 60e6
    finally:
        tracemalloc.stop()
