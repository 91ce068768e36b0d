import hashlib
import random
import re

from pyspark.sql import functions as F

from corpusgraph.llm import decontam as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        ws = words(t)
        if i is not None and ws:
            for k in range(max(1, len(ws) - 9)):
                windows.setdefault(tuple(ws[k : k + 10]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for i, t in docs:
        ws, hit, its = words(t), set(), set()
        for n in sizes:
            for k in range(len(ws) - n + 1):
                w = tuple(ws[k : k + n])
                if w in windows:
                    hit |= set(range(k, k + n))
                    its |= windows[w]
        out.append((i, len(ws), len(hit), len(its), hashlib.sha256(",".join(sorted(its)).encode()).hexdigest()))
    return sorted(out, key=str)


def ours(spark, docs, items, **k):
    d = spark.createDataFrame([(a, b, "z") for a, b in docs], "doc_id long, text string, items string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    hit = F.aggregate(F.zip_with("starts", "ends", lambda a, e: e - a), F.lit(0).cast("long"), lambda acc, x: acc + x)
    out = D.contamination(d, b, **k).select("doc_id", "n_words", hit.alias("h"), F.size("items").alias("n"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("s"))
    return sorted([tuple(x) for x in out.collect()], key=str)


def rows():
    r = random.Random(4)
    vocab = ["the", "on", "é", "naïve", "A1", "b-c", "x_y", "zz", "q" * 30, "of", "ß"]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, text(r.randint(0, 30))) for i in range(15)] + [(3, text(12)), (None, text(12)), (40, None), (41, ""), (42, "unique words"), (43, "the the the the the the the the the the the")]
    docs = []
    for i in range(60):
        parts = [text(r.randint(0, 30))]
        for _ in range(r.randint(0, 2)):
            w = words(r.choice(items)[1])
            a = r.randint(0, 4)
            parts += [" ".join(w[a : a + r.randint(5, 25)]).upper(), text(r.randint(0, 9))]
        docs.append((i, ", ".join(parts)))
    docs += [(90, None), (91, ""), (92, "!!"), (5, docs[3][1]), (5, docs[3][1]), (None, docs[4][1]), (93, "unique\tWORDS" * 3), (94, "the " * 50_000), (95, "unique"), (96, "words unique words")]
    return docs, items


def test_matches_brute_force(spark):
    docs, items = rows()
    assert ours(spark, docs, items) == brute(docs, items)


def test_blocks_merge(spark):
    docs, items = rows()
    assert ours(spark, docs, items, block_words=20) == brute(docs, items)


def test_empty(spark):
    docs, items = rows()
    assert ours(spark, [], items) == []
    assert ours(spark, docs, []) == brute(docs, [])


def test_phrases_and_proximity(spark):
    df = spark.createDataFrame([(1, "a b c d e f a c b"), (2, "x b a y c"), (3, "c"), (4, "a b")], "doc_id long, text string")
    seg = D.build_segments(df)
    got = lambda p, **k: sorted((r.doc_id, r.start) for r in D.phrase_matches(seg, [p], **k).collect())
    assert got("b c") == [(1, 1)]
    assert got("c b a", span=4) == [(1, 0), (1, 6), (2, 1)]
    assert got("c b a", span=3) == [(1, 0), (1, 6)]
    assert got("nothing") == []


def test_whole_table(spark):
    d, b = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    docs, items = [(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in b.collect()]
    got = ours(spark, docs, items)
    assert got == brute(docs, items) and any(x[2] for x in got)


def test_drop(spark):
    docs = spark.createDataFrame([(1, "clean text", 5), (1, "a b c", 6), (None, "a b c", 7), (None, "d", 8), (2, None, 9)], "doc_id long, text string, items int")
    out = D.drop_contaminated(docs, spark.createDataFrame([(1, "b c")], "item_id long, text string"))
    assert out.columns == docs.columns and sorted(r["items"] for r in out.collect()) == [5, 8, 9]


def test_sql(spark):
    from corpusgraph.llm.op6 import ORACLE_SQL, QUERIES
    from tests.oracle import compare

    assert compare(spark, QUERIES["op6_benchmark_decontamination"], ORACLE_SQL["op6_benchmark_decontamination"], "/root/testdata/sf0.01") == 1000
