import itertools
import random
import zlib

import numpy as np
import pytest

from corpusgraph.llm import toxicity as T


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return T.fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))


def brute_restore(raw, chars):
    """Every path through the lattice."""
    best = None
    for path in itertools.product(*T.lattice(raw)):
        a = b = 0
        score, out = 0.0, ""
        for text, cost in path:
            score -= cost
            if text and not (text == " " and b == 0):
                c = T.class_of(text)
                score += float(chars[a, b, c])
                a, b, out = b, c, out + text
        score += float(chars[a, b, 0])
        if best is None or score > best[0]:
            best = (score, out)
    return best


def test_viterbi_finds_the_best_path(model):
    r = random.Random(1)
    for n in range(80):
        raw = "".join(r.choice("aeiort1035@$!.- ttoo") for _ in range(r.randint(1, 6) if n < 60 else r.randint(7, 9)))
        score, out = brute_restore(raw, model.chars)
        got = T.restore(raw, model.chars)
        assert got == out, (raw, score)


def test_disguised_words_are_restored(model):
    for raw, word in {"m0r0n": "moron", "id1ot": "idiot", "1d10t": "idiot", "i d i o t": "idiot", "m.o.r.o.n": "moron", "loooser": "loser", "tr@sh": "trash", "5cum": "scum", "stup1d": "stupid"}.items():
        assert T.restore(raw, model.chars) == word
        assert T.Scorer(model)([f"Then the {raw} was of it."])[0] > 0.3, raw
    assert T.Scorer(model)(["Then the was of it.", "", "a b the 1 2 3 on."]).max() < 0.3


def best_restore(raw, chars):
    """The best path by dynamic programming over all restored prefixes, without any state that is merged but by its whole text."""
    paths = {"": 0.0}
    for options in T.lattice(raw):
        nxt = {}
        for out, score in paths.items():
            k = [0, 0, *map(T.class_of, out)][-2:] if out else [0, 0]
            for text, cost in options:
                s, p = score - cost, out
                if text and not (text == " " and k[1] == 0):
                    s, p = s + float(chars[k[0], k[1], T.class_of(text)]), out + text
                if p not in nxt or s > nxt[p]:
                    nxt[p] = s
        paths = nxt
    last = lambda out: [0, 0, *map(T.class_of, out)][-2:]
    return max((s + float(chars[(*last(out), 0)]), out) for out, s in paths.items())


def test_viterbi_finds_the_best_path_of_long_strings(model):
    r = random.Random(2)
    for _ in range(12):
        raw = "".join(r.choice("abdeiort105@$!.lmsc") for _ in range(r.randint(10, 12)))
        score, out = best_restore(raw, model.chars)
        assert T.restore(raw, model.chars) == out, (raw, score)


def test_one_doubled_letter_is_read_as_the_lattice_reads_it(model):
    r = random.Random(3)
    for _ in range(300):
        w = "".join(r.sample("abcdefgiklmnoprstu", r.randint(1, 8)))
        at = r.randrange(len(w))
        w = w[:at] + w[at] + w[at:]
        assert T.reading(w, model.chars) == T.restore(w, model.chars), w


def test_classes_in_blocks_give_the_same_trigrams():
    r = random.Random(4)
    for _ in range(200):
        text = "".join(r.choice("ab  \n1ß中") for _ in range(r.randint(0, 30)))
        whole = T.classes_of(text)
        want = list(zip(whole, whole[1:], whole[2:], strict=False))
        got = [t for k in T.class_blocks(text, r.randint(1, 5)) for t in zip(k, k[1:], k[2:], strict=False)]
        assert got == want, text


def test_plain_words_have_one_path():
    assert [T.disguised(w) for w in ("idiot", "nation", "the.", "thnd***", "12", "x", "")] == [[]] * 7
    assert T.disguised("a$$") == ["a$$"] and T.disguised("pi$$.") == ["pi$$"] and T.disguised("(rap") == ["(rap"] and T.disguised("iddiot") == ["iddiot"]


def test_disguises_at_the_ends_of_words_and_in_gaps(spark, model):
    for raw in ("iddiot", "idio+", "1diot!", "id iot", "i d i o t", "i  d  io t", "idiiot"):
        assert T.Scorer(model)([f"Then the {raw} was of it."])[0] > 0.3, raw
    docs = spark.createDataFrame([(1, "So (then it!!  The 1d10t, stup1d.")], "doc_id long, text string")
    assert T.restored(docs, model).first().restored == "so (then it!!  the idiot, stupid."


def test_held_out_rows(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from pyspark.sql import functions as F

    out = T.score(docs, model).withColumn("h", T.held_out(F.col("doc_id"))).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    held = [r for r in out if r.h]
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert np.mean([(r.score >= 0.3) == r.toxic for r in held]) > 0.92
    assert not [r for r in held if not r.toxic and r.score >= 0.3]


def test_trigram_counts_cover_all_rows(spark):
    rows = [(1, "Ab c"), (2, None), (3, ""), (4, "ab  ab\nß中")]
    n = T.trigram_counts(spark.createDataFrame(rows, "doc_id long, text string"))
    a, b, c, s, z = (T.class_of(x) for x in "abcß中")
    want = {}
    for k in ([0, a, b, 0, c, 0], [0, a, b, 0, a, b, 0, s, z, 0], [0], [0]):
        for t in zip(k, k[1:], k[2:]):
            want[t] = want.get(t, 0) + 1
    assert {tuple(map(int, np.unravel_index(i, (64, 64, 64)))): int(n[i]) for i in np.flatnonzero(n)} == want


def test_odd_rows(spark, model):
    docs = spark.createDataFrame([(1, "x", 1), (1, "x", 1), (None, None, 2), (2, "i " * 20_000, 3), (3, "0" * 5000 + "a", 4)], "doc_id long, text string, score int")
    assert len([r for r in T.score(docs, model).collect() if 0 <= r.score <= 1]) == 5
    assert T.score(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([(None, 1), (7, None)], "doc_id long, toxic int")
    m = T.fit(docs, labels)
    assert max(r.score for r in T.score(docs, m).collect()) < 0.3
    assert T.fit(docs.limit(0), labels.limit(0)).weights == {}
    assert {r.doc_id: r.restored for r in T.restored(docs, model).collect()}[None] == ""
