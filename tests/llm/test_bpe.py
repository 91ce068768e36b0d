import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusgraph.llm import bpe as B

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return B.Vocabulary(PATH)


def texts():
    r = random.Random(3)
    alphabet = list("abcdefghijklmnopqrstuvwxyzABC   \n\t\r'.,!?$%-_=0123456789éßñ") + ["'re", "'ll", "  ", " ", " ", "　", "\x1c", "\x1f", "\x85", "​", "᠎", "中", "文", "😀", "а", "۳", "²", "½", "́", "<|endoftext|>", "<|endof", "\x00", "﻿", "the ", "tion", "ing "]
    out = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 200))) for _ in range(400)]
    return out + ["", " ", "a" * 3000, "ab" * 2000, "<|endoftext|>", "<|endoftext|><|endoftext|> x", "x" + " " * 300, "\n\n\n a", "don't can't we'll I'VE", "the " * 2000]


def test_encode_and_decode_match_the_library(vocabulary):
    enc = B.Encoder(vocabulary)
    assert enc.ids_of([]) == []
    for t in texts():
        want = TOK.encode(t, add_special_tokens=False).ids
        assert enc.encode(t) == want, t
        assert vocabulary.decode(want) == TOK.decode(want, skip_special_tokens=False)


def test_decode_of_any_ids(vocabulary):
    r = random.Random(5)
    for _ in range(200):
        ids = [r.randrange(50257) for _ in range(r.randint(0, 20))]
        assert vocabulary.decode(ids) == TOK.decode(ids, skip_special_tokens=False)


def test_both_merges_agree(vocabulary):
    r = random.Random(7)
    words = ["".join(r.choice("aeinorst hld") for _ in range(r.randint(1, 48))).encode() for _ in range(2000)]
    assert vocabulary.merge_many(words) == [vocabulary.merge_one(w) for w in words]


def test_transducer(tmp_path):
    r = random.Random(2)
    words = {"".join(r.choice("abcé") for _ in range(r.randint(1, 6))).encode() for _ in range(400)}
    entries = {w: [r.randrange(9) for _ in range(r.randint(1, 4))] for w in words}
    tables = B.Transducer.compile(entries)
    (tmp_path / "t").write_bytes(B.Transducer.dump(tables))
    t = B.Transducer(str(tmp_path / "t"))
    ask = sorted(words) + [b"", b"zz", b"abcabcabc", b"a" * 50]
    for w, p in zip(ask, t.look_up(ask), strict=True):
        assert (t.ids_at(int(p)) if p >= 0 else None) == entries.get(w)
    suffixes = {w[i:] for w in words for i in range(len(w) + 1)}
    # minimal: as many states as different sets of endings
    rights = {frozenset(x[len(p) :] for x in words if x.startswith(p)) for w in words for p in (w[:i] for i in range(len(w) + 1))}
    assert len(tables["final"]) == len(rights) and len(rights) <= len(suffixes)
    (tmp_path / "e").write_bytes(B.Transducer.dump(B.Transducer.compile({})))
    assert B.Transducer(str(tmp_path / "e")).look_up([b"a", b""]).tolist() == [-1, -1]


def row(i, t):
    ids = TOK.encode(t or "", add_special_tokens=False).ids
    return (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(TOK.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_query_rows(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "a b"), (1, None), (1, "the the the"), (1, "the the the")]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, ids string")
    want = sorted((row(a, b) for a, b in rows), key=str)
    columns = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    for lexicon in (None, B.build_lexicon(df, PATH)):
        assert sorted([tuple(x) for x in B.encode_documents(df, PATH, lexicon, columns).collect()], key=str) == want
    whole = B.encode_documents(df, PATH, None, ("doc_id", "ids", "decoded")).collect()
    assert all(r.decoded == TOK.decode(r.ids, skip_special_tokens=False) for r in whole)
    empty = df.limit(0)
    assert B.encode_documents(empty, PATH, B.build_lexicon(empty, PATH), columns).count() == 0


def test_frequent_words_exist_at_every_size(spark):
    from pyspark.sql import functions as F

    for n in (F.lit(5_000_000), F.lit(2), F.col("id") + 4096, F.pmod(F.xxhash64("id"), F.lit(1 << 40)) + 1):
        counts = spark.range(200_000).select(F.concat(F.lit("w"), "id").alias("word"), n.cast("long").alias("n"))
        top = B.frequent_words(counts, 5000)
        assert 4500 < len(top) <= 5000 and len(set(top)) == len(top)
        least = sorted((r.n for r in counts.collect()), reverse=True)[5000]
        assert counts.where(F.col("word").isin(top)).agg(F.min("n")).first()[0] >= least / 2 ** (1 / 16) - 1
    assert B.frequent_words(counts.limit(0), 5) == [] and len(B.frequent_words(counts.limit(3), 5)) == 3


def test_whole_table(spark):
    from corpusgraph.llm.op5 import op5_bpe_encode_decode

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = sorted(tuple(x) for x in op5_bpe_encode_decode(spark, "/root/testdata/sf0.001").collect())
    assert got == sorted(row(r.doc_id, r.text) for r in docs)


def test_word_counts_are_whole(spark):
    """A piece that each batch sees once counts as often as it is there."""
    df = spark.createDataFrame([(f"once {'x' * 70} twice twice w{i}",) for i in range(6)] + [(None,), ("",)], "text string").repartition(8)
    got = {r.word: r.n for r in B.word_counts(df).collect()}
    assert got.pop("") == 1 and got == {"once": 6, "x" * 70: 6, "twice": 12} | {f"w{i}": 1 for i in range(6)}
