import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusgraph.llm import token_counts as C
from corpusgraph.llm.bpe import Encoder, Vocabulary
from tests.llm.test_bpe import texts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(PATH)


def n(t):
    return len(TOK.encode(t, add_special_tokens=False).ids)


def test_random_edits_match_a_full_count(vocabulary):
    enc = Encoder(vocabulary)
    r = random.Random(4)
    some = [t for t in texts() if len(t) < 1500]
    for round_ in range(250):
        text = "".join(r.choice(some) for _ in range(r.randint(0, 4)))
        tree = C.TokenTree(vocabulary.words(text), vocabulary.words, lambda ws: list(map(len, enc.ids_of(ws))), block=r.choice([1, 2, 7, 64]))
        assert tree.tokens == n(text)
        for _ in range(6):
            a = r.randint(0, len(text) + 3)
            e = a + r.choice([0, 0, 1, 3, 40])
            new = r.choice(["", " ", "x", "'", "re", ">", "<|endoftext|>", "  \n", r.choice(some)[:30], "é"])
            tree.apply(a, e, new)
            a, e = min(a, len(text)), min(max(e, a), len(text))
            text = text[:a] + new + text[e:]
            assert tree.text() == text
            assert [w for ws in tree.words for w in ws] == vocabulary.words(text), (round_, text)
            assert (tree.tokens, tree.chars, tree.pretokens) == (n(text), len(text), len(vocabulary.words(text)))


def test_only_the_touched_part_is_counted_again(vocabulary):
    enc = Encoder(vocabulary)
    text = "the quick brown fox " * 5000
    tree = C.TokenTree(vocabulary.words(text), vocabulary.words, lambda ws: list(map(len, enc.ids_of(ws))))
    for k in range(20):
        tree.apply(1000 + 400 * k, 1003 + 400 * k, "lazy")
    assert tree.recounted < 20 * 40 and tree.tokens == n(tree.text())


def test_query_rows(spark):
    rows = [(1, "mail a.b@c.org now"), (None, None), (1, ""), (2, "x " * 40_000 + "password=abc"), (3, "<|endoftext|>")]
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id long, text string, n_tokens int")
    got = sorted((r.n_tokens, r.n_edits, r.n_tokens_after, r.n_chars_after) for r in C.count_with_edits(df, PATH).collect())

    def after(t):
        return "# Document\n" + C.REDACT.sub(C.REDACTED, t)

    assert got == sorted((n(t or ""), len(C.redaction_edits(t or "")), n(after(t or "")), len(after(t or ""))) for _, t in rows)
    assert C.count_with_edits(df.limit(0), PATH).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted((r.doc_id, n(r.text), n("# Document\n" + C.REDACT.sub(C.REDACTED, r.text))) for r in docs.collect())
    assert sorted((r.doc_id, r.n_tokens, r.n_tokens_after) for r in C.count_with_edits(docs, PATH).collect()) == want
