import itertools
import random

from corpusgraph.llm import licenses as L


def brute_align(a, b):
    """Patience alignment by its definition, recursively; anchors by trying every subset of the unique words."""
    if not a or not b:
        return 0
    if a[0] == b[0]:
        return 1 + brute_align(a[1:], b[1:])
    if a[-1] == b[-1]:
        return 1 + brute_align(a[:-1], b[:-1])
    u = [(a.index(w), b.index(w)) for w in a if a.count(w) == 1 and b.count(w) == 1]
    best = max((s for n in range(len(u) + 1) for s in itertools.combinations(u, n) if all(x[1] < y[1] for x, y in zip(s, s[1:]))), key=len)
    if not best:
        return 0
    edges = [(-1, -1), *best, (len(a), len(b))]
    return len(best) + sum(brute_align(a[i + 1 : k], b[j + 1 : m]) for (i, j), (k, m) in zip(edges, edges[1:]))


def test_longest_increasing():
    r = random.Random(0)
    for _ in range(200):
        v = [r.randrange(9) for _ in range(r.randint(0, 9))]
        got = L.increasing(v)
        assert all(v[i] < v[j] for i, j in zip(got, got[1:]))
        assert len(got) == max((n for n in range(len(v) + 1) for s in itertools.combinations(v, n) if all(x < y for x, y in zip(s, s[1:]))), default=0)


def test_alignment_is_valid_and_as_long_as_brute_force():
    r = random.Random(1)
    exact = 0
    for _ in range(400):
        b = [r.choice("abcdefgh").encode() for _ in range(r.randint(0, 9))]
        a = [w if r.random() < 0.8 else b"z" for w in b if r.random() < 0.9]
        got = L.align(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
        u = [b.index(w) for w in a if a.count(w) == 1 and b.count(w) == 1]
        if u == sorted(u):  # only one longest run of anchors: the definition gives one answer
            inner = all(v == sorted(v) for i in range(len(a)) for k in range(i, len(a) + 1) for v in [[b.index(w) for w in a[i:k] if a[i:k].count(w) == 1 and b.count(w) == 1]])
            if inner and len(set(b)) == len(b):
                exact += 1
                assert len(got) == brute_align(a, b)
    assert exact > 50


def test_covered_windows_are_found_as_by_aligning_every_window():
    r = random.Random(5)
    covered = 0
    for _ in range(400):
        words = [f"w{i}" for i in range(r.choice([6, 12, 30]))]
        template = [r.choice(words) for _ in range(r.randint(4, 16))]
        text = []
        for _ in range(r.randint(1, 4)):
            text += [r.choice(words + ["z"] * 10) for _ in range(r.randint(0, 12))]
            text += [w if r.random() < 0.9 else "q" for w in template if r.random() < 0.93]
        t, ws = L.Template("t", " ".join(template)), L.words_of(" ".join(text).encode())
        brute = max((len(L.align(ws[a:e], t.words)) for a in range(len(ws)) for e in range(a + 1, min(len(ws), a + t.longest) + 1)), default=0)
        here = {}
        for k, w in enumerate(ws):
            if w in t.counts:
                here.setdefault(w, []).append(k)
        got, first, end = t.best(ws, here) if here else (0, 0, 0)
        need = 0.8 * len(t.words) - 1e-9
        covered += brute >= need
        assert (got >= need) >= (brute >= need), (template, text)
        assert got == 0 or len(L.align(ws[first:end], t.words)) <= end - first
    assert covered > 100


    a, b = b"x a q b c y".split(), b"a b p c".split()
    assert L.align(a, b) == [(1, 0), (3, 1), (4, 3)] and brute_align(a, b) == 3


def test_query_rows(spark):
    mit, apache = L.TEMPLATES["MIT"], L.TEMPLATES["Apache-2.0"]
    r = random.Random(2)
    noise = lambda n: " ".join(r.choice(["the", "of", "erthand", "is", "copy", "work"]) for _ in range(n))
    changed = " ".join(w for k, w in enumerate(mit.split()) if k % 12)
    rows = [
        (1, noise(300) + "\n" + mit.upper() + "\n" + noise(300)), (2, noise(50) + changed + noise(20)), (3, noise(3000)), (4, None), (4, ""), (None, "Released under the MIT License."),
        (5, "Released under the MIT License. " * 3 + noise(10)), (6, " ".join(mit.split()[:60])), (7, apache), (8, noise(5) + " Licensed under CC BY-NC 4.0. " + noise(5)), (9, "the " * 60_000),
        (10, "This work is licensed under the GNU General Public License, version 3." + noise(40)),
    ]
    df = spark.createDataFrame([(a, b, "c") for a, b in rows], "doc_id long, text string, license string")
    got = {(x.doc_id, x.n_words): x for x in L.scan(df).collect()}
    name = {k[0]: v.license for k, v in got.items() if k[0] != 4}
    assert name == {1: "MIT", 2: "MIT", 3: None, None: "MIT-line", 5: "MIT-line", 6: None, 7: "Apache-2.0", 8: "CC-BY-NC-4.0-line", 9: None, 10: "GPL-3.0-line"}
    one = next(v for k, v in got.items() if k[0] == 1)
    assert one.coverage == 1.0 and one.end_word - one.first_word == one.n_matched == len(L.words_of(mit.encode()))
    assert next(v for k, v in got.items() if k[0] == 7).licenses == ["Apache-2.0", "Apache-2.0-line"]
    assert len(got) == 11 and L.scan(df.limit(0)).count() == 0


def test_whole_table(spark):
    """Documents with a license line are found, and no others."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = {"MIT-line": "Released under the MIT License.", "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.", "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0."}
    want = {(r.doc_id, n) for r in docs.collect() for n, t in lines.items() if t in r.text}
    got = {(r.doc_id, n) for r in L.scan(docs).collect() for n in r.licenses}
    assert want and want <= got and len(got - want) <= len(want) // 20


def test_copies_that_repeat_or_lack_the_rarest_word():
    every = [L.Template(n, t) for n, t in sorted(L.TEMPLATES.items())]
    names = lambda t: [x[0] for x in L.scan_text(t.encode(), every)[1]]
    assert names("x Released under the MIT License. Released under the MIT License. y") == ["MIT-line"]
    lacking = L.TEMPLATES["MIT"].replace("The above copyright", "The copyright")
    assert names("as said above " + "some other words " * 400 + lacking + " more words" * 300) == ["MIT"]


def test_lists_of_templates_in_parts(spark):
    mit, apache = L.TEMPLATES["MIT"], L.TEMPLATES["Apache-2.0"]
    rows = [(1, mit + " x " + apache), (1, mit), (None, apache), (2, None), (3, "Released under the MIT License.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = lambda out: sorted(((*r[:-1], sorted(r[-1])) for r in out.collect()), key=str)
    assert plain(L.scan(df, most=400)) == plain(L.scan(df)) and len(L.scan(df, most=400).columns) == 8
