import random

import pytest
import xxhash

from corpusgraph.llm import simhash as S


def brute_fp(text):
    import re

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not ws:
        return 0
    sh = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fps = [brute_fp(t) for _, t in rows]
    comp = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 2 and comp[i] > comp[j]:
                    comp[i], changed = comp[j], True
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[i] and rows[j][0] is not None]
        out.append((rows[i][0], f"{fps[i]:016x}", min(ids) if ids else None))
    return sorted(out, key=str)


def fixture_rows():
    r = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(30, 400))) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(40):  # near copies, exact copies
        t = r.choice(base).split()
        for _ in range(r.randint(0, 3)):
            t[r.randrange(len(t))] = r.choice(words).upper()
        rows.append((100 + i, " ".join(t)))
    return rows + [(200, None), (201, ""), (202, " \t\n\x0b"), (203, "One"), (204, "one two"), (205, "é À ß"), (5, base[0]), (5, base[1]), (None, base[2]), (None, "alone here now ok"), (206, "x " * 70000)]


def test_matches_brute_force(spark):
    rows = fixture_rows()
    df = spark.createDataFrame([(a, b, "x", "y") for a, b in rows], "doc_id long, text string, fp string, component_id string")
    got = sorted([tuple(x) for x in S.near_duplicate_classes(df).select("doc_id", "fingerprint", "component_id").collect()], key=str)
    assert got == brute_components(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicate_classes(df).count() == 0 and S.keep_first_of_class(df).count() == 0


def test_large_shards_are_dealt_again(spark):
    r = random.Random(1)
    base = r.getrandbits(64)
    values = {base}
    for _ in range(600):
        x = base
        for b in r.sample(range(64), r.randint(1, 5)):
            x ^= 1 << b
        values.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in values], "fp long")
    whole = {tuple(x) for x in S.linked(sorted(values))}
    from corpusgraph.llm.components import connected_components

    def classes(pairs):
        up = {x: x for x in values}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            up[find(a)] = find(b)
        groups = {}
        for x in values:
            groups.setdefault(find(x), set()).add(x)
        return {frozenset(g) for g in groups.values()}

    got = [(x.node % 2**64, x.root % 2**64) for x in connected_components(S.links(df, max_shard=8)).collect()]
    assert classes(got) == classes(whole)


def test_keep_first_keeps_columns(spark):
    df = spark.createDataFrame([(2, "a b c d", 1), (1, "a b c d", 2), (1, "a b c d", 3), (3, "other words in here", 4), (None, None, 5), (None, "", 6)], "doc_id long, text string, _cg int")
    out = S.keep_first_of_class(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 3]
    assert len([r for r in rows if r.doc_id is None]) == 1



@pytest.mark.parametrize("text", ["", "a", "A b", "The the THE the", "x\x1fy z w"])
def test_fingerprint(text):
    assert S.simhash64(text.encode()) == brute_fp(text)


def jaccard_components(rows, least=0.8):
    sets = []
    for _, t in rows:
        ws = (t or "").lower().split()
        sets.append({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else {()})
    comp = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if comp[i] > comp[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                    comp[i], changed = comp[j], True
    return {rows[i][0]: min(rows[j][0] for j in range(len(rows)) if comp[j] == comp[i]) for i in range(len(rows))}


def similar_rows():
    r = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(60, 700))) for _ in range(30)]
    rows = list(enumerate(base))
    for i in range(150):
        t = r.choice(base).split()
        for _ in range(r.choice([0, 1, 2, len(t) // 80, len(t) // 4])):  # near copies, and others that are far off
            t[r.randrange(len(t))] = r.choice(words)
        rows.append((100 + i, " ".join(t)))
    common = " ".join(r.choice(words) for _ in range(60))
    rows += [(300 + i, common + " " + " ".join(r.choice(words) for _ in range(90))) for i in range(40)]  # a shared passage isn't a copy
    return rows + [(400, None), (401, ""), (402, "one two"), (403, "ONE two"), (404, "one two three")]


def test_similar_classes_match_exact_similarity(spark):
    rows = similar_rows()
    want = jaccard_components(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (S.HOT, 5):
        got = {r.doc_id: r.component_id for r in S.similar_classes(df, hot=hot).collect()}
        assert got == want, [(i, got[i], want[i]) for i in got if got[i] != want[i]]


def test_similar_classes_of_odd_rows(spark):
    df = spark.createDataFrame([(5, "a b c d e f g", 1), (5, "a b c d e f g", 2), (4, "A b c d e f g", 3), (None, "a b c d e f g", 4), (None, None, 5), (7, "x " * 30_000, 6)], "doc_id long, text string, node int")
    out = S.similar_classes(df)
    assert sorted(((r.doc_id, r.component_id) for r in out.collect()), key=str) == sorted([(5, 4), (5, 4), (4, 4), (None, 4), (None, None), (7, 7)], key=str)
    kept = S.keep_first_of_class(df, out).collect()
    assert sorted(r.node for r in kept) == [3, 5, 6]
    assert S.similar_classes(df.limit(0)).count() == 0


def test_sketches():
    import numpy as np

    r = np.random.default_rng(1)
    for n in (40, 400, 6000):
        for share in (0.5, 0.8, 0.95):
            both = r.integers(0, 1 << 63, int(n * share), dtype=np.uint64) * np.uint64(2)
            a, b = (np.unique(np.r_[both, r.integers(0, 1 << 63, (n - len(both)) // 2, dtype=np.uint64) * np.uint64(2)]) for _ in range(2))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            one, two = (np.frombuffer(S.sketch_of(x), np.uint8) for x in (a, b))
            got = S.similarities(one[None], two)[0]
            assert abs(got - true) < 0.09


def test_a_doubtful_pair_that_fails_hides_no_other(spark):
    """Families that share boilerplate, with pairs on both sides of 0.8 that sketches can't tell apart."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for f in range(12):
        base = [r.choice(words) for _ in range(420)]
        for k in range(14):
            t, at = list(base), r.randrange(8)
            for q in range(r.randint(6, 9)):  # each changed word takes five shingles
                t[(at + 50 * q + r.randint(0, 8)) % len(t)] = r.choice(words)
            rows.append((100 * f + k, " ".join(t)))
    want = jaccard_components(rows)
    got = {x.doc_id: x.component_id for x in S.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want, [(i, got[i], want[i]) for i in got if got[i] != want[i]]


def test_similar_texts_with_fingerprints_far_apart_link(spark):
    """A passage repeated in one of two near copies moves the fingerprint, which counts repeats, not the set."""
    r = random.Random(6)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for k in range(20):
        body, passage = ([r.choice(words) for _ in range(n)] for n in (340, 60))
        rows += [(2 * k, " ".join(body + passage)), (2 * k + 1, " ".join(body + passage * 20))]
    far = [k for k in range(20) if (S.simhash64(rows[2 * k][1].encode(), 5) ^ S.simhash64(rows[2 * k + 1][1].encode(), 5)).bit_count() > 22]
    assert far
    got = {x.doc_id: x.component_id for x in S.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == jaccard_components(rows) and all(got[2 * k + 1] == 2 * k for k in far)


def test_classes_do_not_depend_on_the_size_of_shards(spark):
    """Pairs that share one key only are found in a shard that was dealt out as in a small one."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for k in range(200):
        t = [r.choice(words) for _ in range(200)]
        rows += [(2 * k, " ".join(t)), (2 * k + 1, " ".join(t[:132] + [r.choice(words) for _ in range(60)]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    small, dealt = ({x.doc_id: x.component_id for x in S.similar_classes(df, similarity=0.45, hot=hot).collect()} for hot in (S.HOT, 1))
    assert dealt == small, [(i, dealt[i], small[i]) for i in small if dealt[i] != small[i]]
