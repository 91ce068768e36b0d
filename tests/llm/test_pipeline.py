import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from corpusgraph.llm import quality
from corpusgraph.llm.common import read_table
from tests.llm.test_decontam import words
from tests.llm.test_simhash import jaccard_components
from tests.llm.test_suffix_dedup import WIDTH_CUT

DATA = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark):
    docs = read_table(spark, DATA, "documents")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    items = [r.text for r in read_table(spark, DATA, "benchmark").collect()]

    first = P.quality_filter(spark, docs, DATA)
    model = quality.fit(docs, read_table(spark, DATA, "labels"))
    p = dict(zip(rows, quality.probabilities(model, [r.text.encode() for r in rows.values()])))
    kept = {i for i in rows if p[i] >= 0.5}
    assert first.columns == columns and {r.doc_id for r in first.collect()} == kept
    bad = {r.doc_id for r in read_table(spark, DATA, "labels").where("quality = 0").collect()}
    assert len(bad & kept) <= len(bad) // 5 and len(rows) - len(kept) - len(bad - kept) <= len(rows) // 5

    second = P.near_dedup(spark, first, DATA)
    classes = jaccard_components([(i, rows[i].text) for i in sorted(kept)])
    left = {i for i in kept if classes[i] == i}
    assert second.columns == columns and {r.doc_id for r in second.collect()} == left

    third = P.suffix_dedup_stage(spark, second, DATA)
    cut = WIDTH_CUT([(i, rows[i].text) for i in sorted(left)])
    got = {r.doc_id: r for r in third.collect()}
    assert third.columns == columns
    assert {i: r.text for i, r in got.items()} == {i: t for i, t in cut.items() if t or not rows[i].text}
    assert all(r.n_chars == len(r.text) and (r.lang, r.source) == (rows[i].lang, rows[i].source) for i, r in got.items())

    fourth = P.decontaminate(spark, third, DATA)
    windows = {tuple(w[k : k + 10]) for w in map(words, items) if w for k in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    dirty = {i for i, r in got.items() for ws in [words(r.text)] if any(tuple(ws[k : k + n]) in windows for n in sizes for k in range(len(ws) - n + 1))}
    clean = {r.doc_id: r.text for r in fourth.collect()}
    assert fourth.columns == columns and clean == {i: r.text for i, r in got.items() if i not in dirty}

    fifth = P.encode(spark, fourth, DATA)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = fifth.collect()
    assert len(out) == len(clean) and all(r.ids == tok.encode(clean[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids) for r in out)


def test_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11, "x"), (1, "a b c d e f", "en", "s", 11, "x"), (None, None, None, None, None, None), (2, "", "en", "s", 0, "y"), (3, "q" * 200_000, "en", "s", 200_000, "z"), (4, "z" + "q" * 150, "en", "s", 151, "z")], "doc_id long, text string, lang string, source string, n_chars long, ids string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = P.run(spark, str(tmp_path)).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == 4 and got[1].text == "a b c d e f" and got[4].text == "z" and got[4].n_chars == 1 and got[4].ids == [89]
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
