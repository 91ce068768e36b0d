import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusgraph.functions import text as T
from corpusgraph.operators import chunking as C
from corpusgraph.operators import enrich as N
from corpusgraph.operators import graph as G
from corpusgraph.operators import retrieval as R
from corpusgraph.operators import rules as S
from corpusgraph.sources import codecs as J
from corpusgraph.sources import files as X
from corpusgraph.sources import sinks as K
from corpusgraph.streaming.watch import Watch


@pytest.fixture
def tree(tmp_path):
    for p, t in {"a.py": "def f():\n    return 1\n", "src/b.CPP": "int x;", "src/c.cpp": "int f() { return 1; }\n", "build/d.py": "x", ".hidden/e.py": "x", "src/.f.py": "x", "g.pyc": "x", "docs/h.md": "# T\n", "empty.py": " \n", "bad.py": b"x = '\xff'\n", "i.txt": "x"}.items():
        f = tmp_path / "root" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(t if isinstance(t, bytes) else t.encode())
    return tmp_path / "root"


def test_discovery(spark, tree):
    got = {r.file_path: r for r in X.discover(spark, str(tree), ["python", "cpp", "doc"]).collect()}
    assert set(got) == {"a.py", "src/c.cpp", "docs/h.md", "empty.py", "bad.py"}
    assert got["bad.py"].source == "x = '�'\n" and got["a.py"].ext == ".py" and len(got["a.py"].content_hash) == 64
    watched = {r.file_path for r in X.discover(spark, str(tree), ["python"], exclude=False).collect()}
    assert watched >= {"build/d.py", ".hidden/e.py"} or watched >= {"build/d.py"}
    assert "empty.py" not in {r.file_path for r in X.with_text(X.discover(spark, str(tree))).collect()}
    assert X.languages_of("Python, nothing,cpp") == ["python", "cpp"]
    with pytest.raises(ValueError):
        X.languages_of("nothing")


def test_archives(spark, tmp_path):
    z = zipfile.ZipFile(tmp_path / "a.zip", "w")
    for n in ("x/a.py", "__MACOSX/a.py", ".git/b.py", "x/.c.py"):
        z.writestr(n, "1")
    z.close()
    with tarfile.open(tmp_path / "b.tgz", "w:gz") as t:
        for n in ("y/b.py", "y/.h"):
            i = tarfile.TarInfo(n)
            i.size = 2
            t.addfile(i, io.BytesIO(b"22"))
    (tmp_path / "plain.py").write_text("3")
    (tmp_path / "broken.zip").write_text("no archive")
    got = {r.file_path: r.source for r in X.archives(spark, str(tmp_path)).collect()}
    assert got == {"a.zip/x/a.py": "1", "b.tgz/y/b.py": "22", "plain.py/plain.py": "3"}


def test_json_sources(spark, tmp_path, monkeypatch):
    (tmp_path / "l.json").write_text(json.dumps({"files": [{"path": "a", "units": [{"name": "u", "type": "class", "start_line": 1, "end_line": 2}, {"name": "v", "type": "function", "start_line": 3, "end_line": 4}]}]}))
    assert [(r.file_path, r.name, r.kind, r.line_end) for r in X.unit_labels(spark, str(tmp_path / "l.json")).orderBy("line_start").collect()] == [("a", "u", "class", 2), ("a", "v", "function", 4)]
    item = {"file": "a", "name": "n", "type": "t", "line_start": 1, "line_end": 2, "best_match": {"type": "t", "name": "n", "line_start": 1, "line_end": 2}}
    for n, spec in enumerate(([item], {"labels": [item]})):
        (tmp_path / f"p{n}.json").write_text(json.dumps(spec))
        assert [(r.name, r.p_name, r.p_end) for r in X.pair_labels(spark, str(tmp_path / f"p{n}.json")).collect()] == [("n", "n", 2)]
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": "a", "name": "A"}, {"id": "b"}], "links": [{"source": "a", "target": "b", "relation_type": "CALLS"}]}))
    n, e = X.graph_json(spark, str(tmp_path / "g.json"))
    assert n.count() == 2 and [tuple(r)[:3] for r in e.collect()] == [("a", "b", "CALLS")]
    (tmp_path / "broken.json").write_text("{")
    for p in ("broken.json", "missing.json"):
        n, e = X.graph_json(spark, str(tmp_path / p))
        assert n.count() == 0 and e.count() == 0
    assert X.table_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0
    (tmp_path / ".privacy_config.json").write_text(json.dumps({"exact_paths": ["a.h"], "enabled": False}))
    monkeypatch.delenv("PRIVACY_CONFIG_PATH", raising=False)
    assert X.privacy_rules(None, [str(tmp_path)]) == S.PrivacyRules(exact_paths=("a.h",), enabled=False)
    assert X.privacy_rules(None, []) is None and X.privacy_rules({"privacy": {"extensions": [".pem"]}}).extensions == (".pem",)


def test_privacy_rules(spark):
    rules = S.PrivacyRules(("secret/a.h",), ("vault/",), (r"key_\d+", "("), (".PEM",))
    paths = {"x/secret/a.h": True, "x\\secret\\a.h": True, "vault/b.c": True, "x/vault": True, "c.pem": True, ".pem": False, "key_12.c": True, "key_.c": False, "plain.c": False, None: False}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.v for r in df.select("p", S.is_private("p", rules).alias("v")).collect()} == paths
    off = S.PrivacyRules(rules.exact_paths, enabled=False)
    assert not any(r.v for r in df.select(S.is_private("p", off).alias("v")).collect())
    assert "total=5" in rules.summary()


def test_sensitive(spark):
    texts = {"call +1 (555) 123-4567 now": ["phone"], "#define A 100000000UL\n#define B 115200": [], "me@x.org password: hunter2": ["email", "password"], "http://u:p@h/ 10.0.0.1": ["ipv4", "url_credentials"], None: []}
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r.text: r.h for r in df.select("text", S.sensitive_hits("text").alias("h")).collect()} == texts
    clean = df.where("text like '#define%'").withColumn("chunk_id", F.lit("c"))
    assert S.require_clean(clean).count() == 1
    with pytest.raises(Exception, match="Sensitive information detected in c: email"):
        S.require_clean(df.where("text like 'me@%'").withColumn("chunk_id", F.lit("c"))).collect()


def test_leak_guard(spark):
    block = ["```x```", "module top (input a);", "a = 1;\nb = 2;", "f(x) {", "def go(", "uses class Foo"]
    keep = ["It adds numbers.", "", "one; two\nplain\nplain\nplain", "#include <x>"]
    got = {r.t: r.g for r in spark.createDataFrame([(t,) for t in block + keep], "t string").select("t", S.leak_guard("t").alias("g")).collect()}
    assert all(got[t] == S.BLOCK_MESSAGE for t in block) and all(got[t] == t for t in keep)


def test_windows(spark):
    for n in (1, 2, 10, 47, 48, 49, 60, 61, 130):
        src = "\n".join(f"l{i}" for i in range(n))
        df = spark.createDataFrame([(src,)], "source string")
        got = [(r.name, r.line_start, r.line_end) for r in C.line_windows(df).orderBy("line_start").collect()]
        assert got == [(f"lines_{i + 1}_{min(i + 60, n)}", i + 1, min(i + 60, n)) for i in range(0, n, 48)]
    for n in (0, 1, 119, 120, 899, 900, 901, 1680, 1681, 5000):
        text, want, at = "x" * n, [], 0
        while n:
            want.append(text[at : at + 900])
            if at + 900 >= n:
                break
            at += 780
        assert spark.createDataFrame([(text,)], "t string").select(C.char_windows("t").alias("w")).first().w == want
    assert C.line_windows(spark.createDataFrame([(None,)], "source string")).count() == 0
    md = spark.createDataFrame([("pre\n# A\nx\n## B\n\n",), ("## only",), (" \n",)], "source string")
    got = [(r.kind, r["name"], r.line_start, r.line_end) for r in C.markdown_sections(md).orderBy("source", "chunk_index").collect()]
    assert got == [("section", "only", 1, 1), ("paragraph", "section_0", 1, 1), ("section", "A", 2, 3), ("section", "B", 4, 6)]


CHUNKS = "chunk_id string, text string, file_path string, language string, chunk_type string, name string, line_start int, line_end int, seq long"


def chunks(spark):
    return spark.createDataFrame([("c1", "int f() { return 1; }", "a/x.cpp", "cpp", "function", "f", 1, 1, 1), ("c2", "mail me@x.org", "b/y.cpp", "cpp", "function", "g(me@x.org)", 2, 3, 2), ("c3", "def h(): pass", "a/z.py", "python", "function", "h", 1, 1, 3)], CHUNKS)


def test_enrichment(spark):
    out = N.annotate(N.mark_private(N.sanitize(chunks(spark), "P", "/p"), S.PrivacyRules(directories=("b",))), "id1", "P", "/p")
    rows = {r.chunk_id: r for r in out.collect()}
    assert rows["c1"].declaration == "int f();" and rows["c1"].text.startswith("project: P\n") and rows["c1"].sanitized and rows["c1"].document_kind == "sanitized_code"
    assert rows["c1"].semantic_summary == "f is a function in cpp defined at lines 1-1." and rows["c1"].sensitive_hits == []
    assert rows["c2"].sensitive_hits == ["email"] and rows["c2"].is_private and rows["c2"].privacy_summary.startswith("[PRIVACY-SAFE SUMMARY]")
    assert rows["c3"].text == "def h(): pass" and not rows["c3"].sanitized and rows["c3"].source_language_family == "python"
    s = N.project_summaries(out).first()
    assert s.text == "Project P focuses on 3 indexed documents. Representative symbols include f, g(me@x.org), h." and s.chunk_id == "project:id1:summary"


def test_models(spark):
    good = N.with_behavior(chunks(spark), lambda p: " fine ")
    assert {r.semantic_summary for r in good.collect()} == {"fine"}

    def broken(p):
        raise RuntimeError

    assert {r.semantic_summary for r in N.with_behavior(chunks(spark), broken).where("chunk_id = 'c1'").collect()} == {"f performs function logic in cpp and is defined at lines 1-1."}
    e = N.embed(spark.createDataFrame([("a", "x" * 1000), ("b", "y"), ("c", "")], "chunk_id string, text string"), lambda ts: [[float(len(t)), 2.0] for t in ts])
    assert {r.chunk_id: r.embedding for r in e.collect()} == {"a": [(900 + 220) / 2, 2.0], "b": [1.0, 2.0], "c": None}
    v = spark.createDataFrame([("x",)], "t string").select(N.hash_embedding("t").alias("v")).first().v
    import hashlib

    assert len(v) == 384 and abs(v[0] - int(hashlib.sha256(b"x").hexdigest()[:8], 16) % 100 / 100) < 1e-6


def test_prompt(spark):
    hits = spark.createDataFrame([("q", 2, "code2", "b.py", 3, 4, "function", None, "python", False, ""), ("q", 1, "hidden text", "a.c", 1, 2, "function", "P", "c", True, "safe words")], "query_id string, rank int, text string, file_path string, line_start int, line_end int, chunk_type string, project_name string, language string, is_private boolean, privacy_summary string")
    p = R.build_prompts(hits, "Why?").first()
    assert "hidden text" not in p.prompt and "safe words" in p.prompt and "[HIGH-CONFIDENTIAL]" in p.prompt and "File: b.py (lines 3-4), type=function\n```python\ncode2" in p.prompt
    assert p.prompt.index("a.c") < p.prompt.index("b.py") and p.prompt.endswith("\n---\n\nUser: Why?") and p.total_tokens == len(p.prompt) // 4 + 60


def test_two_stage_and_rerank(spark):
    summaries = spark.createDataFrame([("p1", 0.1), ("p2", 0.2), ("p3", 0.3), ("p4", 0.4), ("p1", 0.9)], "project_id string, score double")
    rows = spark.createDataFrame([(f"c{p}{k}", f"p{p}", float(5 - p) + k / 10) for p in range(1, 6) for k in range(7)], "chunk_id string, project_id string, score double")
    got = [r.chunk_id for r in R.two_stage(summaries, rows).collect()]
    assert got == ["c30", "c31", "c32", "c33", "c34"]
    assert [r.chunk_id for r in R.two_stage(summaries.limit(0), rows).collect()] == ["c50", "c51", "c52", "c53", "c54"]
    assert R.knn(spark.createDataFrame([("a", [0.0], "cpp"), ("b", [1.0], "c"), ("d", [2.0], "cpp")], "chunk_id string, embedding array<float>, language string"), [2.0], 2, language="cpp").collect()[0].chunk_id == "d"


def graph(spark):
    n = spark.createDataFrame([("p:f:namespace:n", "p", "f", "namespace", 'n"q', 1), ("p:f:class:A", "p", "f", "class", "A", 2), ("q:g:class:B", "q", "g", "class", "B<T>", 3)], "id string, project_id string, file_path string, entity_type string, name string, seq long")
    e = spark.createDataFrame([("p:f:namespace:n", "p:f:class:A", "CONTAINS", 1), ("p:f:class:A", "q:g:class:B", "CALLS", 2), ("p:f:class:A", "p:f:class:A", "CALLS", 3)], "src string, dst string, relation_type string, seq long")
    return n, e


def test_exports(spark, tmp_path):
    n, e = graph(spark)
    text = "\n".join(r.line for r in K.dot_lines(n, e).orderBy("part", "id", "line").collect())
    assert text.startswith("digraph KnowledgeGraph {") and 'subgraph cluster_p_f_namespace_n {\n    label="n\\"q";' in text and '"p:f:class:A" -> "q:g:class:B" [label="CALLS"];' in text and "CONTAINS" not in text and text.endswith("}")
    flat = "\n".join(r.line for r in K.dot_lines(n, e, cluster=False, project="p").orderBy("part", "id", "line").collect())
    assert "subgraph" not in flat and 'label="CONTAINS"' in flat and "q:g" not in flat
    K.write_lines(K.dot_lines(n, e), str(tmp_path / "dot"))
    assert spark.read.text(str(tmp_path / "dot")).count() > 5
    rows = K.export_json(n, e).collect()
    assert {json.loads(r.line).get("id") for r in rows if r.part == "nodes"} == {"p:f:namespace:n", "p:f:class:A", "q:g:class:B"} and json.loads(next(r.line for r in rows if r.part == "edges"))["source"]
    import xml.etree.ElementTree as ET

    root = ET.fromstring("".join(r.line for r in K.gexf_lines(n, e).orderBy("part", "id").collect()).split("?>", 1)[1])
    assert len(root.findall(".//{*}node")) == 3 and len(root.findall(".//{*}edge")) == 3
    page = K.html_page(n, e, "p")
    assert "<h1>p</h1>" in page and "2 nodes, 2 edges" in page and "q:g:class:B" not in page and "<h1>all</h1>" in K.html_page(n, e)
    with pytest.raises(ValueError):
        K.html_page(n, e, most=1)


def test_chunk_tables(spark, tmp_path):
    new = spark.createDataFrame([("c", "1", "p", "new"), ("c", "2", "p", "b")], "collection string, chunk_id string, project_id string, text string")
    old = spark.createDataFrame([("c", "1", "p", "old"), ("c", "0", "p", "z"), ("d", "1", "p", "other")], new.schema)
    out = K.upsert_chunks(old, new)
    assert sorted((r.collection, r.chunk_id, r.text) for r in out.collect()) == [("c", "0", "z"), ("c", "1", "new"), ("c", "2", "b"), ("d", "1", "other")]
    K.write_chunks(out, str(tmp_path / "t"))
    assert K.collection(spark, str(tmp_path / "t"), "d").count() == 1 and K.collection(spark, str(tmp_path / "t"), "no").count() == 0 == K.collection(spark, str(tmp_path / "none"), "c").count()
    size = K.stored_bytes(spark, str(tmp_path / "t")).first()
    assert size.files >= 2 and size.bytes > 500
    K.drop_collection(spark, str(tmp_path / "t"), "d")
    assert {r.collection for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {"c"}


def test_records(spark):
    n, e = graph(spark)
    for rows, schema, keys in ((n, J.ENTITY, ("id",)), (e, J.RELATION, ("src", "dst")), (chunks(spark), J.CHUNK, ("chunk_id",))):
        back = J.from_records(J.to_records(rows, *keys), schema)
        have = [c for c in back.columns if c in rows.columns]
        assert sorted(map(tuple, back.select(have).collect())) == sorted(map(tuple, rows.select(have).collect())) and len(have) >= 3
    odd = spark.createDataFrame([('{"src": "a", "more": 1}',), ("{",), (None,)], "record string")
    assert [tuple(r) for r in J.from_records(odd, J.RELATION).collect()] == [("a", None, None, None, None)]


def test_graph_cases(spark):
    n, e = graph(spark)
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(G.callers(e, G.ids(spark, "p:f:class:A"))) == ["p:f:class:A"]
    assert ids(G.neighbors(e, "p:f:class:A")) == sorted(["q:g:class:B", "p:f:class:A", "p:f:class:A", "p:f:namespace:n"])
    assert ids(G.stub_nodes(n.where("project_id = 'p'"), e)) == ["q:g:class:B"]
    assert G.simple_paths(e, "p:f:class:A", "p:f:class:A").count() == 0
    assert [r.path for r in G.simple_paths(e, "p:f:namespace:n", "q:g:class:B").collect()] == [["p:f:namespace:n", "p:f:class:A", "q:g:class:B"]]
    assert G.find_node(n, "A", ["class"]).first().id == "p:f:class:A" and G.find_file(n, "f").count() == 0 and G.in_file(n, "f", "p").count() == 2


def test_watch(spark, tmp_path):
    seen = []
    w = Watch(spark, str(tmp_path / "w"), lambda d, n: seen.append({r.status: r["count"] for r in d.groupBy("status").count().collect()}))
    for k, rows in enumerate(([("p", "a", "1"), ("p", "b", "1")], [("p", "a", "1"), ("p", "b", "2"), ("q", "a", "9")], [("p", "a", "1")])):
        w.apply(spark.createDataFrame(rows, "project_id string, file_path string, content_hash string"), k)
    assert seen == [{"added": 2}, {"skipped": 1, "updated": 1, "added": 1}, {"skipped": 1, "removed": 2}]
    assert w.changes().count() == 2 + 2 + 2


def test_ids(spark):
    import hashlib

    r = spark.range(1).select(T.chunk_id(F.lit("a/b.rs"), F.lit("rust"), F.lit("f"), F.lit("x::y/z")).alias("c"), T.project_id(F.lit("/p")).alias("p"), T.declaration(F.lit("  class X\n : Y { z }"), F.lit("cpp"), F.lit("class"), F.lit("X")).alias("d")).first()
    assert r.c == f"rus:{hashlib.sha256(b'a/b.rs').hexdigest()[:8]}:f:x__y_z:0" and r.p == hashlib.sha256(b"/p").hexdigest()[:12] and r.d == "class X : Y;"


def test_page_of_any_size(spark, tmp_path):
    """The lines of a page are one page, whatever a string of the driver may hold; equal and null ids too."""
    n = spark.createDataFrame([("b", "x</script>", "class", "p"), ("a", None, "file", "p"), ("a", None, "file", "p"), ("q", "q", "file", "q")], "id string, name string, entity_type string, project_id string")
    e = spark.createDataFrame([("a", "b", "CALLS"), ("a", "b", "CALLS"), ("b", "a", "USES"), ("a", "q", "CALLS")], "src string, dst string, relation_type string")
    K.write_document(K.html_lines(n, e, "p"), str(tmp_path / "page"))
    (part,) = (p for p in (tmp_path / "page").iterdir() if p.name.startswith("part"))
    page = part.read_text()
    data = json.loads(page.split("const graph=", 1)[1].split(", colors=", 1)[0])
    assert [x["id"] for x in data["nodes"]] == ["a", "a", "b"] and [(x["source"], x["target"], x["relation_type"]) for x in data["edges"]] == [("a", "b", "CALLS"), ("a", "b", "CALLS"), ("b", "a", "USES")]
    assert "3 nodes, 3 edges" in page and page.count("</script>") == 1 and data["nodes"][2]["name"] == "x</script>"
    K.write_document(K.html_lines(n.limit(0), e.limit(0)), str(tmp_path / "page"))
    assert '{"nodes": [\n], "edges": [\n]}' in next(p for p in (tmp_path / "page").iterdir() if p.name.startswith("part")).read_text()


def test_page_query_above_the_limit_of_a_string(spark, tmp_path):
    from corpusgraph.plans import registry

    for t in ("region", "nation", "customer", "part", "orders", "lineitem"):
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    spark.range(50_001).selectExpr("id as s_suppkey", "concat('s', id) as s_name", "cast(id % 25 as int) as s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    out = registry.QUERIES["export_html"](spark, str(tmp_path))
    assert out.where("type = 'supplier' and kind = 'node'").count() == out.where("type = 'INHERITS_FROM' and kind = 'edge'").count() == 50_001


def test_document_is_read_in_parallel(spark, tmp_path):
    """A document of an element a line is read in as many tasks as its bytes need, in its order; other layouts as before; a cut one is empty."""
    n = spark.range(3000).selectExpr("concat('n', lpad(id, 5, '0')) as id", "concat('{\"x, ', id, '\n') as name", "'file' as entity_type")
    e = spark.range(3000).selectExpr("concat('n', id % 7) as src", "concat('n', id % 3000) as dst", "'CALLS' as relation_type", "'k' as id")
    path = str(tmp_path / "d")
    K.write_document(K.graph_document(n, e.unionByName(e)), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        nodes, edges = X.graph_json(spark, path)
        assert nodes.rdd.getNumPartitions() > 4 and edges.count() == 3000
        assert [(r.id, r.name) for r in nodes.orderBy("seq").collect()] == sorted((r.id, r.name) for r in n.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (part,) = (p for p in (tmp_path / "d").iterdir() if p.name.startswith("part"))
    whole = json.loads(part.read_text())
    (tmp_path / "one.json").write_text(json.dumps(whole))
    (tmp_path / "cut.json").write_text(part.read_text()[:-5000])
    assert [df.count() for df in X.graph_json(spark, str(tmp_path / "one.json"))] == [3000, 3000] and [df.count() for df in X.graph_json(spark, str(tmp_path / "cut.json"))] == [0, 0]
