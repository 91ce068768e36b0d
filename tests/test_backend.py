import public_tokenizers
from pyspark.sql import functions as F

from corpusgraph.functions.tokens import encoding, token_count
from corpusgraph.operators.backend import GraphTables

ONE = "int used(int x) { return x; }\n"
TWO = "int main() { return used(2); }\n"


def test_files_come_change_and_go(spark, tmp_path):
    files = spark.createDataFrame([("a.cpp", ONE), ("b.cpp", TWO)], "file_path string, source string")
    g = GraphTables(spark).add_files(files, "p")
    names = lambda g: sorted(r.name for r in g.nodes().where("entity_type = 'function'").collect())
    calls = lambda g: [(r.src.split(":")[-1], r.dst.split(":")[-1]) for r in g.edges().where("relation_type = 'CALLS'").collect()]
    assert names(g) == ["main", "used"] and calls(g) == [("main", "used")]
    changed = g.update_files(spark.createDataFrame([("a.cpp", "int other(int x) { return x; }\n")], "file_path string, source string"), "p")
    assert names(changed) == ["main", "other"] and calls(changed) == [] and names(g) == ["main", "used"]
    assert names(changed.remove_files(files.where("file_path = 'b.cpp'"), "p")) == ["other"] and changed.remove_files(files, "q").nodes().count() == 4
    main = "p:b.cpp:function:main"
    assert g.get_entity(main).first()["name"] == "main" and g.get_entity("nobody").count() == 0
    assert g.get_entities_in_file("a.cpp", "p").count() == 2
    assert [r.id for r in g.get_neighbors(main, "out", ["CALLS"]).collect()] == ["p:a.cpp:function:used"] == [r.id for r in g.get_impact_scope(main).collect()]
    assert g.get_paths(main, "p:a.cpp:function:used").first().hops == 1
    g.save(str(tmp_path / "g"))
    again = GraphTables.load(spark, str(tmp_path / "g"))
    assert {tuple(r) for r in again.stats().collect()} == {tuple(r) for r in g.stats().collect()}
    again.remove_relation(main, "p:a.cpp:function:used").save(str(tmp_path / "g"))  # where it was loaded from
    assert calls(GraphTables.load(spark, str(tmp_path / "g"))) == []
    assert again.clear().nodes().count() == 0 and GraphTables.load(spark, str(tmp_path / "none")).edges().count() == 0


def test_upserts(spark):
    edge = lambda *rows: spark.createDataFrame(rows, "src string, dst string, relation_type string")
    g = GraphTables(spark).add_relations(edge(("x", "y", "CALLS")))
    assert sorted(r.id for r in g.nodes().collect()) == ["x", "y"] and g.nodes().where("name is not null").count() == 0
    g = g.add_entities(spark.createDataFrame([("x", "X"), ("z", "Z")], "id string, name string")).add_relations(edge(("x", "y", "REFERENCES")))
    assert {(r.id, r["name"]) for r in g.nodes().collect()} == {("x", "X"), ("y", None), ("z", "Z")}
    assert [r.relation_type for r in g.edges().collect()] == ["REFERENCES"]


def test_an_extractor_can_be_given(spark):
    def extract(files, project):
        nodes = files.select(F.concat(F.lit(project + ":"), "file_path").alias("id"), F.lit(project).alias("project_id"), "file_path", F.lit("file").alias("entity_type"), F.col("file_path").alias("name"))
        return nodes, files.select(F.lit("a").alias("src"), F.lit("b").alias("dst"), F.lit("CALLS").alias("relation_type")).limit(1), None

    chunks = spark.createDataFrame([("f.x", "t")], "file_path string, text string")
    g = GraphTables(spark, extract=extract).add_chunks(chunks, "p").update_chunks(chunks, "p")
    assert sorted(r.id for r in g.nodes().collect()) == ["a", "b", "p:f.x"]


def test_token_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    df = spark.createDataFrame([("don't count 12345 words\n\n",), ("",), (None,), ("é" * 30,)], "text string")
    made = encoding(path)
    want = {t: None if t is None else len(made.encode_ordinary(t)) for (t,) in df.collect()}
    assert {r.text: r.n for r in df.select("text", token_count("text", path).alias("n")).collect()} == want
    rough = {t: None if t is None else len(t) // 4 for t in want}
    for p in (None, "/nowhere/ranks"):
        assert {r.text: r.n for r in df.select("text", token_count("text", p).alias("n")).collect()} == rough
