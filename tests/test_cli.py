import json

import pytest

from corpusgraph import cli
from corpusgraph.sources import files, sinks
from corpusgraph.sources.store import Store


def test_index_query_graph(spark, tmp_path):
    src = tmp_path / "proj"
    src.mkdir()
    (src / "a.cpp").write_text('#include "b.hpp"\nint helper(int x) { return x; }\nint main() { return helper(1) + used(2); }\n')
    (src / "b.hpp").write_text("int used(int x) { return x; }\nclass Base { };\nclass Child : public Base { };\n")
    (src / "m.py").write_text("def f():\n    return 1\n")
    (src / "secret.md").write_text("# Keys\nnothing\n")
    (src / ".privacy_config.json").write_text('{"extensions": [".md"]}')
    store = str(tmp_path / "store")
    first = cli.index(spark, str(src), store)
    assert first == cli.IndexRun({"added": 4}, 4, 7, 1, 1)
    assert cli.index(spark, str(src), store) == cli.IndexRun({"skipped": 4})
    (src / "m.py").write_text("def g():\n    return 2\n")
    (src / "secret.md").unlink()
    assert cli.index(spark, str(src), store) == cli.IndexRun({"skipped": 2, "updated": 1, "removed": 1}, 1, 1, 0, 2)
    other = tmp_path / "other"
    other.mkdir()
    (other / "z.py").write_text("class Z:\n    pass\n")
    cli.index(spark, str(other), store)
    chunks = cli.chunks_of(spark, store)
    assert {r.name for r in chunks.where("collection = 'rag_index'").collect()} == {"helper", "main", "used", "Base", "Child", "g", "Z"}
    assert sorted(r.text for r in chunks.where("collection = 'project_index'").collect())[1].startswith("Project proj focuses on 6 indexed documents.")
    hits = cli.search(spark, store, "anything", 3, language="cpp").collect()
    assert len(hits) == 3 and all(h.language == "cpp" and h.sanitized for h in hits)
    assert cli.search(spark, store, "helper function", 2, rerank=True).count() == 2
    names = lambda w, e: {r["name"] for r in cli.graph_command(spark, store, w, e).collect()}
    assert names("callers", "used") == {"main"} and names("callees", "main") == {"helper", "used"} and names("hierarchy", "Child") == {"Base"}
    assert {r.role for r in cli.graph_command(spark, store, "impact", "main").collect()} == {"direct_callee", "transitive"}
    assert [r.path for r in cli.graph_command(spark, store, "paths", "main", to="used").collect()] == [" -> ".join(x for x in ("{0}:a.cpp:function:main", "{0}:b.hpp:function:used")).format(cli.project_of(spark, str(src)))]
    assert cli.graph_command(spark, store, "stats").where("name = 'nodes'").first().n == 7
    assert "helper" in cli.graph_command(spark, store, "export", form="html")
    assert cli.dry_run(spark.createDataFrame([(".py", "a\nb")], "ext string, source string")).first().lines == 2
    sinks.write_document(cli.graph_command(spark, store, "export", form="json"), str(tmp_path / "graph"))
    part = next(p for p in (tmp_path / "graph").iterdir() if p.name.startswith("part"))
    document = json.loads(part.read_text())
    nodes, edges = files.graph_json(spark, str(part))
    assert len(document["nodes"]) == nodes.count() == 7 and len(document["edges"]) == edges.count() > 3
    assert {(e["source"], e["target"], e["relation_type"]) for e in document["edges"]} == {(r.src, r.dst, r.relation_type) for r in edges.collect()}


def test_everything_of_a_removed_file_goes(spark, tmp_path):
    """Also when it was the last file, or the last C++ file, of its project."""
    src, store = tmp_path / "p", str(tmp_path / "s")
    src.mkdir()
    (src / "a.cpp").write_text("int one() { return two(); }\n")
    (src / "b.cpp").write_text("int two() { return 1; }\n")
    (src / "c.py").write_text("def three():\n    pass\n")
    cli.index(spark, str(src), store)
    calls = lambda: cli.stored_graph(spark, store)[1].where("relation_type = 'CALLS'").count()
    assert calls() == 1
    (src / "b.cpp").write_text("int other() { return 1; }\n")  # what a.cpp calls is gone, though a.cpp isn't parsed again
    cli.index(spark, str(src), store)
    assert calls() == 0
    (src / "b.cpp").write_text("int two() { return 1; }\n")
    cli.index(spark, str(src), store)
    assert calls() == 1
    for name in ("a.cpp", "b.cpp"):
        (src / name).unlink()
    assert cli.index(spark, str(src), store).counts == {"skipped": 1, "removed": 2}
    nodes, edges = cli.stored_graph(spark, store)
    assert nodes.count() == edges.count() == 0 and cli.chunks_of(spark, store).where("collection = 'rag_index'").count() == 1
    (src / "c.py").unlink()
    assert cli.index(spark, str(src), store).counts == {"removed": 1}
    assert cli.chunks_of(spark, store).count() == 0
    where = Store(spark, store)
    assert where.live("hashes").count() == 0 and where.drop_old_snapshots() > 0
    assert cli.chunks_of(spark, store).count() == 0 and where.live("nodes").count() == 0


def test_only_changed_files_are_parsed_and_a_failed_run_leaves_the_store_as_it_was(spark, tmp_path):
    src, store = tmp_path / "p", str(tmp_path / "s")
    src.mkdir()
    for n in range(4):
        (src / f"f{n}.py").write_text(f"def f{n}():\n    return {n}\n")
    parsed = spark.sparkContext.accumulator(0)
    note = lambda path, action: parsed.add(1)
    cli.index(spark, str(src), store, progress=note)
    once = parsed.value
    assert once == 4
    (src / "f1.py").write_text("def changed():\n    pass\n")

    def broken(texts):
        raise RuntimeError("no embedder")

    with pytest.raises(Exception, match="no embedder"):
        cli.index(spark, str(src), store, encode=broken)
    assert {r.name for r in cli.chunks_of(spark, store).where("collection = 'rag_index'").collect()} == {"f0", "f1", "f2", "f3"}
    before = parsed.value
    cli.index(spark, str(src), store, progress=note)
    assert parsed.value - before == 1
    assert sorted(r.name for r in cli.chunks_of(spark, store).where("collection = 'rag_index'").collect()) == ["changed", "f0", "f2", "f3"]


def test_models_in_the_loop(spark, tmp_path):
    src, store = tmp_path / "p", str(tmp_path / "s")
    src.mkdir()
    (src / "a.cpp").write_text("int apple() { return banana(); }\nint banana() { return 1; }\nint cherry() { return 2; }\n")
    (src / "b.py").write_text("def banana_split():\n    return 'apple'\n")

    def encode(texts):
        return [[float(t.count(w)) for w in ("apple", "banana", "cherry")] for t in texts]

    def complete(prompt):
        return "It is about fruit."

    cli.index(spark, str(src), store, complete=complete, encode=encode)
    best = cli.search(spark, store, "cherry cherry", 1, encode=encode).first()
    assert best.name == "cherry" and best.semantic_summary == "It is about fruit."
    row = cli.run_query(spark, store, "cherry?", 2, complete, encode=encode).first()
    assert row.answer == "It is about fruit." and "cherry" in row.prompt and row.total_tokens > row.chunk_tokens
    near = cli.search(spark, store, "apple apple", 1, language="cpp", encode=encode, hybrid=True).collect()
    assert [r.name for r in near][:1] == ["apple"] and "banana" in {r.name for r in near}
    assert "banana" in cli.run_query(spark, store, "apple apple", 1, None, hybrid=True, language="cpp", encode=encode).first().prompt


def test_events(spark, tmp_path):
    src = tmp_path / "p"
    src.mkdir()
    (src / "a.py").write_text("def a():\n    pass\n")
    events = list(cli.index_events(spark, str(src), str(tmp_path / "s"), every=0.05))
    assert [e["event"] for e in events][:2] == ["status", "progress"] and events[1]["data"]["total"] == 1
    assert events[-1] == {"event": "done", "data": {"total_files": 1, "total_chunks": 1, "added": 1, "message": "Indexing complete"}}
    bad = list(cli.index_events(spark, str(src), str(tmp_path / "s2"), languages="none"))
    assert bad[-1]["event"] == "error" and "no known language" in bad[-1]["data"]["message"]


def test_watch(spark, tmp_path):
    src = tmp_path / "w"
    src.mkdir()
    (src / "a.py").write_text("def a():\n    pass\n")
    looks = cli.watch_folder(spark, str(src), str(tmp_path / "s"), ticks=3, seconds=0)
    assert next(looks) == {"added": 1} and next(looks) == {}
    (src / "a.py").unlink()
    (src / "build").mkdir()
    (src / "build" / "b.md").write_text("# B\n")  # a watch excludes nothing
    assert next(looks) == {"added": 1, "removed": 1}
