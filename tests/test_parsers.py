import ast
import random

import pytest

from corpusgraph.operators import chunking as C
from corpusgraph.sources import parsers as P
from corpusgraph.sources.code_graph import build, extract
from corpusgraph.sources.cpp import Reader
from corpusgraph.sources.ranges import Range

TWO = '"""Doc."""\n\ndef one(a):\n    """One."""\n    return a\n\n\ndef two():\n    return 2\n'


def test_python_two_functions():
    rows = P.python_units(TWO, "x.py")
    assert [(r[0], r[1], r[3], r[4]) for r in rows] == [("function", "one", 3, 5), ("function", "two", 8, 9)]
    ast.parse(rows[0][2])


def test_python_special_cases():
    assert [r[0] for r in P.python_units('"""Only a text."""\n', "m.py")] == ["module_docstring"]
    assert isinstance(P.python_units("def broken(:\n    pass\n\ndef ok():\n    return 1\n", "b.py"), list)
    assert [r[1] for r in P.python_units("@deco\ndef hidden(): pass\n\nclass Shown:\n    def m(self): pass\n", "d.py")] == ["Shown"]
    long = "def f():\n" + "\n".join(f"    x{i} = 'ééé{i}' * 3 + 'padding padding'" for i in range(130)) + "\n"
    rows = P.python_units(long, "l.py")
    assert [r[1] for r in rows] == ["f_part_1", "f_part_2", "f_part_3"] and rows[1][3] == 49 and "ééé" in rows[1][2]


CPP = """#include "engine/core.hpp"
#include <vector>
// class Commented { };
namespace demo {
using Real = double;
struct Point { Real x; Real y; };
class Shape : public Base, private detail::Other {
 public:
  Shape(int a) : a_(a), p_{a} { init(); }
  virtual ~Shape() {}
  Real area(const Point& p, int n = call(3)) const { return helper(p) + obj.method(n) + demo::free_one(p); }
 private:
  Point center_;
  std::vector<Point> all_;
  int a_, p_;
};
class Forward;
template <typename T> class Box { T v; };
template <typename T>
T biggest(T a, T b) { return a > b ? a : b; }
template <typename T> concept Small = sizeof(T) < 8;
enum Color { RED, GREEN };
static const char* s = "class Fake { void f() {} };";
int* pointer(Point* p) { if (p) { return 0; } for (;;) { } return helper2(p); }
void Shape2::outside() { area(); }
}
int main() { demo::pointer(nullptr); return 0; }
"""


def test_cpp_units():
    rows = P.cpp_units(CPP, "a.cpp")
    assert [(r[0], r[1]) for r in rows] == [("type_alias", "Real"), ("struct", "Point"), ("class", "Shape"), ("class_template", "Box"), ("function_template", "biggest"), ("concept", "Small"), ("function", "pointer"), ("function", "Shape2::outside"), ("function", "main")]
    shape = next(r for r in rows if r[1] == "Shape")
    assert (shape[3], shape[4]) == (7, 16) and shape[2].startswith("class Shape") and shape[2].endswith("}")
    assert [r[0] for r in P.cpp_units("namespace empty { }", "n.hpp")] == ["namespace"]
    assert [r[:2] for r in P.cpp_units("struct S;", "s.h")] == [("struct", "S")] and [r[0] for r in P.cpp_units("class C;", "c.h")] == ["module_docstring"]
    assert P.is_systemc('#include <systemc.h>\nSC_MODULE(x)') and not P.is_systemc("int x;")
    assert [r[0] for r in P.cpp_units("int f(", "x.c")] == ["module_docstring"]


def test_contained_names_are_dropped_alike_by_both_ways():
    import random

    r = random.Random(1)
    for _ in range(50):
        rows = [("class", r.choice("ab"), "", s, s + r.randint(0, 6), 0) for s in (r.randint(1, 9) for _ in range(12))]
        slow = [x for i, x in enumerate(rows) if not any(j != i and o[1] == x[1] and o[3] < x[3] and o[4] >= x[4] for j, o in enumerate(rows))]
        assert sorted(P._not_inside(rows)) == sorted(slow)


def test_cpp_references():
    every = [u for top in Reader(CPP).units() for u in top.walk()]
    units = {u.name: u for u in every} | {"Shape": next(u for u in every if u.kind == "class")}
    assert [b for b, _ in units["Shape"].bases] == ["Base", "detail::Other"]
    assert {m for m, _ in units["Shape"].members} >= {"Point", "std::vector"}
    area = units["area"]
    assert [c for c, _ in area.calls] == ["helper", "method", "demo::free_one"] and "Point" in [p for p, _ in area.parameters]
    assert [c for c, _ in units["pointer"].calls] == ["helper2"]


def test_entities():
    rows = extract(CPP, "src/a.cpp", "p")
    kinds = {(r[2], r[3]) for r in rows if r[0] == "entity"}
    assert {("file", "a.cpp"), ("namespace", "demo"), ("type_alias", "Real"), ("struct", "Point"), ("class", "Shape"), ("function", "Shape::area"), ("concept", "Small"), ("template", "Box")} <= kinds
    assert ("class", "Forward") not in kinds and ("class", "Fake") not in kinds
    assert [(r[9], r[10]) for r in rows if r[0] == "include"] == [("engine/core.hpp", 1), ("vector", 2)]
    assert [r[2] for r in extract("class X;", "x.h", "p")] == ["file"]


def test_graph_over_files(spark):
    files = spark.createDataFrame([("a.hpp", "class Base {};\nvoid util(int x) { }\n"), ("b.cpp", '#include "a.hpp"\nclass Child : public Base { Base b_; void go(Base b) { util(1); } };\nvoid twice() {}\n'), ("c.cpp", "void twice() {}\nint main() { util(2); twice(); unknown(); }\n"), ("d.cpp", None)], "file_path string, source string")
    nodes, edges, pending = build(files, "p")
    e = {(r.src.split(":", 1)[1], r.relation_type, r.dst.split(":", 1)[1]) for r in edges.collect()}
    assert ("b.cpp:function:Child::go", "CALLS", "a.hpp:function:util") in e and ("c.cpp:function:main", "CALLS", "a.hpp:function:util") in e
    assert ("b.cpp:class:Child", "INHERITS_FROM", "a.hpp:class:Base") in e and ("b.cpp:class:Child", "REFERENCES", "a.hpp:class:Base") in e
    assert ("b.cpp:function:Child::go", "REFERENCES", "a.hpp:class:Base") in e and ("b.cpp:file:b.cpp", "INCLUDES", "a.hpp:file:a.hpp") in e
    assert ("b.cpp:class:Child", "CONTAINS", "b.cpp:function:Child::go") in e
    assert {r.target_name for r in pending.collect()} == {"twice", "unknown"}
    assert nodes.where("entity_type = 'file'").count() == 4


def test_verilog():
    v = "module top (input a);\n  wire b;\nendmodule\nmodule sub (input c);\nendmodule : sub\n"
    assert [(r[1], r[3], r[4]) for r in P.verilog_units(v, "t.v")] == [("top", 1, 4), ("sub", 4, 5)]  # white space after endmodule belongs to the unit
    blocks = P.verilog_units("always @(posedge c) begin\n x <= 1;\nend\ninitial begin y = 0; end\n", "b.sv")
    assert [(r[0], r[1], r[3], r[4]) for r in blocks] == [("always", "always_1", 1, 3), ("initial", "initial_2", 4, 4)]
    assert [(r[0], r[1]) for r in P.verilog_units("wire x;", "dir/w.v")] == [("module", "w")]


def brute_paragraphs(source, target=512):
    """Units by walking the paragraphs one after the other."""
    units, held, line = [], [], 1
    closed = lambda first, last: units.append(("\n\n".join(held), first, last))
    for p in (x.strip() for x in source.split("\n\n")):
        if p and held and sum(map(len, held)) + len(p) > 4 * target:
            closed(line - "\n\n".join(held).count("\n") - 1, line)
            held = []
        held += [p] if p else []
        line += p.count("\n") + 2
    if held:
        closed(line, line + "\n\n".join(held).count("\n"))
    return units


def test_packing_and_sections(spark):
    r = random.Random(4)
    texts = ["\n\n".join(["a" * 1000, "", "b" * 1000, "c" * 1000]), "", "one", "x" * 5000 + "\n\ny", "\n\n\n\n a\nb \n\n\n\nc"]
    texts += ["".join(r.choice(["\n", "\n\n", "word ", "z" * 300, " "]) for _ in range(r.randint(0, 60))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, source string")
    got = {}
    for x in C.packed_paragraphs(df).orderBy("k", "chunk_index").collect():
        got.setdefault(x.k, []).append((x.text, x.line_start, x.line_end))
        assert (x.chunk_type, x.name) == ("paragraph", f"paragraph_{len(got[x.k]) - 1}")
    assert got == {k: u for k, t in enumerate(texts) if (u := brute_paragraphs(t))}
    rows = P.chunk_files(spark.createDataFrame([("m.md", "pre\n# A\nx\n## B\n\n"), ("d.docx", texts[0])], "file_path string, source string")).orderBy("file_path", "chunk_index").collect()
    assert [(x.chunk_type, x.name, x.line_start, x.line_end) for x in rows] == [("paragraph", "paragraph_0", 4, 7), ("paragraph", "paragraph_1", 9, 9), ("paragraph", "section_0", 1, 1), ("section", "A", 2, 3), ("section", "B", 4, 6)]


def test_odd_markdown(spark):
    text = "##\n\nabc\n#  \n# A\n```\n# in code\n```\n####### seven\n#no\n"
    got = [(x.kind, x.name, x.line_start, x.line_end) for x in C.markdown_sections(spark.createDataFrame([(text,), (None,), ("",)], "source string")).collect()]
    assert got == [("paragraph", "section_0", 1, 3), ("section", "", 4, 4), ("section", "A", 5, 6), ("section", "in code", 7, 11)]


def test_options_and_chunkers(spark):
    o = P.ChunkOptions.from_env({"CHUNK_NAIVE_LINES": "10", "CHUNK_OVERLAP_RATIO": "0.5", "CHUNK_MAX_TOKENS": "20", "CHUNK_DOC_TARGET_TOKENS": "1", "CHUNK_BACKEND": "ast", "CHUNK_LLM_MAX_CHUNKS": "3", "X": "1"})
    assert o == P.ChunkOptions(10, 0.5, 20, 1, "ast", 3) and P.ChunkOptions.from_env({}) == P.ChunkOptions()
    df = spark.createDataFrame([("a.py", "def f():\n" + "    x = 1\n" * 20), ("d.docx", "aaaa\n\nbbbb"), ("q.sql", "select 1"), ("b.py", " "), ("c.py", None)], "file_path string, source string")
    own = {".sql": ("sql", lambda source, path: [("query", "q", source, 1, 1, 0)])}
    got = sorted((r.file_path, r.language, r.chunk_type, r.name) for r in P.chunk_files(df, options=o, chunkers=own).collect())
    assert got == [("a.py", "python", "function", f"f_part_{k}") for k in (1, 2, 3, 4, 5)] + [("d.docx", "docx", "paragraph", f"paragraph_{k}") for k in (0, 1)] + [("q.sql", "sql", "query", "q")]
    paths = spark.createDataFrame([("a.py",), ("b.CPP",), ("c.md",), ("d.xyz",)], "file_path string")
    kinds = paths.select(P.document_kind("file_path").alias("k"), P.is_cpp_file("file_path").alias("c"), P.supports_file("file_path").alias("s")).collect()
    assert [(r.k, r.c, r.s) for r in kinds] == [("code", False, True), ("code", True, True), ("doc", False, True), (None, False, False)]
    assert [r.file_path for r in P.code_only(paths).collect()] == ["a.py", "b.CPP"]


@pytest.mark.parametrize("raw, value", [(None, None), ("", None), ("nothing", None), ("[1, 2]", [1, 2]), ('```json\n[{"a": 1}]\n```', [{"a": 1}]), ('x {y} {"a": {"b": 2}} {z', {"a": {"b": 2}}), ('{"a": 1} {"a": 2}', {"a": 1}), ("7", 7), ("7 apples", None)])
def test_tolerant_json(raw, value):
    assert P.tolerant_json(raw) == value


@pytest.mark.parametrize("answer", ['{"chunks":[{"start_line":1,"end_line":2,"chunk_type":"class","name":"A"}]}', '```json\n{"chunks":[{"start_line":1,"end_line":2,"chunk_type":"class","name":"A"}]}\n```', 'Here: {"chunks":[{"start_line":1,"end_line":2,"chunk_type":"class","name":"A"}]} done'])
def test_model_ranges(answer):
    src = "// note\nclass A {\n  int x;\n};\nint f() {\n}\n"
    rows = P.model_units(src, "a.cpp", lambda p: answer)
    assert [(r[0], r[1], r[3], r[4]) for r in rows] == [("class", "A", 2, 4)]


def test_model_failures_give_windows():
    def broken(prompt):
        raise RuntimeError

    src = "\n".join(f"l{i}" for i in range(100))
    for f in (broken, lambda p: "no json", lambda p: '{"chunks": 3}', lambda p: '{"chunks":[{"start_line":"x"},7,{"start_line":900,"end_line":901}]}'):
        assert [(r[1], r[3], r[4]) for r in P.model_units(src, "a.txt", f)] == [("chunk_1", 1, 60), ("chunk_2", 49, 100), ("chunk_3", 97, 100)]
    merged = P.proposed_ranges([{"start_line": 1, "end_line": 4, "name": "a", "chunk_type": "x"}, {"start_line": 3, "end_line": 6, "name": "b", "chunk_type": ""}], ["};"] * 9)
    assert merged == [Range(1, 6, "x", "b")]


def test_chunk_files(spark):
    df = spark.createDataFrame([("a.py", TWO), ("b.cpp", "int f(int a) { return 1; }\nint f(char c) { return 2; }\n"), ("c.xyz", "zzz"), ("d.md", "# T\nx"), (None, "x")], "file_path string, source string")
    got = sorted((r.file_path, r.chunk_type, r.name, r.chunk_index) for r in P.chunk_files(df).collect())
    assert got == [("a.py", "function", "one", 0), ("a.py", "function", "two", 0), ("b.cpp", "function", "f", 0), ("b.cpp", "function", "f", 1), ("d.md", "section", "T", 0)]
