"""Queries of sources, enrichment, answers and the store: files and projects are generated from the star schema."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Observation
from pyspark.sql import functions as F

from corpusgraph import cli
from corpusgraph.operators import answer as A
from corpusgraph.operators import enrich as N
from corpusgraph.operators import graph as G
from corpusgraph.operators import rules as S
from corpusgraph.operators.relations import content_hash
from corpusgraph.plans.derived import EDGES_SQL, NODES_SQL, edges, nodes, table
from corpusgraph.plans.text_queries import _units
from corpusgraph.sources import code_graph, files, parsers, sinks
from corpusgraph.sources.scratch import put, scratch_dir


def varied_cpp(spark, d, changed=False):
    """A C++ file for each supplier: a struct, classes of which every second inherits across files, members, parameters, calls, includes. changed: a later state of the project."""
    k = F.col("s_suppkey")
    n, even = k.cast("string"), (k - k % 2).cast("string")
    text = F.concat(
        F.lit('#include "base'), (k % 3).cast("string"), F.lit('.hpp"\nnamespace n_'), n, F.lit(" {\nstruct S_"), n, F.lit(" { int a; };\nclass B_"), n, F.lit(" { public: void run_"), n, F.lit("(S_"), n,
        F.lit(" s) { help_"), n, F.lit("(1); } S_"), n, F.lit(" held; };\nclass C_"), n, F.lit(" : public B_"), even, F.lit(" { };\nint help_"), n, F.lit("(int x) { return x; }\n}\n"),
    )
    rows = table(spark, d, "supplier").where(k % 10 != (3 if changed else 1))
    if changed:
        text = F.when(k % 10 == 2, F.concat(text, F.lit("int extra_"), n, F.lit("() { return help_"), n, F.lit("(2); }\n"))).otherwise(text)
    return rows.select(F.concat(F.lit("s"), n, F.lit(".cpp")).alias("file_path"), text.alias("source"))


def _found(spark, d, changed):
    return varied_cpp(spark, d, changed).select("file_path", F.lit(".cpp").alias("ext"), "source", content_hash("source").alias("content_hash"))


def varied_graph(spark, d):
    """Edges of all kinds over the generated project, resolved across files."""
    return code_graph.build(varied_cpp(spark, d), "p")[1].select("src", "dst", "relation_type")


def varied_units(spark, d):
    return parsers.chunk_files(varied_cpp(spark, d)).select("file_path", "chunk_type", "name", "line_start", "line_end")


def includes_extract(spark, d):
    lines = varied_cpp(spark, d).select("file_path", F.posexplode(F.split("source", "\n")).alias("pos", "line"))
    return lines.select("file_path", (F.col("pos") + 1).alias("line"), F.explode(F.regexp_extract_all("line", F.lit(code_graph.INCLUDE), F.lit(1))).alias("target"))


def incremental_build(spark, d):
    """The second of two builds of a project, in which a tenth of the files each were added, changed and removed: its counters, and the graph that the store then holds."""
    store = scratch_dir(spark, "store")
    root = "generated://project"
    cli.index(spark, root, store, found=_found(spark, d, False))
    run = cli.index(spark, root, store, found=_found(spark, d, True))
    n, e = cli.stored_graph(spark, store)
    counts = spark.createDataFrame([("files", k, v) for k, v in sorted(run.counts.items())], "kind string, name string, n long")
    chunks = cli.chunks_of(spark, store).groupBy("chunk_type").agg(F.count("*").alias("n")).select(F.lit("chunks").alias("kind"), F.col("chunk_type").alias("name"), "n")
    return counts.unionByName(chunks).unionByName(G.stats(n, e))


def discover_files(spark, d):
    """Files of the nations (a fixed table of 25 rows) in a folder: what discovery finds, and what a look without exclusions finds."""
    folder = scratch_dir(spark, "tree")
    places = {0: "{}.py", 1: "src/{}.cpp", 2: "build/{}.py", 3: "docs/{}.md", 4: "{}.txt"}
    for r in table(spark, d, "nation").select("n_nationkey", "n_name").collect():
        put(spark, f"{folder}/{places[r.n_nationkey % 5].format(r.n_name)}", f"# {r.n_name}\nx = {r.n_nationkey}\n".encode())
    seen = lambda exclude, how: files.with_text(files.discover(spark, folder, exclude=exclude)).select(F.lit(how).alias("how"), "file_path", "ext", "source", "content_hash")
    return seen(True, "discover").unionByName(seen(False, "watch"))


def archive_members(spark, d):
    """Members of a zip file with the nations (a fixed table) in it, hidden ones left out."""
    folder, data = scratch_dir(spark, "archives"), io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for r in table(spark, d, "nation").select("n_nationkey", "n_name").collect():
            z.writestr(f"{'.git/' if r.n_nationkey % 3 == 0 else 'src/'}{r.n_name}.py", f"x = {r.n_nationkey}\n")
    put(spark, f"{folder}/nations.zip", data.getvalue())
    return files.archives(spark, folder).select("file_path", "ext", "source")


def graph_round_trip(spark, d):
    """The whole graph as one node-link document, read back: counts and sums of what came through."""
    folder = scratch_dir(spark, "document")
    sinks.write_document(sinks.graph_document(nodes(spark, d).withColumn("project_id", F.lit("p")), edges(spark, d)), folder)
    n, e = files.graph_json(spark, folder)
    count = lambda df, kind, by: df.groupBy(F.col(by).alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    return count(n, "node", "entity_type").unionByName(count(e, "edge", "relation_type"))


def label_files(spark, d):
    """Labels of the two JSON shapes, written and read: units by file, and pairs of expected and predicted."""
    folder = scratch_dir(spark, "labels")
    n = table(spark, d, "supplier").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("path"), F.struct(F.col("s_name").alias("name"), F.lit("class").alias("type"), F.col("s_suppkey").cast("int").alias("start_line"), (F.col("s_suppkey") + 4).cast("int").alias("end_line")).alias("u"))
    per = n.groupBy("path").agg(F.array_sort(F.collect_list("u")).alias("units"))
    per.groupBy().agg(F.to_json(F.struct(F.collect_list(F.struct("path", "units")).alias("files"))).alias("value")).coalesce(1).write.text(f"{folder}/units")
    units = files.unit_labels(spark, f"{folder}/units").select(F.lit("unit").alias("shape"), "file_path", "name", "kind", "line_start", "line_end", F.lit(None).cast("string").alias("p_name"), F.lit(None).cast("int").alias("p_end"))
    one = F.struct(F.lit("class").alias("type"), F.col("u.name").alias("name"), F.col("u.start_line").alias("line_start"), F.col("u.end_line").alias("line_end"))
    pair = n.select(F.struct(F.col("path").alias("file"), F.col("u.name").alias("name"), F.lit("class").alias("type"), F.col("u.start_line").alias("line_start"), F.col("u.end_line").alias("line_end"), F.when(F.col("u.start_line") % 2 == 0, one).alias("best_match")).alias("x"))
    pair.groupBy().agg(F.to_json(F.collect_list("x")).alias("value")).coalesce(1).write.text(f"{folder}/pairs")
    pairs = files.pair_labels(spark, f"{folder}/pairs").select(F.lit("pair").alias("shape"), "file_path", "name", "kind", "line_start", "line_end", "p_name", "p_end")
    return units.unionByName(pairs)


_RULES = S.PrivacyRules(directories=("p1",), extensions=(".PY",))


def enriched_chunks(spark, d):
    """Parts as code units through sanitize, privacy marks and annotation."""
    u = _units(spark, d).withColumnRenamed("kind", "chunk_type").withColumn("file_path", F.concat(F.lit("p"), (F.col("p_partkey") % 4).cast("string"), F.lit("/"), "name", F.when(F.col("language") == "python", ".py").otherwise(".cpp")))
    out = N.annotate(N.mark_private(N.sanitize(u, "parts", "/srv/parts"), _RULES), "id1", "parts", "/srv/parts")
    return out.select("p_partkey", "project_id", "project_name", "document_kind", "source_language_family", "sanitized", "is_private", "declaration", "semantic_summary", "privacy_summary", F.array_join("sensitive_hits", ",").alias("sensitive_hits"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def project_summaries(spark, d):
    """The summary chunk of each source, with its documents as chunks."""
    docs = table(spark, d, "documents").select(F.col("source").alias("project_id"), F.concat(F.lit("P "), "source").alias("project_name"), F.concat(F.lit("/srv/"), "source").alias("project_root"), F.col("lang").alias("language"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), F.lit("").alias("semantic_summary"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("seq"))
    return N.project_summaries(docs).select("chunk_id", "text", "file_path", "chunk_type", "name", "project_id")


_SAYS = {0: "It adds two numbers.", 1: "```code```", 2: ""}


def answers(spark, d):
    """A question for each language over five of its documents, with a canned model: an answer, a leak that the guard stops, and none."""
    from pyspark.sql import Window

    w = Window.partitionBy("lang").orderBy("doc_id")
    hits = table(spark, d, "documents").select(F.col("lang").alias("query_id"), F.row_number().over(w).alias("rank"), F.substring("text", 1, 40).alias("text"), F.lit("f").alias("file_path"), F.lit(1).alias("line_start"), F.lit(2).alias("line_end"), F.lit("section").alias("chunk_type"), F.lit("").alias("project_name"), F.lit("markdown").alias("language"), F.lit(False).alias("is_private"), F.lit("").alias("privacy_summary")).where("rank <= 5")
    said = dict(_SAYS)
    return A.answer(hits, F.concat(F.lit("Q"), F.length("query_id").cast("string")), lambda prompt: said[sum(map(ord, prompt[-2:])) % 3]).select("query_id", "answer")


def private_alert(spark, d):
    """How many hits are private, observed while they are read."""
    docs = table(spark, d, "documents").select((F.col("doc_id") % 7 == 0).alias("is_private"), "doc_id")
    seen = Observation("private")
    A.watch_private(docs, seen).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["n_hits"], seen.get["n_private"])], "n_hits long, n_private long")


def chunk_upsert(spark, d):
    """A chunk table by collection and project: written, upserted, and one collection dropped."""
    folder = scratch_dir(spark, "chunks")
    docs = table(spark, d, "documents").select(F.col("lang").alias("collection"), F.concat(F.lit("s"), "source").alias("project_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.length("text").alias("n"))
    new = docs.where("chunk_id % 3 = 0").withColumn("n", -F.col("n"))
    sinks.write_chunks(sinks.upsert_chunks(docs, new), folder)
    sinks.drop_collection(spark, folder, "de")
    return spark.read.parquet(folder).select("collection", "project_id", F.col("chunk_id").cast("string").alias("chunk_id"), "n")


def graph_lookups(spark, d):
    """A node by id, by name, its file's node, and all nodes of that file; nations are files of their suppliers here."""
    n = nodes(spark, d).where("entity_type in ('nation', 'supplier')")
    where = F.when(F.col("entity_type") == "nation", F.col("id")).otherwise(F.concat(F.lit("nation:"), (F.col("seq") % 25).cast("string")))
    n = n.withColumns({"file_path": where, "project_id": F.lit("p"), "entity_type": F.when(F.col("entity_type") == "nation", "file").otherwise(F.col("entity_type"))})
    tag = lambda df, how: df.select(F.lit(how).alias("how"), "id")
    return tag(G.get_node(n, "supplier:3"), "id").unionByName(tag(G.find_node(n, "PERU", ["file"], "p"), "name")).unionByName(tag(G.find_file(n, "nation:3", "p"), "file")).unionByName(tag(G.in_file(n, "nation:3", "p"), "in file"))


QUERIES = {f.__name__: f for f in (varied_graph, varied_units, includes_extract, incremental_build, discover_files, archive_members, graph_round_trip, label_files, enriched_chunks, project_summaries, answers, private_alert, chunk_upsert, graph_lookups)}

_ID = "left(sha256('generated://project'), 12)"


def _graph_sql(project: str, rows: str) -> str:
    """nodes and edges of varied_cpp over rows(k, extra), as CTEs n and e."""
    f = f"{project} || ':s' || k || '.cpp:'"
    return f"""n AS (SELECT k, kind, {f} || kind || ':' || name AS id, name FROM {rows}, LATERAL (VALUES ('file', 's' || k || '.cpp'), ('namespace', 'n_' || k), ('struct', 'S_' || k), ('class', 'B_' || k), ('function', 'B_' || k || '::run_' || k), ('class', 'C_' || k), ('function', 'help_' || k)) v(kind, name)
  UNION ALL SELECT k, 'function', {f} || 'function:extra_' || k, 'extra_' || k FROM {rows} WHERE extra),
pairs AS (SELECT k, {f} || a AS src, {f} || b AS dst, t AS relation_type FROM {rows}, LATERAL (VALUES ('function:B_' || k || '::run_' || k, 'function:help_' || k, 'CALLS'), ('function:B_' || k || '::run_' || k, 'struct:S_' || k, 'REFERENCES'), ('class:B_' || k, 'struct:S_' || k, 'REFERENCES'),
  ('namespace:n_' || k, 'struct:S_' || k, 'CONTAINS'), ('namespace:n_' || k, 'class:B_' || k, 'CONTAINS'), ('namespace:n_' || k, 'class:C_' || k, 'CONTAINS'), ('namespace:n_' || k, 'function:help_' || k, 'CONTAINS'), ('namespace:n_' || k, 'function:B_' || k || '::run_' || k, 'CONTAINS'), ('class:B_' || k, 'function:B_' || k || '::run_' || k, 'CONTAINS')) v(a, b, t)),
e AS (SELECT src, dst, relation_type FROM pairs
  UNION ALL SELECT {f} || 'file:s' || k || '.cpp', {project} || ':base' || (k % 3) || '.hpp:file:base' || (k % 3) || '.hpp', 'INCLUDES' FROM {rows}
  UNION ALL SELECT {f} || 'class:C_' || k, {project} || ':s' || (k - k % 2) || '.cpp:class:B_' || (k - k % 2), 'INHERITS_FROM' FROM {rows} WHERE k - k % 2 IN (SELECT k FROM {rows})
  UNION ALL SELECT {f} || 'function:extra_' || k, {f} || 'function:help_' || k, 'CALLS' FROM {rows} WHERE extra)"""


_FIRST = "SELECT s_suppkey AS k, false AS extra FROM supplier WHERE s_suppkey % 10 <> 1"
_SECOND = "SELECT s_suppkey AS k, s_suppkey % 10 = 2 AS extra FROM supplier WHERE s_suppkey % 10 <> 3"
_UNIT_SQL = "(VALUES ('struct', 'S_', 3), ('class', 'B_', 4), ('class', 'C_', 5), ('function', 'help_', 6)) v(chunk_type, prefix, a)"
_LABELS = "SELECT 'n' || s_nationkey AS file_path, s_name AS name, 'class' AS kind, s_suppkey::INTEGER AS line_start, (s_suppkey + 4)::INTEGER AS line_end"
_ENRICHED = """WITH units AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '{ }' WHEN p_partkey % 5 = 1 THEN 'class ' || translate(p_brand, '#', '_') || ';'
  ELSE '  int ' || translate(p_name, ' ', '_') || '(' || chr(10) || ' int x )' || chr(10) || '{ return ' || p_size || '; }' END AS text,
  CASE WHEN p_partkey % 3 = 0 THEN 'python' ELSE 'cpp' END AS language, translate(p_name, ' ', '_') AS name, p_size AS a, p_size + 3 AS e FROM part),
paths AS (SELECT *, 'p' || (p_partkey % 4) || '/' || name || CASE language WHEN 'python' THEN '.py' ELSE '.cpp' END AS path,
  array_to_string(list_filter(list_transform(string_split(split_part(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '{', 1), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), ' ') AS head FROM units),
said AS (SELECT *, CASE WHEN language = 'python' THEN 'function ' || name WHEN head = '' THEN 'function ' || name || ';' WHEN ends_with(head, ';') THEN head ELSE head || ';' END AS declaration, name || ' is a function in ' || language || ' defined at lines ' || a || '-' || e || '.' AS summary, language = 'python' OR p_partkey % 4 = 1 AS private FROM paths)
SELECT p_partkey, 'id1' AS project_id, 'parts' AS project_name, CASE language WHEN 'python' THEN 'code' ELSE 'sanitized_code' END AS document_kind, CASE language WHEN 'python' THEN 'python' ELSE 'c_family' END AS source_language_family, language = 'cpp' AS sanitized, private AS is_private, declaration, summary AS semantic_summary,
  CASE WHEN private THEN '[PRIVACY-SAFE SUMMARY] This is a high-confidential component in ' || path || '. The raw implementation is withheld per privacy policy.' ELSE '' END AS privacy_summary, '' AS sensitive_hits,
  md5(CASE language WHEN 'python' THEN text ELSE concat_ws(chr(10), 'project: parts', 'project_root: /srv/parts', 'file: ' || path, 'language: cpp', 'symbol_type: function', 'symbol_name: ' || name, 'line_range: ' || a || '-' || e, 'declaration: ' || declaration, 'summary: ' || summary) END) AS text_md5 FROM said"""

ORACLE_SQL = {
    "varied_graph": f"WITH one AS ({_FIRST}), {_graph_sql(chr(39) + 'p' + chr(39), 'one')} SELECT * FROM e",
    "varied_units": f"SELECT 's' || k || '.cpp' AS file_path, chunk_type, prefix || k AS name, a AS line_start, a AS line_end FROM ({_FIRST}), {_UNIT_SQL}",
    "includes_extract": f"SELECT 's' || k || '.cpp' AS file_path, 1 AS line, 'base' || (k % 3) || '.hpp' AS target FROM ({_FIRST})",
    "incremental_build": f"""WITH one AS ({_FIRST}), two AS ({_SECOND}), {_graph_sql(_ID, 'two')},
lastly AS (SELECT src, dst, arg_max(relation_type, (relation_type = 'CONTAINS', relation_type)) AS relation_type FROM e GROUP BY src, dst)
SELECT 'files' AS kind, CASE WHEN one.k IS NULL THEN 'added' WHEN two.k IS NULL THEN 'removed' WHEN two.extra THEN 'updated' ELSE 'skipped' END AS name, count(*) AS n FROM one FULL OUTER JOIN two USING (k) GROUP BY 2
UNION ALL SELECT 'chunks', chunk_type, count(*) FROM two, {_UNIT_SQL} GROUP BY 2 HAVING chunk_type <> 'function'
UNION ALL SELECT 'chunks', 'function', count(*) + count(*) FILTER (WHERE extra) FROM two UNION ALL SELECT 'chunks', 'project_summary', 1
UNION ALL SELECT 'total', 'nodes', count(*) FROM n UNION ALL SELECT 'total', 'edges', count(*) FROM lastly UNION ALL SELECT 'entity_type', kind, count(*) FROM n GROUP BY 2 UNION ALL SELECT 'relation_type', relation_type, count(*) FROM lastly GROUP BY 2""",
    "discover_files": """WITH f AS (SELECT n_nationkey % 5 AS p, n_name, '# ' || n_name || chr(10) || 'x = ' || n_nationkey || chr(10) AS source FROM nation),
g AS (SELECT p, CASE p WHEN 0 THEN n_name || '.py' WHEN 1 THEN 'src/' || n_name || '.cpp' WHEN 2 THEN 'build/' || n_name || '.py' WHEN 3 THEN 'docs/' || n_name || '.md' END AS file_path, CASE p WHEN 1 THEN '.cpp' WHEN 3 THEN '.md' ELSE '.py' END AS ext, source, sha256(source) AS content_hash FROM f WHERE p < 4)
SELECT 'discover' AS how, file_path, ext, source, content_hash FROM g WHERE p <> 2 UNION ALL SELECT 'watch', file_path, ext, source, content_hash FROM g""",
    "archive_members": "SELECT 'nations.zip/src/' || n_name || '.py' AS file_path, '.py' AS ext, 'x = ' || n_nationkey || chr(10) AS source FROM nation WHERE n_nationkey % 3 <> 0",
    "graph_round_trip": f"SELECT 'node' AS kind, entity_type AS name, count(*) AS n FROM ({NODES_SQL}) GROUP BY 2 UNION ALL SELECT 'edge', relation_type, count(*) FROM (SELECT DISTINCT * FROM ({EDGES_SQL})) GROUP BY 2",
    "label_files": f"{_LABELS}, 'unit' AS shape, NULL::VARCHAR AS p_name, NULL::INTEGER AS p_end FROM supplier UNION ALL {_LABELS}, 'pair', CASE WHEN s_suppkey % 2 = 0 THEN s_name END, CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey + 4)::INTEGER END FROM supplier",
    "enriched_chunks": _ENRICHED,
    "project_summaries": "WITH f AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) SELECT 'project:' || source || ':summary' AS chunk_id, 'Project P ' || source || ' focuses on ' || count(*) || ' indexed documents. Representative symbols include ' || string_agg('d' || doc_id, ', ' ORDER BY k) FILTER (WHERE k <= 3) || '.' AS text, '/srv/' || source AS file_path, 'project_summary' AS chunk_type, 'P ' || source AS name, source AS project_id FROM f GROUP BY source",
    "answers": f"SELECT DISTINCT lang AS query_id, CASE (81 + ascii(length(lang)::VARCHAR)) % 3 WHEN 0 THEN '{_SAYS[0]}' WHEN 1 THEN '{S.BLOCK_MESSAGE}' ELSE '{A.NO_ANSWER}' END AS answer FROM documents",
    "private_alert": "SELECT count(*) AS n_hits, count(*) FILTER (WHERE doc_id % 7 = 0) AS n_private FROM documents",
    "chunk_upsert": "SELECT lang AS collection, 's' || source AS project_id, doc_id::VARCHAR AS chunk_id, (CASE WHEN doc_id % 3 = 0 THEN -length(text) ELSE length(text) END)::INTEGER AS n FROM documents WHERE lang <> 'de'",
    "graph_lookups": "SELECT 'id' AS how, 'supplier:' || s_suppkey AS id FROM supplier WHERE s_suppkey = 3 UNION ALL SELECT 'name', 'nation:' || n_nationkey FROM nation WHERE n_name = 'PERU' UNION ALL SELECT 'file', 'nation:3' UNION ALL SELECT 'in file', 'nation:3' UNION ALL SELECT 'in file', 'supplier:' || s_suppkey FROM supplier WHERE s_suppkey % 25 = 3",
}
