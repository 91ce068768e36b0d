"""Queries of parsers, code graph, evaluation, exports and streams; sources are generated from the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgraph.operators import evaluation as E
from corpusgraph.plans.derived import EDGES_SQL, NODES_SQL, edges, nodes, table
from corpusgraph.plans.graph_queries import _RANGES, _ranges, _snapshots
from corpusgraph.sources import code_graph, parsers, sinks
from corpusgraph.sources.scratch import scratch_dir
from corpusgraph.streaming import watch


def _files(spark, d, suffix, *parts):
    """One file for each supplier; {k} is its key."""
    text = F.concat(*(F.col("s_suppkey").cast("string") if p == "{k}" else F.lit(p) for p in parts))
    return table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey", F.lit(suffix)).alias("file_path"), text.alias("source"))


def _python(spark, d):
    return _files(spark, d, ".py", '"""Doc."""\n\ndef f_', "{k}", "(x):\n    return x\n\n\nclass C_", "{k}", ":\n    a = 1\n")


def _cpp(spark, d):
    return _files(spark, d, ".cpp", '#include "base.hpp"\nnamespace n_', "{k}", " {\nstruct S_", "{k}", " { int a; };\nint f_", "{k}", "(S_", "{k}", " s) { return g_", "{k}", "(s.a) + missing(1); }\nint g_", "{k}", "(int x) { return x; }\n}\n")


_SHORT = ("file_path", "chunk_type", "name", "line_start", "line_end")


def python_units(spark, d):
    return parsers.chunk_files(_python(spark, d)).select(*_SHORT)


def cpp_units(spark, d):
    return parsers.chunk_files(_cpp(spark, d)).select(*_SHORT)


def verilog_units(spark, d):
    return parsers.chunk_files(_files(spark, d, ".v", "module m_", "{k}", " (input a);\n  wire w;\nendmodule\n")).select(*_SHORT)


def paragraph_packing(spark, d):
    files = table(spark, d, "documents").select(F.concat("doc_id", F.lit(".docx")).alias("file_path"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("source"))
    return parsers.chunk_files(files).select("file_path", "name", "line_start", "line_end", F.length("text").alias("n"))


def _proposes(prompt: str) -> str:
    """A model that names two units of the files of cpp_units, one of them a line too early."""
    return 'Sure: {"chunks":[{"start_line":2,"end_line":3,"chunk_type":"struct","name":"S"},{"start_line":4,"end_line":4,"chunk_type":"function","name":"f"}]}'


def llm_ranges(spark, d):
    return parsers.chunk_files(_cpp(spark, d), "llm", _proposes).select(*_SHORT)


def code_graph_edges(spark, d):
    _, e, _ = code_graph.build(_cpp(spark, d), "p")
    return e.select("src", "dst", "relation_type")


def code_graph_pending(spark, d):
    _, _, pending = code_graph.build(_cpp(spark, d), "p")
    return pending.groupBy("target_name", "relation_type").agg(F.count("*").alias("n"))


def _labels(spark, d):
    line = F.split("id", "-")
    rows = _ranges(spark, d).withColumns({"number": line[1].cast("int"), "supplier": line[3].cast("long")})
    kind = F.when(F.col("entity_type") == "class", "class_template").when(F.col("entity_type") == "function", "struct").otherwise(F.col("entity_type"))
    rows = rows.select(F.col("id").alias("label_id"), "file_path", F.when(F.col("number") % 4 == 0, "zz").otherwise(F.col("name")).alias("name"), kind.alias("kind"), (F.col("line_start") + (F.col("supplier") % 2).cast("int")).alias("line_start"), "line_end")
    return rows.groupBy("label_id").agg(*(F.min(c).alias(c) for c in ("file_path", "name", "kind", "line_start", "line_end")))


def eval_boundaries(spark, d):
    chunks = _ranges(spark, d).withColumnRenamed("entity_type", "chunk_type")
    rates = E.boundary_rates(E.judge_labels(_labels(spark, d), chunks))
    return rates.select("total", "detected", "exact_match", "split", "missed", *(F.round(c, 6).alias(c) for c in ("detect_rate", "exact_rate", "split_rate", "missed_rate")))


def eval_mismatches(spark, d):
    chunks = _ranges(spark, d).withColumnRenamed("entity_type", "chunk_type")
    return E.mismatches(E.judge_labels(_labels(spark, d), chunks)).select("label_id", "outcome")


def _pairs(spark, d):
    line = table(spark, d, "lineitem")
    q = F.col("l_quantity").cast("int")
    some = F.col("l_linenumber") % 5 != 0
    pick = lambda x: F.when(some, x)
    return line.select(F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("name"), q.alias("line_start"), (q + 5).alias("line_end"), pick(F.when(F.col("l_partkey") % 3 == 0, "A").otherwise(F.col("l_returnflag"))).alias("p_kind"), pick(F.col("l_linestatus")).alias("p_name"), pick(q + (F.col("l_suppkey") % 2).cast("int")).alias("p_start"), pick(q + 5).alias("p_end"))


def eval_accuracy(spark, d):
    c = E.compare_rows(_pairs(spark, d))
    return E.accuracy(c).join(c.agg(F.sum("start_diff").alias("start_diff"), F.count_if("type_match").alias("types")))


def _graph(spark, d):
    """The whole derived graph, nations as namespaces of a project for each kind of thing."""
    project = F.when(F.col("entity_type").isin("region", "nation", "supplier"), "places").otherwise("trade")
    n = nodes(spark, d).withColumns({"project_id": project, "entity_type": F.when(F.col("entity_type") == "nation", "namespace").otherwise(F.col("entity_type"))})
    return n, edges(spark, d)


def export_dot(spark, d):
    return sinks.dot_lines(*_graph(spark, d)).select("part", "line")


def export_json(spark, d):
    return sinks.export_json(*_graph(spark, d)).select("part", "line")


def export_gexf(spark, d):
    return sinks.gexf_lines(*_graph(spark, d)).select("part", "line")


def export_html(spark, d):
    """What the page of one project holds: its data and its lists of types, read back from the page."""
    page = sinks.html_lines(*_graph(spark, d), project="places")
    node, edge = "id string, entity_type string", "source string, target string, relation_type string"
    part = lambda n, schema: page.where(F.col("part") == n).select(F.from_json(F.ltrim("line", F.lit(",")), schema).alias("x"))
    nodes_ = part(1, node).select(F.lit("node").alias("kind"), F.col("x.entity_type").alias("type"), F.col("x.id").alias("id"))
    edges_ = part(3, edge).select(F.lit("edge").alias("kind"), F.col("x.relation_type").alias("type"), F.concat("x.source", F.lit(" "), "x.target").alias("id"))
    options = page.where("part = 0").select(F.lit("option").alias("kind"), F.explode(F.regexp_extract_all("line", F.lit("<option>(.*?)</option>"))).alias("type"), F.lit("").alias("id"))
    return nodes_.unionByName(edges_).unionByName(options)


def export_types(spark, d):
    one, two = sinks.type_lists(*_graph(spark, d))
    return one.select(F.lit("entity").alias("of"), F.col("entity_type").alias("type")).unionByName(two.select(F.lit("relation").alias("of"), F.col("relation_type").alias("type")))


def stream_incremental(spark, d):
    """Two snapshots of the documents as a stream: what each changed."""
    folder = scratch_dir(spark, "watch")
    schema = "project_id string, file_path string, content_hash string"
    for part in _snapshots(spark, d):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    w = watch.Watch(spark, folder)
    w.start(watch.snapshot_stream(spark, f"{folder}/in", schema), once=True).awaitTermination()
    return w.changes().groupBy("batch", "status").agg(F.count("*").alias("n")).select(F.col("batch").cast("long").alias("batch"), "status", "n")


def stream_event_counts(spark, d):
    """Hourly counts of the event stream, as a stream with a complete result in each batch."""
    source = f"{d}/events.parquet"
    folder = scratch_dir(spark, "events")
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(f"{d}/events*.parquet")

    def put(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    query = watch.event_counts(stream).writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {f.__name__: f for f in (python_units, cpp_units, verilog_units, paragraph_packing, llm_ranges, code_graph_edges, code_graph_pending, eval_boundaries, eval_mismatches, eval_accuracy, export_dot, export_json, export_gexf, export_html, export_types, stream_incremental, stream_event_counts)}

_JUDGED = f"""WITH {_RANGES}, labels AS (SELECT id AS label_id, min(file_path) AS file_path, min(CASE WHEN split_part(id, '-', 2)::INTEGER % 4 = 0 THEN 'zz' ELSE name END) AS name,
  min(CASE entity_type WHEN 'class' THEN 'class_template' WHEN 'function' THEN 'struct' ELSE entity_type END) AS kind, min(line_start + split_part(id, '-', 4)::INTEGER % 2) AS line_start, min(line_end) AS line_end FROM ranges GROUP BY id),
m AS (SELECT l.label_id, count(*) FILTER (WHERE r.name = l.name AND t AND s) AS n1, count(*) FILTER (WHERE r.name = l.name AND t) AS n2, count(*) FILTER (WHERE r.name = l.name) AS n3,
  count(*) FILTER (WHERE r.name = l.name AND s) AS ex, count(*) FILTER (WHERE r.line_start <= l.line_start AND r.line_end >= l.line_end) AS holding
  FROM labels l LEFT JOIN (SELECT * FROM ranges) r ON r.file_path = l.file_path,
  LATERAL (SELECT (l.kind = r.entity_type OR (l.kind IN ('class_template', 'function_template', 'struct_template') AND r.entity_type IN ('class', 'function', 'struct')) OR (l.kind = 'struct' AND r.entity_type = 'class')) AS t, (r.line_start = l.line_start AND r.line_end = l.line_end) AS s) x
  GROUP BY l.label_id),
o AS (SELECT label_id, CASE WHEN n1 > 0 OR (n2 = 0 AND ex > 0) THEN 'exact' WHEN (CASE WHEN n2 > 0 THEN n2 ELSE n3 END) > 1 THEN 'split' WHEN (CASE WHEN n2 > 0 THEN n2 ELSE n3 END) > 0 AND holding > 1 THEN 'split'
  WHEN (CASE WHEN n2 > 0 THEN n2 ELSE n3 END) > 0 THEN 'inexact' WHEN holding > 0 THEN 'contained_no_name' ELSE 'missed' END AS outcome FROM m)"""
_S = "'s' || s_suppkey || '.cpp'"
_P = f"'p:' || {_S} || ':"
_DIFF = """WITH old AS (SELECT source AS p, doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 1), new AS (SELECT source AS p, doc_id, sha256(CASE WHEN doc_id % 10 = 2 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 3)"""
_G = f"""edges AS (SELECT * FROM ({EDGES_SQL})), raw AS ({NODES_SQL}), nodes AS (SELECT id, CASE entity_type WHEN 'nation' THEN 'namespace' ELSE entity_type END AS entity_type, name, seq, CASE WHEN entity_type IN ('region', 'nation', 'supplier') THEN 'places' ELSE 'trade' END AS project_id FROM raw),
e AS (SELECT * FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes))"""
_HEAD = ", ".join(f"(0, '{x}')" for x in sinks.DOT_HEAD)
_XML = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_GEXF = ('<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2"><graph defaultedgetype="directed"><attributes class="node"><attribute id="0" title="entity_type" type="string"/></attributes><attributes class="edge"><attribute id="1" title="relation_type" type="string"/></attributes><nodes>')
ORACLE_SQL = {
    "paragraph_packing": r"""WITH RECURSIVE p AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda s: length(regexp_replace(s, '^\s+|\s+$', '', 'g'))) AS ls FROM documents WHERE regexp_replace(text, '\s+', '', 'g') <> ''),
r(doc_id, i, line, size, k, idx, name, line_start, line_end, n) AS (SELECT doc_id, 0, 1, 0, 0, 0, NULL::INTEGER, NULL::INTEGER, NULL::INTEGER, NULL::INTEGER FROM p
  UNION ALL SELECT doc_id, i + 1, line + 2, CASE WHEN l = 0 THEN size WHEN c THEN l ELSE size + l END, CASE WHEN l = 0 THEN k WHEN c THEN 1 ELSE k + 1 END, CASE WHEN c THEN idx + 1 ELSE idx END,
    CASE WHEN c THEN idx END, CASE WHEN c THEN line - 2 * (k - 1) - 1 END, CASE WHEN c THEN line END, CASE WHEN c THEN size + 2 * (k - 1) END
  FROM (SELECT r.*, ls[i + 1]::INTEGER AS l, ls[i + 1] > 0 AND k > 0 AND size + ls[i + 1] > 2048 AS c FROM r JOIN p USING (doc_id) WHERE i < len(ls)))
SELECT doc_id || '.docx' AS file_path, 'paragraph_' || name AS name, line_start, line_end, n FROM r WHERE name IS NOT NULL
UNION ALL SELECT doc_id || '.docx', 'paragraph_' || idx, line, line + 2 * (k - 1), size + 2 * (k - 1) FROM r JOIN p USING (doc_id) WHERE i = len(ls) AND k > 0""",
    "export_dot": f"""WITH {_G}, shown AS (SELECT id, '"' || id || '" [label="' || replace(name, '"', '\\"') || '", style=filled, fillcolor=' || CASE entity_type WHEN 'namespace' THEN 'lightgreen' ELSE 'white' END || '];' AS line FROM nodes),
i AS (SELECT src, name AS ns, dst FROM e JOIN nodes ON src = id WHERE relation_type = 'CONTAINS' AND entity_type = 'namespace')
SELECT * FROM (VALUES {_HEAD}, (9, '}}')) v(part, line)
UNION ALL SELECT 1, '  subgraph cluster_' || translate(src, ':/', '__') || ' {{' || chr(10) || '    label="' || ns || '";' || chr(10) || '    style=filled;' || chr(10) || '    color=lightgrey;' || chr(10) || '    fontsize=12;' FROM (SELECT DISTINCT src, ns FROM i)
UNION ALL SELECT 1, '    ' || line FROM i JOIN shown ON dst = id UNION ALL SELECT 1, '  }}' FROM (SELECT DISTINCT src FROM i)
UNION ALL SELECT 2, '  ' || line FROM shown WHERE id NOT IN (SELECT dst FROM i) UNION ALL SELECT 3, '  "' || src || '" -> "' || dst || '" [label="' || relation_type || '"];' FROM e WHERE relation_type <> 'CONTAINS'""",
    "export_json": f"WITH {_G} SELECT 'nodes' AS part, to_json({{'id': id, 'entity_type': entity_type, 'name': name, 'seq': seq, 'project_id': project_id}})::VARCHAR AS line FROM nodes UNION ALL SELECT 'edges', to_json({{'source': src, 'target': dst, 'relation_type': relation_type}})::VARCHAR FROM edges",
    "export_gexf": f"""WITH {_G} SELECT * FROM (VALUES (0, '{_GEXF[0]}' || chr(10) || '{_GEXF[1]}'), (2, '</nodes><edges>'), (4, '</edges></graph></gexf>')) v(part, line)
UNION ALL SELECT 1, '<node id="' || {_XML.format("id")} || '" label="' || {_XML.format("name")} || '"><attvalues><attvalue for="0" value="' || entity_type || '"/></attvalues></node>' FROM nodes
UNION ALL SELECT 3, '<edge id="' || {_XML.format("src || '|' || dst || '|' || relation_type")} || '" source="' || src || '" target="' || dst || '"><attvalues><attvalue for="1" value="' || relation_type || '"/></attvalues></edge>' FROM e""",
    "export_html": f"""WITH {_G}, p AS (SELECT * FROM nodes WHERE project_id = 'places'), q AS (SELECT * FROM edges WHERE src IN (SELECT id FROM p) AND dst IN (SELECT id FROM p))
SELECT 'node' AS kind, entity_type AS type, id FROM p UNION ALL SELECT 'edge', relation_type, src || ' ' || dst FROM q UNION ALL SELECT DISTINCT 'option', entity_type, '' FROM p UNION ALL SELECT DISTINCT 'option', relation_type, '' FROM q""",
    "export_types": f"WITH {_G} SELECT DISTINCT 'entity' AS of, entity_type AS type FROM nodes UNION ALL SELECT DISTINCT 'relation', relation_type FROM edges",
    "python_units": "SELECT 's' || s_suppkey || '.py' AS file_path, 'function' AS chunk_type, 'f_' || s_suppkey AS name, 3 AS line_start, 4 AS line_end FROM supplier UNION ALL SELECT 's' || s_suppkey || '.py', 'class', 'C_' || s_suppkey, 7, 8 FROM supplier",
    "cpp_units": f"SELECT {_S} AS file_path, k AS chunk_type, n || s_suppkey AS name, a AS line_start, a AS line_end FROM supplier, (VALUES ('struct', 'S_', 3), ('function', 'f_', 4), ('function', 'g_', 5)) v(k, n, a)",
    "verilog_units": "SELECT 's' || s_suppkey || '.v' AS file_path, 'module' AS chunk_type, 'm_' || s_suppkey AS name, 1 AS line_start, 3 AS line_end FROM supplier",
    "llm_ranges": f"SELECT {_S} AS file_path, k AS chunk_type, n AS name, a AS line_start, a AS line_end FROM supplier, (VALUES ('struct', 'S', 3), ('function', 'f', 4)) v(k, n, a)",
    "code_graph_edges": f"""SELECT {_P}function:f_' || s_suppkey AS src, {_P}function:g_' || s_suppkey AS dst, 'CALLS' AS relation_type FROM supplier
UNION ALL SELECT {_P}function:f_' || s_suppkey, {_P}struct:S_' || s_suppkey, 'REFERENCES' FROM supplier
UNION ALL SELECT {_P}file:' || {_S}, 'p:base.hpp:file:base.hpp', 'INCLUDES' FROM supplier
UNION ALL SELECT {_P}namespace:n_' || s_suppkey, {_P}' || k || s_suppkey, 'CONTAINS' FROM supplier, (VALUES ('struct:S_'), ('function:f_'), ('function:g_')) v(k)""",
    "code_graph_pending": "SELECT 'missing' AS target_name, 'CALLS' AS relation_type, count(*) AS n FROM supplier",
    "eval_boundaries": _JUDGED + " SELECT *, round(detected / total * 100, 6) AS detect_rate, round(exact_match / total * 100, 6) AS exact_rate, round(split / total * 100, 6) AS split_rate, round(missed / total * 100, 6) AS missed_rate FROM (SELECT count(*) AS total, count(*) FILTER (WHERE outcome <> 'missed') AS detected, count(*) FILTER (WHERE outcome = 'exact') AS exact_match, count(*) FILTER (WHERE outcome = 'split') AS split, count(*) FILTER (WHERE outcome = 'missed') AS missed FROM o)",
    "eval_mismatches": _JUDGED + " SELECT label_id, outcome FROM o WHERE outcome IN ('split', 'contained_no_name', 'missed')",
    "eval_accuracy": "WITH p AS (SELECT l_linenumber % 5 <> 0 AS s, l_partkey % 3 <> 0 OR l_returnflag = 'A' AS k, l_suppkey % 2 = 0 AS e, l_quantity::INTEGER + l_suppkey % 2 AS ps FROM lineitem) SELECT count(*) AS total, count(*) FILTER (WHERE s AND k AND e) AS matched, count(*) FILTER (WHERE s AND k AND e) / count(*) AS accuracy, sum(CASE WHEN s AND NOT e AND ps <> 0 THEN 1 WHEN s AND ps <> 0 THEN 0 END)::BIGINT AS start_diff, count(*) FILTER (WHERE s AND k) AS types FROM p",
    "stream_incremental": f"{_DIFF} SELECT 0 AS batch, 'added' AS status, count(*) AS n FROM old UNION ALL SELECT 1, status, count(*) FROM (SELECT CASE WHEN new.doc_id IS NULL THEN 'removed' WHEN old.doc_id IS NULL THEN 'added' ELSE 'updated' END AS status FROM old FULL OUTER JOIN new USING (p, doc_id) WHERE old.h IS DISTINCT FROM new.h) GROUP BY status",
    "stream_event_counts": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
