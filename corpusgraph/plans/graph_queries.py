"""Queries of the graph operators over the derived graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgraph.operators import graph as G
from corpusgraph.operators import relations as R
from corpusgraph.plans.derived import EDGES_SQL, NODES_SQL, edges, nodes, table

_E = f"WITH RECURSIVE edges AS ({EDGES_SQL}), nodes AS ({NODES_SQL})"


def graph_stats(spark, d):
    return G.stats(nodes(spark, d), edges(spark, d))


def graph_neighbors(spark, d):
    return G.neighbors(edges(spark, d), "nation:7").join(nodes(spark, d).select("id", "entity_type", "name"), "id")


def _pairs(spark, d):
    """Raw (part, supplier) pairs as written edges; the order is unique within a pair."""
    seq = F.struct("l_orderkey", F.col("l_linenumber").cast("long"))
    return table(spark, d, "lineitem").select(F.concat(F.lit("part:"), "l_partkey").alias("src"), F.concat(F.lit("supplier:"), "l_suppkey").alias("dst"), F.col("l_returnflag").alias("relation_type"), seq.alias("seq"))


def edge_upsert_last_wins(spark, d):
    return G.upsert_edges(_pairs(spark, d)).select("src", "dst", "relation_type")


def node_upsert(spark, d):
    n = nodes(spark, d)
    new = n.where("seq % 3 = 0").select("id", "entity_type", F.concat("name", F.lit(" (2)")).alias("name"), (F.col("seq") + 1_000_000).alias("seq"))
    return G.upsert_nodes(n, new)


def graph_stub_nodes(spark, d):
    return G.stub_nodes(nodes(spark, d).where("entity_type <> 'supplier'"), edges(spark, d))


def node_delete_cascade(spark, d):
    gone = nodes(spark, d).where("entity_type = 'part' and seq % 2 = 0")
    n, e = G.remove_nodes(nodes(spark, d), edges(spark, d), gone)
    return G.stats(n, e)


def edge_delete(spark, d):
    return G.remove_edges(edges(spark, d), "nation:3", "nation:4", "INCLUDES")


def find_entity(spark, d):
    """The first node of the name that many orders share."""
    return G.find_node(nodes(spark, d), "1-URGENT")


def impact_scope(spark, d):
    return G.reach(edges(spark, d, True), G.ids(spark, "order:0"), 3, G.FORWARD)


def find_callers(spark, d):
    return G.callers(edges(spark, d, True), G.ids(spark, "supplier:0"), 2)


def find_callees(spark, d):
    return G.callees(edges(spark, d, True), G.ids(spark, "order:5"), 3)


def reach_cycle(spark, d):
    """Over the ring of nations: the start comes back after 25 steps."""
    return G.reach(edges(spark, d, True), G.ids(spark, "nation:0"), 6, ("INCLUDES", "CONTAINS"), keep_seeds=True)


def simple_paths(spark, d):
    return G.simple_paths(edges(spark, d, True), "order:0", "region:0", 5).select("hops", F.array_join("path", ">").alias("path"))


def class_hierarchy(spark, d):
    return G.class_hierarchy(edges(spark, d), G.ids(spark, "supplier:1"))


def file_deps(spark, d):
    return G.dependencies(edges(spark, d), "nation:24")


def file_dependents(spark, d):
    return G.dependents(edges(spark, d), "nation:0")


def concept_impls(spark, d):
    named = edges(spark, d).withColumn("relation_type", F.when(F.col("relation_type") == "INHERITS_FROM", F.when(F.col("src").startswith("supplier"), "IMPLEMENTS").otherwise("USES_CONCEPT")).otherwise(F.col("relation_type")))
    return G.concept_implementations(named, "nation:2")


def impact_analysis(spark, d):
    return G.impact(edges(spark, d), "part:1", 3, file_id="nation:1")


def subgraph_filter(spark, d):
    """The part of the graph that one project holds: orders and parts are another's."""
    kind = F.when(F.col("entity_type").isin("order", "part"), "trade").otherwise("places")
    n, e = G.subgraph(nodes(spark, d).withColumn("project_id", kind), edges(spark, d), "places", ["INHERITS_FROM", "CONTAINS", "CALLS"])
    return e


def _symbols(spark, d):
    return table(spark, d, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("name"))


def _references(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat_ws(" ", "p_name", "p_brand").alias("target_name"))


def symbol_resolution(spark, d):
    return R.unique_symbols(_symbols(spark, d))


def pending_resolution(spark, d):
    hit, rest = R.resolve(_references(spark, d), _symbols(spark, d))
    count = lambda df, s: df.groupBy("target_name").agg(F.count("*").alias("n")).select(F.lit(s).alias("state"), "target_name", "n")
    return count(hit, "resolved").unionByName(count(rest, "pending"))


def _ranges(spark, d):
    """Units of a file: lines of an order as line ranges."""
    line = table(spark, d, "lineitem")
    start = (F.col("l_orderkey") % 997).cast("int")
    kind = F.when(F.col("l_returnflag") == "A", "class").when(F.col("l_returnflag") == "N", "function").otherwise("namespace")
    return line.select(F.concat(F.lit("p"), "l_partkey").alias("file_path"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")).alias("id"), kind.alias("entity_type"), start.alias("line_start"), (start + 4 * F.col("l_quantity").cast("int")).alias("line_end"), F.concat(F.lit("n"), (F.col("l_suppkey") % 3).cast("string")).alias("name"))


_RANGES = """ranges AS (
  SELECT 'p' || l_partkey AS file_path, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INTEGER) AS id,
    CASE l_returnflag WHEN 'A' THEN 'class' WHEN 'N' THEN 'function' ELSE 'namespace' END AS entity_type, (l_orderkey % 997)::INTEGER AS line_start,
    (l_orderkey % 997)::INTEGER + 4 * l_quantity::INTEGER AS line_end, 'n' || (l_suppkey % 3) AS name
  FROM lineitem)"""


def contains_interval_join(spark, d):
    return R.containment(_ranges(spark, d), bucket=128).groupBy("file_path", "outer_id").agg(F.count("*").alias("n"), F.min("inner_id").alias("first_inner"))


def containment_dedup(spark, d):
    return R.drop_contained(_ranges(spark, d)).select("file_path", "id", "name", "line_start", "line_end")


def interval_merge(spark, d):
    r = _ranges(spark, d)
    return R.merge_intervals(r.select("file_path", "line_start", "line_end", "name", F.col("entity_type").alias("kind")), "file_path").select("file_path", "line_start", "line_end")


def _snapshots(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("project_id"), F.concat(F.lit("doc/"), "doc_id").alias("file_path"), "doc_id", "text")
    old = docs.where("doc_id % 10 <> 1").select("project_id", "file_path", R.content_hash("text").alias("content_hash"))
    changed = F.when(F.col("doc_id") % 10 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = docs.where("doc_id % 10 <> 3").select("project_id", "file_path", R.content_hash(changed).alias("content_hash"))
    return old, new


def incremental_diff(spark, d):
    return R.snapshot_diff(*_snapshots(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


def stale_files(spark, d):
    return R.stale(*_snapshots(spark, d))


QUERIES = {f.__name__: f for f in (graph_stats, graph_neighbors, edge_upsert_last_wins, node_upsert, graph_stub_nodes, node_delete_cascade, edge_delete, find_entity, impact_scope, find_callers, find_callees, reach_cycle, simple_paths, class_hierarchy, file_deps, file_dependents, concept_impls, impact_analysis, subgraph_filter, symbol_resolution, pending_resolution, contains_interval_join, containment_dedup, interval_merge, incremental_diff, stale_files)}

_STATS = "SELECT 'total' AS kind, 'nodes' AS name, count(*) AS n FROM {n} UNION ALL SELECT 'total', 'edges', count(*) FROM {e} UNION ALL SELECT 'entity_type', entity_type, count(*) FROM {n} GROUP BY 2 UNION ALL SELECT 'relation_type', relation_type, count(*) FROM {e} GROUP BY 2"


def _reach(start: str, depth: int, types: tuple[str, ...], a: str = "src", b: str = "dst", keep: bool = False, name: str = "r") -> str:
    listed = ", ".join(f"'{t}'" for t in types)
    return f"{name}(id, depth) AS (SELECT '{start}', 0 UNION SELECT e.{b}, r.depth + 1 FROM {name} r JOIN edges e ON e.{a} = r.id WHERE r.depth < {depth} AND e.relation_type IN ({listed})), {name}_all AS (SELECT id, min(depth)::INTEGER AS depth FROM {name} WHERE depth > 0 {'' if keep else f"AND id <> '{start}'"} GROUP BY id)"


_DIFF = """WITH old AS (SELECT source AS project_id, 'doc/' || doc_id AS file_path, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 1),
new AS (SELECT source AS project_id, 'doc/' || doc_id AS file_path, sha256(CASE WHEN doc_id % 10 = 2 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 3)"""

ORACLE_SQL = {
    "graph_stats": f"{_E} {_STATS.format(n='nodes', e='edges')}",
    "graph_neighbors": f"{_E}, x AS (SELECT dst AS id, relation_type, 'out' AS direction FROM edges WHERE src = 'nation:7' UNION ALL SELECT src, relation_type, 'in' FROM edges WHERE dst = 'nation:7') SELECT x.*, entity_type, name FROM x JOIN nodes USING (id)",
    "edge_upsert_last_wins": "SELECT 'part:' || l_partkey AS src, 'supplier:' || l_suppkey AS dst, arg_max(l_returnflag, (l_orderkey, l_linenumber)) AS relation_type FROM lineitem GROUP BY l_partkey, l_suppkey",
    "node_upsert": f"{_E} SELECT id, entity_type, CASE WHEN seq % 3 = 0 THEN name || ' (2)' ELSE name END AS name, seq FROM nodes",
    "graph_stub_nodes": f"{_E} SELECT DISTINCT id FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) WHERE id NOT IN (SELECT id FROM nodes WHERE entity_type <> 'supplier')",
    "node_delete_cascade": f"{_E}, gone AS (SELECT id FROM nodes WHERE entity_type = 'part' AND seq % 2 = 0), n AS (SELECT * FROM nodes WHERE id NOT IN (SELECT id FROM gone)), e AS (SELECT * FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)) {_STATS.format(n='n', e='e')}",
    "edge_delete": f"{_E} SELECT * FROM edges WHERE NOT (src = 'nation:3' AND dst = 'nation:4' AND relation_type = 'INCLUDES')",
    "find_entity": f"{_E} SELECT * FROM nodes WHERE name = '1-URGENT' ORDER BY seq, id LIMIT 1",
    "impact_scope": f"{_E}, {_reach('order:0', 3, G.FORWARD)} SELECT * FROM r_all",
    "find_callers": f"{_E}, {_reach('supplier:0', 2, ('CALLS',), 'dst', 'src', True)} SELECT * FROM r_all",
    "find_callees": f"{_E}, {_reach('order:5', 3, ('CALLS',), keep=True)} SELECT * FROM r_all",
    "reach_cycle": f"{_E}, {_reach('nation:0', 6, ('INCLUDES', 'CONTAINS'), keep=True)} SELECT * FROM r_all",
    "simple_paths": f"{_E}, p(node, hops, path) AS (SELECT 'order:0', 0, ['order:0'] UNION ALL SELECT e.dst, p.hops + 1, list_append(p.path, e.dst) FROM p JOIN edges e ON e.src = p.node WHERE p.hops < 5 AND p.node <> 'region:0' AND NOT list_contains(p.path, e.dst)) SELECT hops::INTEGER AS hops, array_to_string(path, '>') AS path FROM p WHERE node = 'region:0'",
    "class_hierarchy": f"{_E}, i AS (SELECT src, dst FROM edges WHERE relation_type = 'INHERITS_FROM') SELECT dst AS id, 'parent' AS role FROM i WHERE src = 'supplier:1' UNION ALL SELECT src, 'child' FROM i WHERE dst = 'supplier:1' UNION ALL SELECT b.src, 'sibling' FROM i a JOIN i b USING (dst) WHERE a.src = 'supplier:1' AND b.src <> 'supplier:1'",
    "file_deps": f"{_E} SELECT dst AS id FROM edges WHERE src = 'nation:24' AND relation_type = 'INCLUDES'",
    "file_dependents": f"{_E} SELECT src AS id FROM edges WHERE dst = 'nation:0' AND relation_type = 'INCLUDES'",
    "concept_impls": f"{_E} SELECT src AS id, CASE WHEN src LIKE 'supplier%' THEN 'IMPLEMENTS' ELSE 'USES_CONCEPT' END AS relation_type FROM edges WHERE dst = 'nation:2' AND relation_type = 'INHERITS_FROM'",
    "impact_analysis": f"{_E}, {_reach('part:1', 3, G.FORWARD)} SELECT src AS id, 'direct_caller' AS role, 1 AS depth FROM edges WHERE dst = 'part:1' AND relation_type = 'CALLS' UNION ALL SELECT dst, 'direct_callee', 1 FROM edges WHERE src = 'part:1' AND relation_type = 'CALLS' UNION ALL SELECT id, 'transitive', depth FROM r_all UNION ALL SELECT src, 'file_dependent', 1 FROM edges WHERE dst = 'nation:1' AND relation_type = 'INCLUDES'",
    "subgraph_filter": f"{_E}, n AS (SELECT id FROM nodes WHERE entity_type NOT IN ('order', 'part')) SELECT * FROM edges WHERE relation_type IN ('INHERITS_FROM', 'CONTAINS', 'CALLS') AND src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)",
    "symbol_resolution": "SELECT p_name || ' ' || p_brand AS name, 'part:' || min(p_partkey) AS symbol_id FROM part GROUP BY 1 HAVING count(*) = 1",
    "pending_resolution": "WITH u AS (SELECT p_name || ' ' || p_brand AS name FROM part GROUP BY 1 HAVING count(*) = 1), r AS (SELECT p_name || ' ' || p_brand AS target_name FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT CASE WHEN target_name IN (SELECT name FROM u) THEN 'resolved' ELSE 'pending' END AS state, target_name, count(*) AS n FROM r GROUP BY ALL",
    "contains_interval_join": f"WITH {_RANGES} SELECT o.file_path, o.id AS outer_id, count(*) AS n, min(i.id) AS first_inner FROM ranges o JOIN ranges i ON o.file_path = i.file_path AND o.line_start <= i.line_start AND o.line_end >= i.line_end AND o.id <> i.id WHERE o.entity_type IN ('class', 'namespace') AND i.entity_type <> 'namespace' GROUP BY ALL",
    "containment_dedup": f"WITH {_RANGES} SELECT file_path, id, name, line_start, line_end FROM ranges a WHERE NOT EXISTS (SELECT 1 FROM ranges b WHERE a.file_path = b.file_path AND a.name = b.name AND b.line_start < a.line_start AND b.line_end >= a.line_end)",
    "interval_merge": f"WITH {_RANGES}, s AS (SELECT file_path, line_start, line_end, max(line_end) OVER (PARTITION BY file_path ORDER BY line_start, line_end DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ranges), t AS (SELECT *, sum(CASE WHEN m IS NULL OR line_start > m THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY line_start, line_end DESC ROWS UNBOUNDED PRECEDING) AS g FROM s) SELECT file_path, min(line_start) AS line_start, max(line_end) AS line_end FROM t GROUP BY file_path, g",
    "incremental_diff": f"{_DIFF} SELECT CASE WHEN new.file_path IS NULL THEN 'removed' WHEN old.file_path IS NULL THEN 'added' WHEN old.h = new.h THEN 'skipped' ELSE 'updated' END AS status, count(*) AS n FROM old FULL OUTER JOIN new USING (project_id, file_path) GROUP BY 1",
    "stale_files": f"{_DIFF} SELECT project_id, file_path FROM old WHERE (project_id, file_path) NOT IN (SELECT (project_id, file_path) FROM new)",
}
