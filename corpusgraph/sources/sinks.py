"""Sinks: chunk tables by collection, file hashes, and graph exports (DOT, GEXF, JSON, HTML)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.operators.graph import subgraph
from corpusgraph.operators.vector import keep_first
from corpusgraph.sources.scratch import cut, join_files, remove

#: Colours of node kinds, head of a DOT file
COLORS = {
    "file": "lightblue", "namespace": "lightgreen", "class": "lightyellow", "struct": "lightyellow", "class_template": "lightyellow", "struct_template": "lightyellow",
    "function": "lightcoral", "function_template": "lightcoral", "type_alias": "lightpink", "concept": "plum",
}
DOT_HEAD = ["digraph KnowledgeGraph {", "  rankdir=LR;", '  node [shape=box, fontname="Helvetica", fontsize=10];', '  edge [fontname="Helvetica", fontsize=9];']


def upsert_chunks(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Last version of every chunk of a collection; new rows replace old ones."""
    every = new.withColumn("_cg_age", F.lit(0))
    if old is not None:
        every = every.unionByName(old.withColumn("_cg_age", F.lit(1)), allowMissingColumns=True)
    return keep_first(every.withColumn("_cg_key", F.concat_ws("\x00", "collection", "chunk_id")), "_cg_key", ["_cg_age"]).drop("_cg_age", "_cg_key")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Parquet by collection and project: filters on them prune whole folders."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection", "project_id").parquet(path)


def collection(spark: SparkSession, path: str, name: str, schema: str = "collection string, project_id string, chunk_id string, text string, embedding array<float>") -> DataFrame:
    """A collection of a chunk table, whose folder is all that is read; an empty one of the schema if there is none yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path).where(F.col("collection") == name)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def stored_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(files, bytes) under a path; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def collection_stats(chunks: DataFrame) -> DataFrame:
    """(collection, n, bytes): chunks of each collection and the bytes of their texts."""
    return chunks.groupBy("collection").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))


def drop_collection(spark: SparkSession, path: str, name: str | None = None) -> None:
    """Removes a collection's folder, or with no name all of them, through Spark's own file system."""
    remove(spark, path if name is None else f"{path.rstrip('/')}/collection={name}")


def write_hashes(files: DataFrame, path: str) -> None:
    files.select("project_id", "file_path", "content_hash").write.mode("overwrite").parquet(path)


def _quoted(x: Column | str) -> Column:
    return F.replace(F.col(x) if isinstance(x, str) else x, F.lit('"'), F.lit('\\"'))


def dot_lines(nodes: DataFrame, edges: DataFrame, project: str | None = None, types: list[str] | None = None, cluster: bool = True) -> DataFrame:
    """(part, id, line): lines of a DOT file in order of part and id. Members of a namespace stand in its cluster, and then containment isn't drawn."""
    spark = nodes.sparkSession
    n, e = subgraph(nodes, edges, project, types)
    color = F.lit("white")
    for kind, c in COLORS.items():
        color = F.when(F.col("entity_type") == kind, F.lit(c)).otherwise(color)
    shown = n.select("id", "entity_type", "name", F.concat(F.lit('"'), "id", F.lit('" [label="'), _quoted(F.coalesce("name", "id")), F.lit('", style=filled, fillcolor='), color, F.lit("];")).alias("line"))
    head = spark.createDataFrame([(0, f"{i:04d}", x) for i, x in enumerate(DOT_HEAD)] + [(9, "", "}")], "part int, id string, line string")
    drawn = e
    if cluster:
        inside = e.where("relation_type = 'CONTAINS'").join(n.where("entity_type = 'namespace'").select(F.col("id").alias("src"), F.col("name").alias("ns")), "src")
        safe = F.translate("src", ":/", "__")
        open_ = inside.select("src", "ns").distinct().select(F.lit(1).alias("part"), F.concat("src", F.lit("\x000")).alias("id"), F.concat(F.lit("  subgraph cluster_"), safe, F.lit(' {\n    label="'), _quoted("ns"), F.lit('";\n    style=filled;\n    color=lightgrey;\n    fontsize=12;')).alias("line"))
        body = inside.join(shown.select(F.col("id").alias("dst"), "line"), "dst").select(F.lit(1).alias("part"), F.concat("src", F.lit("\x001"), "dst").alias("id"), F.concat(F.lit("    "), "line").alias("line"))
        close = inside.select("src").distinct().select(F.lit(1).alias("part"), F.concat("src", F.lit("\x002")).alias("id"), F.lit("  }").alias("line"))
        head = head.unionByName(open_).unionByName(body).unionByName(close)
        shown = shown.join(inside.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
        drawn = e.where("relation_type <> 'CONTAINS'")
    alone = shown.select(F.lit(2).alias("part"), "id", F.concat(F.lit("  "), "line").alias("line"))
    arrows = drawn.select(F.lit(3).alias("part"), F.concat("src", F.lit("\x00"), "dst").alias("id"), F.concat(F.lit('  "'), "src", F.lit('" -> "'), "dst", F.lit('" [label="'), "relation_type", F.lit('"];')).alias("line"))
    return head.unionByName(alone).unionByName(arrows)


def write_lines(lines: DataFrame, path: str) -> None:
    """A folder of text files whose names' order is the lines' order."""
    lines.orderBy("part", "id", "line").select("line").write.mode("overwrite").text(path)


def export_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, id, line): one JSON object for each node and edge."""
    n = nodes.select(F.lit("nodes").alias("part"), "id", F.to_json(F.struct(*(F.col(c) for c in nodes.columns))).alias("line"))
    e = edges.select(F.lit("edges").alias("part"), F.concat("src", F.lit("\x00"), "dst").alias("id"), F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), *(F.col(c) for c in edges.columns if c not in ("src", "dst")))).alias("line"))
    return n.unionByName(e)


#: First and last line of a node-link document that has one element a line; files.graph_json reads these in parallel
DOCUMENT_HEAD, DOCUMENT_TAIL = '{"directed": true, "multigraph": false, "graph": {"layout": "lines"}, "nodes": [', "]}"


def graph_document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, id, line) of one node-link JSON document, {"nodes": [...], "edges": [...]}, that files.graph_json reads. Equal relations between two nodes show once.

    Each element has a line of its own, and an edge's object stands after a blank: so a line tells what it is wherever a reader's task begins.
    """
    spark = nodes.sparkSession
    key = F.when(F.col("part") == "edges", F.concat("id", F.lit("\x00"), F.get_json_object("line", "$.relation_type"))).otherwise(F.col("id"))
    rows = export_json(nodes, edges.dropDuplicates(["src", "dst", "relation_type"])).withColumn("id", key)
    least = (nodes.agg(F.min("id")).scalar(), edges.agg(F.min(F.concat("src", F.lit("\x00"), "dst", F.lit("\x00"), "relation_type"))).scalar())
    fixed = spark.createDataFrame([(0, "", DOCUMENT_HEAD), (2, "", '], "edges": ['), (4, "", DOCUMENT_TAIL)], "part int, id string, line string")
    for (kind, part, blank), first in zip((("nodes", 1, ""), ("edges", 3, " ")), least, strict=True):
        mine = rows.where(F.col("part") == kind)
        fixed = fixed.unionByName(mine.select(F.lit(part).alias("part"), "id", F.concat(F.when(F.col("id") == first, blank).otherwise("," + blank), "line").alias("line")))
    return fixed


def write_document(lines: DataFrame, path: str) -> None:
    """One text file, as a reader of the whole document needs it; the order of parts and ids is the lines' order. Parts are sorted and written in parallel, then joined byte by byte."""
    spark = lines.sparkSession
    remove(spark, path)
    lines.orderBy("part", "id", "line").select("line").write.text(f"{path}/_parts")
    join_files(spark, f"{path}/_parts", f"{path}/part-00000.txt")
    remove(spark, f"{path}/_parts")


def _xml(x: Column | str) -> Column:
    c = F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def gexf_lines(nodes: DataFrame, edges: DataFrame, project: str | None = None) -> DataFrame:
    """(part, id, line) of a GEXF 1.2 file; kinds and names are attributes."""
    n, e = subgraph(nodes, edges, project)
    fixed = [(0, '<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2"><graph defaultedgetype="directed"><attributes class="node"><attribute id="0" title="entity_type" type="string"/></attributes><attributes class="edge"><attribute id="1" title="relation_type" type="string"/></attributes><nodes>'), (2, "</nodes><edges>"), (4, "</edges></graph></gexf>")]
    head = n.sparkSession.createDataFrame([(p, "", x) for p, x in fixed], "part int, id string, line string")
    rows = n.select(F.lit(1).alias("part"), "id", F.concat(F.lit('<node id="'), _xml("id"), F.lit('" label="'), _xml(F.coalesce("name", "id")), F.lit('"><attvalues><attvalue for="0" value="'), _xml("entity_type"), F.lit('"/></attvalues></node>')).alias("line"))
    links = e.select(F.lit(3).alias("part"), F.concat("src", F.lit("\x00"), "dst").alias("id"), F.concat(F.lit('<edge id="'), _xml(F.concat("src", F.lit("|"), "dst", F.lit("|"), "relation_type")), F.lit('" source="'), _xml("src"), F.lit('" target="'), _xml("dst"), F.lit('"><attvalues><attvalue for="1" value="'), _xml("relation_type"), F.lit('"/></attvalues></edge>')).alias("line"))
    return head.unionByName(rows).unionByName(links)


_PAGE = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>Code graph of {project}</title>
<style>body{{font:14px sans-serif;margin:8px}}canvas{{border:1px solid #ccc}}#about{{white-space:pre-wrap;color:#444}}</style></head>
<body><h1>{project}</h1><p>{n_nodes} nodes, {n_edges} edges</p>
<input id="find" placeholder="name"><select id="type"><option value="">every type</option>{options}</select><select id="relation"><option value="">every relation</option>{relations}</select>
<br><canvas id="view" width="1200" height="760"></canvas><div id="about"></div>
<script>const graph={data}, colors={colors};
const view=document.getElementById("view"),pen=view.getContext("2d"),find=document.getElementById("find"),type=document.getElementById("type"),relation=document.getElementById("relation"),about=document.getElementById("about");
const spot=new Map(graph.nodes.map((n,i)=>[n.id,{{n,x:600+40*Math.sqrt(i)*Math.cos(2.4*i),y:380+40*Math.sqrt(i)*Math.sin(2.4*i),dx:0,dy:0}}]));
let scale=1,left=0,top_=0,held=null,heat=1;
const shown=s=>(!type.value||s.n.entity_type===type.value)&&(s.n.name||"").includes(find.value);
const links=()=>graph.edges.filter(e=>spot.has(e.source)&&spot.has(e.target)&&(!relation.value||e.relation_type===relation.value));
function step(){{const all=[...spot.values()];
if(heat>0.01&&all.length<=1500){{for(const a of all)for(const b of all)if(a!==b){{const x=a.x-b.x,y=a.y-b.y,d=x*x+y*y+1;a.dx+=900*x/d;a.dy+=900*y/d}}
for(const e of links()){{const a=spot.get(e.source),b=spot.get(e.target),x=b.x-a.x,y=b.y-a.y;a.dx+=x/40;a.dy+=y/40;b.dx-=x/40;b.dy-=y/40}}
for(const s of all){{if(s!==held){{s.x+=heat*Math.max(-20,Math.min(20,s.dx));s.y+=heat*Math.max(-20,Math.min(20,s.dy))}}s.dx=s.dy=0}}heat*=0.985}}
draw();requestAnimationFrame(step)}}
function draw(){{pen.setTransform(1,0,0,1,0,0);pen.clearRect(0,0,view.width,view.height);pen.setTransform(scale,0,0,scale,left,top_);pen.strokeStyle="#bbb";
for(const e of links()){{const a=spot.get(e.source),b=spot.get(e.target);if(shown(a)&&shown(b)){{pen.beginPath();pen.moveTo(a.x,a.y);pen.lineTo(b.x,b.y);pen.stroke()}}}}
for(const s of spot.values())if(shown(s)){{pen.fillStyle=colors[s.n.entity_type]||"white";pen.beginPath();pen.arc(s.x,s.y,7,0,7);pen.fill();pen.strokeStyle="#555";pen.stroke();if(scale>0.6){{pen.fillStyle="#222";pen.fillText(s.n.name||s.n.id,s.x+9,s.y+3)}}}}}}
const at=ev=>[(ev.offsetX-left)/scale,(ev.offsetY-top_)/scale];
view.onmousedown=ev=>{{const [x,y]=at(ev);held=[...spot.values()].find(s=>shown(s)&&(s.x-x)**2+(s.y-y)**2<100)||"view";
if(held!=="view")about.textContent=held.n.name+" ("+held.n.entity_type+")\\n"+graph.edges.filter(e=>e.source===held.n.id||e.target===held.n.id).map(e=>e.source+" "+e.relation_type+" "+e.target).join("\\n")}};
view.onmousemove=ev=>{{if(held==="view"){{left+=ev.movementX;top_+=ev.movementY}}else if(held){{[held.x,held.y]=at(ev);heat=Math.max(heat,0.3)}}}};
view.onmouseup=view.onmouseleave=()=>held=null;
view.onwheel=ev=>{{ev.preventDefault();const [x,y]=at(ev);scale*=ev.deltaY<0?1.1:1/1.1;left=ev.offsetX-x*scale;top_=ev.offsetY-y*scale}};
step();</script></body></html>
"""


def type_lists(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entity types and relation types that occur, in order."""
    return tuple(df.select(c).where(F.col(c) != "").distinct().orderBy(c) for df, c in ((nodes, "entity_type"), (edges, "relation_type")))


def _listed(kinds) -> str:
    return "".join(f"<option>{t}</option>" for t in sorted(set(filter(None, kinds))))


def html_lines(nodes: DataFrame, edges: DataFrame, project: str | None = None, types: list[str] | None = None) -> DataFrame:
    """(part, id, line) of the page of a graph of any size: nodes and edges stay in tasks, only counts by type come to the driver. write_document makes it one file."""
    n, e = subgraph(nodes, edges, project, types)
    kept, counts = [], []
    shown = ((n, "entity_type", ("id",), F.struct("id", "name", "entity_type")), (e, "relation_type", ("src", "dst", "relation_type"), F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "relation_type")))
    for df, kind, keys, item in shown:
        key = F.concat(*(F.concat(F.lit("\x00"), F.coalesce(c, F.lit(""))) for c in keys))
        line = F.replace(F.to_json(item, {"ignoreNullFields": "false"}), F.lit("</"), F.lit("<\\/"))
        kept.append(cut(df.select(key.alias("id"), line.alias("line"), F.col(kind).alias("kind"), F.monotonically_increasing_id().alias("nth")), "page"))
        counts.append({r[0]: r[1] for r in kept[-1].groupBy("kind").count().collect()})
    n_by, e_by = counts
    head, tail = _PAGE.format(project=project or "all", n_nodes=sum(n_by.values()), n_edges=sum(e_by.values()), options=_listed(n_by), relations=_listed(e_by), colors=json.dumps(COLORS), data="\x00").split("\x00")
    fixed = n.sparkSession.createDataFrame([(0, "", head + '{"nodes": ['), (2, "", '], "edges": ['), (4, "", "]}" + tail)], "part int, id string, line string")
    for part, rows in zip((1, 3), kept, strict=True):
        first = F.col("nth") == rows.agg(F.min(F.struct("id", "nth"))["nth"]).scalar()  # it has no comma, and stands before all others
        fixed = fixed.unionByName(rows.select(F.lit(part).alias("part"), F.when(first, "").otherwise(F.col("id")).alias("id"), F.concat(F.when(first, "").otherwise(","), "line").alias("line")))
    return fixed


def html_page(nodes: DataFrame, edges: DataFrame, project: str | None = None, types: list[str] | None = None, most: int = 50_000) -> str:
    """One page with the graph in it, as a string of the driver: more than ``most`` nodes or edges are refused, never cut; html_lines has no such limit."""
    n, e = subgraph(nodes, edges, project, types)
    n_rows, e_rows = n.select("id", "name", "entity_type").limit(most + 1).collect(), e.select("src", "dst", "relation_type").limit(most + 1).collect()
    if len(n_rows) > most or len(e_rows) > most:
        raise ValueError(f"more than {most} nodes or edges: filter by project or relation type, or write html_lines")
    data = {"nodes": [r.asDict() for r in sorted(n_rows)], "edges": [{"source": r.src, "target": r.dst, "relation_type": r.relation_type} for r in sorted(e_rows)]}
    options, relations = _listed(r.entity_type for r in n_rows), _listed(r.relation_type for r in e_rows)
    return _PAGE.format(project=project or "all", n_nodes=len(n_rows), n_edges=len(e_rows), options=options, relations=relations, colors=json.dumps(COLORS), data=json.dumps(data, ensure_ascii=False, default=str).replace("</", "<\\/"))
