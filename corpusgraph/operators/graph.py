"""Property graph as two DataFrames: nodes(id, ..., seq) and edges(src, dst, relation_type, ..., seq).

seq is the order of insertion: the last writer of a node id or of a (src, dst) pair wins, the first match of a name counts. Traversals are frontier
loops: each step joins the frontier with the edges and drops what was reached before, so a dense graph costs its edges once a step, not its paths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.sources.scratch import cut

LEVELS = 3  # steps of growing paths in one plan; longer ones are cut there
FORWARD = ("CALLS", "REFERENCES", "INHERITS_FROM")


def node_id(project: Column | str, path: Column | str, kind: Column | str, name: Column | str) -> Column:
    return F.concat_ws(":", *(F.col(x) if isinstance(x, str) else x for x in (project, path, kind, name)))


def _last(rows: DataFrame, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("seq"))
    return rows.withColumn("_cg_rn", F.row_number().over(w)).where("_cg_rn = 1").drop("_cg_rn")


def upsert_nodes(nodes: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """Last version of every node; it keeps the place of the first."""
    every = nodes if new is None else nodes.unionByName(new, allowMissingColumns=True)
    first = F.min("seq").over(Window.partitionBy("id"))
    return _last(every.withColumn("_cg_first", first), "id").withColumn("seq", F.col("_cg_first")).drop("_cg_first")


def upsert_edges(edges: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """One edge for each ordered pair: the last written."""
    return _last(edges if new is None else edges.unionByName(new, allowMissingColumns=True), "src", "dst")


def stub_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids that only edges know, one row each."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return ends.join(nodes.select("id"), "id", "left_anti")


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the given ids and the edges that touch them."""
    ids = gone.select("id").distinct()
    left = edges.join(ids, F.col("src") == F.col("id"), "left_anti").join(ids, F.col("dst") == F.col("id"), "left_anti")
    return nodes.join(ids, "id", "left_anti"), left


def remove_edges(edges: DataFrame, src: str, dst: str, relation_type: str | None = None) -> DataFrame:
    hit = (F.col("src") == src) & (F.col("dst") == dst)
    return edges.where(~(hit if relation_type is None else hit & (F.col("relation_type") == relation_type)))


def of_types(edges: DataFrame, types: list[str] | tuple[str, ...] | None) -> DataFrame:
    return edges if types is None else edges.where(F.col("relation_type").isin(*types))


def neighbors(edges: DataFrame, start: str, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """(id, relation_type, direction); an edge to itself shows once in each direction."""
    e = of_types(edges, types)
    out = e.where(F.col("src") == start).select(F.col("dst").alias("id"), "relation_type", F.lit("out").alias("direction"))
    into = e.where(F.col("dst") == start).select(F.col("src").alias("id"), "relation_type", F.lit("in").alias("direction"))
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction]


def _steps(edges: DataFrame, types: list[str] | tuple[str, ...] | None, direction: str) -> DataFrame:
    """(a, b) for each step; both directions come from one pass over the edges."""
    e = of_types(edges, types)
    one = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    if direction == "both":
        return e.select(F.explode(F.array(one("src", "dst"), one("dst", "src"))).alias("s")).select("s.*")
    return e.select(F.col("src").alias("a"), F.col("dst").alias("b")) if direction == "out" else e.select(F.col("dst").alias("a"), F.col("src").alias("b"))


def reach(edges: DataFrame, seeds: DataFrame, depth: int = 3, types: list[str] | tuple[str, ...] | None = None, direction: str = "out", keep_seeds: bool = False) -> DataFrame:
    """(id, depth) of what is within ``depth`` steps of the seeds (a table of ids), by least depth; seeds only with keep_seeds, where a cycle leads back to them.

    Every level joins the last frontier with the edges and drops what was reached before. A frontier is written, so its size is known when the next level is planned: a small one is
    broadcast by Spark's own measure and the edges are only scanned, a large one meets them in a shuffle. Edges are never copied, and an empty frontier ends the loop. Edges that cost
    much to make should be stored first.
    """
    steps = _steps(edges, types, direction)
    seeds = seeds.select("id").distinct()
    frontier = seeds
    reached = None if keep_seeds else seeds
    levels: list[DataFrame] = []
    for n in range(1, depth + 1):
        new = steps.join(frontier, F.col("a") == F.col("id")).select(F.col("b").alias("id")).distinct()
        if reached is not None:
            new = new.join(reached, "id", "left_anti")
        frontier = cut(new, "frontier")
        levels.append(frontier.withColumn("depth", F.lit(n)))
        reached = frontier if reached is None else reached.unionByName(frontier)
        if n < depth and frontier.isEmpty():
            break
    return reduce(DataFrame.unionByName, levels)


def ids(spark, *values: str) -> DataFrame:
    """A table of ids whose size the planner knows."""
    return spark.range(1).select(F.explode(F.array(*map(F.lit, values)).cast("array<string>")).alias("id"))


def simple_paths(edges: DataFrame, src: str, dst: str, max_hops: int = 5, types: list[str] | None = None) -> DataFrame:
    """(hops, path array): all paths without a repeated node; none if src is dst.

    Edges that can't lie on such a path are dropped before paths are built: first those that no short walk from src meets, then, among what is left, those from
    whose end dst is too far. Only paths that can still arrive grow.
    """
    spark = edges.sparkSession
    if src == dst:
        return spark.createDataFrame([], "hops int, path array<string>")
    e = of_types(edges, types).select("src", "dst", F.lit("").alias("relation_type"))
    ahead = reach(e, ids(spark, src), max_hops - 1).select("id").unionByName(ids(spark, src)) if max_hops > 1 else ids(spark, src)
    e = cut(e.join(ahead, F.col("src") == F.col("id"), "left_semi").distinct(), "edges")
    level = ids(spark, dst)
    levels = [level.withColumn("left", F.lit(0))]
    for n in range(1, max_hops):  # one plan over what is left of the edges
        level = e.join(level, F.col("dst") == F.col("id")).select(F.col("src").alias("id")).distinct()
        levels.append(level.withColumn("left", F.lit(n)))
    left = reduce(DataFrame.unionByName, levels).groupBy("id").agg(F.min("left").alias("left"))
    e = cut(e.join(left, F.col("dst") == F.col("id")).select("src", "dst", "left"), "edges")
    paths = ids(spark, src).select(F.array("id").alias("path"))
    done: list[DataFrame] = []
    for n in range(1, max_hops + 1):
        grown = paths.join(e.where(F.col("left") <= max_hops - n), F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        grown = grown.select(F.concat("path", F.array("dst")).alias("path"))
        grown = cut(grown, "paths") if n % LEVELS == 0 and n < max_hops else grown
        done.append(grown.where(F.element_at("path", -1) == dst).select(F.lit(n).alias("hops"), "path"))
        paths = grown.where(F.element_at("path", -1) != dst)
    return reduce(DataFrame.unionByName, done)


def find_node(nodes: DataFrame, name: str, types: list[str] | None = None, project: str | None = None) -> DataFrame:
    """First node of that name in insertion order."""
    n = nodes.where(F.col("name") == name)
    n = n if types is None else n.where(F.col("entity_type").isin(*types))
    n = n if project is None else n.where(F.col("project_id") == project)
    return n.orderBy("seq", "id").limit(1)


def find_file(nodes: DataFrame, path: str, project: str | None = None) -> DataFrame:
    n = nodes.where((F.col("entity_type") == "file") & (F.col("file_path") == path))
    return (n if project is None else n.where(F.col("project_id") == project)).orderBy("seq", "id").limit(1)


def in_file(nodes: DataFrame, path: str, project: str | None = None) -> DataFrame:
    n = nodes.where(F.col("file_path") == path)
    return n if project is None else n.where(F.col("project_id") == project)


def callers(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """Who calls the seeds, directly or not; a recursive function lists itself."""
    return reach(edges, seeds, depth, ("CALLS",), "in", keep_seeds=True)


def callees(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    return reach(edges, seeds, depth, ("CALLS",), "out", keep_seeds=True)


def class_hierarchy(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, role): parents, children, siblings; a sibling shows once for each parent that it shares."""
    e = of_types(edges, ("INHERITS_FROM",)).select("src", "dst")
    s = seeds.select(F.col("id").alias("_cg_seed"))
    parents = e.join(s, F.col("src") == F.col("_cg_seed")).select(F.col("_cg_seed"), F.col("dst").alias("id"))
    children = e.join(s, F.col("dst") == F.col("_cg_seed")).select(F.col("src").alias("id"))
    siblings = parents.join(e, F.col("id") == F.col("dst")).where(F.col("src") != F.col("_cg_seed")).select(F.col("src").alias("id"))
    role = lambda df, r: df.select("id", F.lit(r).alias("role"))
    return role(parents, "parent").unionByName(role(children, "child")).unionByName(role(siblings, "sibling"))


def dependencies(edges: DataFrame, start: str) -> DataFrame:
    return neighbors(edges, start, "out", ["INCLUDES"]).select("id")


def dependents(edges: DataFrame, start: str) -> DataFrame:
    return neighbors(edges, start, "in", ["INCLUDES"]).select("id")


def concept_implementations(edges: DataFrame, start: str) -> DataFrame:
    return neighbors(edges, start, "in", ["IMPLEMENTS", "USES_CONCEPT"]).select("id", "relation_type")


def impact(edges: DataFrame, start: str, depth: int = 3, file_id: str | None = None) -> DataFrame:
    """(id, role, depth): direct callers and callees, everything that the node leads to, and the files that include its file."""
    spark = edges.sparkSession
    row = lambda df, r: df.select("id", F.lit(r).alias("role"), F.lit(1).alias("depth"))
    out = row(neighbors(edges, start, "in", ["CALLS"]), "direct_caller").unionByName(row(neighbors(edges, start, "out", ["CALLS"]), "direct_callee"))
    out = out.unionByName(reach(edges, ids(spark, start), depth, FORWARD).select("id", F.lit("transitive").alias("role"), "depth"))
    return out if file_id is None else out.unionByName(row(dependents(edges, file_id), "file_dependent"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): totals and counts by entity and relation type, each table in one pass."""

    def counts(df: DataFrame, by: str, total: str) -> DataFrame:
        whole = F.grouping(by) == 1
        rows = df.select(by).rollup(by).agg(F.count("*").alias("n"), F.when(whole, F.lit("total")).otherwise(F.lit(by)).alias("kind"), F.when(whole, F.lit(total)).otherwise(F.col(by)).alias("name"))
        return rows.select("kind", "name", "n")

    return counts(nodes, "entity_type", "nodes").unionByName(counts(edges, "relation_type", "edges"))


def get_node(nodes: DataFrame, key: str) -> DataFrame:
    """The node of an id, or no row; the id reaches the scan as a pushed filter."""
    return nodes.where(F.col("id") == key)


def subgraph(nodes: DataFrame, edges: DataFrame, project: str | None = None, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes of a project and the edges of the given types between them."""
    n = nodes if project is None else nodes.where(F.col("project_id") == project)
    e = of_types(edges, types)
    for end in ("src", "dst"):
        e = e.join(n.select(F.col("id").alias(end)), end, "left_semi")
    return n, e.select(*edges.columns)
