"""The graph as an object: a contract that any storage may fulfil, and its form over two DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.operators import graph as G
from corpusgraph.sources.scratch import cut

NODES = "id string, project_id string, file_path string, entity_type string, name string, line_start int, line_end int, declaration string, chunk_id string, seq long"
EDGES = "src string, dst string, relation_type string, file_path string, line int, seq long"


class GraphBackend(Protocol):
    """What the graph queries need of a storage. Nodes and edges go in and come out as tables; ids, types and depths are values."""

    def add_entities(self, nodes: DataFrame) -> GraphBackend: ...
    def remove_entities(self, ids: DataFrame) -> GraphBackend: ...
    def add_relations(self, edges: DataFrame) -> GraphBackend: ...
    def remove_relation(self, src: str, dst: str, relation_type: str | None = None) -> GraphBackend: ...
    def get_entity(self, key: str) -> DataFrame: ...
    def get_neighbors(self, key: str, direction: str = "both", types: list[str] | None = None) -> DataFrame: ...
    def get_entities_in_file(self, path: str, project: str | None = None) -> DataFrame: ...
    def get_paths(self, src: str, dst: str, max_hops: int = 5, types: list[str] | None = None) -> DataFrame: ...
    def get_impact_scope(self, key: str, depth: int = 3, types: list[str] | None = None) -> DataFrame: ...
    def stats(self) -> DataFrame: ...
    def nodes(self) -> DataFrame: ...
    def edges(self) -> DataFrame: ...
    def clear(self) -> GraphBackend: ...
    def save(self, path: str) -> None: ...


class GraphTables:
    """A graph of two tables. A change gives a new object and leaves the old one as it was; tables are cut from their lineage at each change."""

    def __init__(self, spark: SparkSession, nodes: DataFrame | None = None, edges: DataFrame | None = None, extract: Callable[[DataFrame, str], tuple] | None = None) -> None:
        self.spark, self.extract = spark, extract
        self._nodes = spark.createDataFrame([], NODES) if nodes is None else nodes
        self._edges = spark.createDataFrame([], EDGES) if edges is None else edges

    @staticmethod
    def load(spark: SparkSession, path: str, extract: Callable[[DataFrame, str], tuple] | None = None) -> GraphTables:
        """The graph that save() wrote; an empty one if there is none."""
        from corpusgraph.sources.files import table_or_empty

        return GraphTables(spark, table_or_empty(spark, f"{path}/nodes", NODES), table_or_empty(spark, f"{path}/edges", EDGES), extract)

    def _with(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> GraphTables:
        return GraphTables(self.spark, self._nodes if nodes is None else cut(nodes, "nodes"), self._edges if edges is None else cut(edges, "edges"), self.extract)

    def _placed(self, rows: DataFrame, schema: str, after: DataFrame) -> DataFrame:
        """Rows in the table's columns, written after all that is there: in the order of their own seq, if they have one."""
        empty = self.spark.createDataFrame([], schema)
        last = after.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        own = F.dense_rank().over(G.Window.orderBy("seq")) if "seq" in rows.columns else F.lit(1)
        return empty.unionByName(rows.withColumn("seq", (own + last).cast("long")).select([c for c in rows.columns if c in empty.columns and c != "seq"] + ["seq"]), allowMissingColumns=True)

    def add_entities(self, nodes: DataFrame) -> GraphTables:
        return self._with(nodes=G.upsert_nodes(self._nodes, self._placed(nodes, NODES, self._nodes)))

    def remove_entities(self, ids: DataFrame) -> GraphTables:
        return self._with(*G.remove_nodes(self._nodes, self._edges, ids))

    def add_relations(self, edges: DataFrame) -> GraphTables:
        """Ends that no node has become nodes of an id alone."""
        every = G.upsert_edges(self._edges, self._placed(edges, EDGES, self._edges))
        made = self._with(edges=every)
        return made.add_entities(G.stub_nodes(made._nodes, made._edges))

    def remove_relation(self, src: str, dst: str, relation_type: str | None = None) -> GraphTables:
        return self._with(edges=G.remove_edges(self._edges, src, dst, relation_type))

    def get_entity(self, key: str) -> DataFrame:
        return G.get_node(self._nodes, key)

    def get_neighbors(self, key: str, direction: str = "both", types: list[str] | None = None) -> DataFrame:
        return G.neighbors(self._edges, key, direction, types)

    def get_entities_in_file(self, path: str, project: str | None = None) -> DataFrame:
        return G.in_file(self._nodes, path, project)

    def get_paths(self, src: str, dst: str, max_hops: int = 5, types: list[str] | None = None) -> DataFrame:
        return G.simple_paths(self._edges, src, dst, max_hops, types)

    def get_impact_scope(self, key: str, depth: int = 3, types: list[str] | None = None) -> DataFrame:
        return G.reach(self._edges, G.ids(self.spark, key), depth, types)

    def stats(self) -> DataFrame:
        return G.stats(self._nodes, self._edges)

    def nodes(self) -> DataFrame:
        return self._nodes

    def edges(self) -> DataFrame:
        return self._edges

    def clear(self) -> GraphTables:
        return GraphTables(self.spark, extract=self.extract)

    def save(self, path: str) -> None:
        """Replaces what is stored at the path; the tables are cut first, so that a graph may be saved where it was loaded."""
        kept = self._with(self._nodes, self._edges)
        kept._nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        kept._edges.write.mode("overwrite").parquet(f"{path}/edges")

    def add_files(self, files: DataFrame, project: str) -> GraphTables:
        """Entities and relations of files(file_path, source)."""
        extract = self.extract
        if extract is None:
            from corpusgraph.sources.code_graph import build as extract
        nodes, edges = extract(files, project)[:2]
        return self.add_entities(nodes).add_relations(edges.withColumn("seq", F.when(F.col("relation_type") == "CONTAINS", 2).otherwise(1)))

    def remove_files(self, files: DataFrame, project: str) -> GraphTables:
        """Without the entities of files(file_path) and all edges that touch them."""
        gone = self._nodes.where(F.col("project_id") == project).join(files.select("file_path").distinct(), "file_path", "left_semi")
        return self.remove_entities(gone)

    def update_files(self, files: DataFrame, project: str) -> GraphTables:
        """What the files held before goes, what they hold now comes."""
        return self.remove_files(files, project).add_files(files, project)

    def add_chunks(self, chunks: DataFrame, project: str) -> GraphTables:
        """Entities of chunks(file_path, text): a chunk's text is read as its file's source."""
        return self.add_files(chunks.select("file_path", F.col("text").alias("source")), project)

    def update_chunks(self, chunks: DataFrame, project: str) -> GraphTables:
        return self.update_files(chunks.select("file_path", F.col("text").alias("source")), project)
