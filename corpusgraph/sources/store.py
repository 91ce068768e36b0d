"""The store of indexed projects: append-only Parquet tables under one folder, read as of the last committed version of each project.

A run writes all that it made under a new version and commits it with one row in ``log``; what a run wrote that failed before is never read. Rows of a file (chunks, raw graph
records, its hash) are written when the file is parsed and live until a later version lists them in ``dead``, so an unchanged file costs nothing. Tables that are derived
from all files of a project (summary, nodes, edges) are snapshots: the last committed version counts.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.sources.scratch import remove

SNAPSHOTS = ("summaries", "nodes", "edges")  # the other tables are by file
_KEY = "project_id string, version long"


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def folder(self, name: str, project: str, version: int) -> str:
        return f"{self.path}/{name}/project=p{project}/version={version}"

    def table(self, name: str, schema: str | None = None) -> DataFrame | None:
        """All that was ever written under a name, committed or not; None, or nothing of the schema, if that is nothing."""
        try:
            rows = self.spark.read.option("mergeSchema", True).parquet(f"{self.path}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema) if schema else None
        return rows.withColumn("version", F.col("version").cast("long")).drop("project")

    def log(self) -> DataFrame:
        """(project_id, version) of all committed runs."""
        return self.table("log", _KEY).select("project_id", "version")

    def next_version(self, project: str) -> int:
        return (self.log().where(F.col("project_id") == project).agg(F.max("version")).first()[0] or 0) + 1

    def append(self, name: str, rows: DataFrame, project: str, version: int) -> None:
        """Writes a version's rows; what a failed run left under the same version goes."""
        rows.withColumn("project_id", F.lit(project)).write.mode("overwrite").parquet(self.folder(name, project, version))

    def bury(self, files: DataFrame, project: str, version: int) -> None:
        """From this version on the rows of files(file_path, version) are dead."""
        self.append("dead", files.select("file_path", F.col("version").alias("of")), project, version)

    def commit(self, project: str, version: int) -> None:
        self.append("log", self.spark.range(1).select(), project, version)

    def live(self, name: str, project: str | None = None) -> DataFrame | None:
        """Rows of a table that count now; None if nothing was ever written."""
        rows = self.table(name)
        if rows is None:
            return None
        committed = self.log()
        if project is not None:
            rows, committed = (x.where(F.col("project_id") == project) for x in (rows, committed))
        if name in SNAPSHOTS:
            last = committed.groupBy("project_id").agg(F.max("version").alias("version"))
            return rows.join(last, ["project_id", "version"], "left_semi")
        rows = rows.join(committed, ["project_id", "version"], "left_semi")
        dead = self.table("dead", f"{_KEY}, file_path string, of long")
        dead = dead.join(committed, ["project_id", "version"], "left_semi").select("project_id", "file_path", F.col("of").alias("version"))
        return rows.join(dead, ["project_id", "file_path", "version"], "left_anti")

    def drop_old_snapshots(self, keep: int = 2) -> int:
        """Removes all but the last ``keep`` committed snapshots of each project; returns how many. Readers of a kept version aren't disturbed."""
        rows = self.log().groupBy("project_id").agg(F.sort_array(F.collect_set("version"), asc=False).alias("v")).collect()
        old = [(r.project_id, version) for r in rows for version in r.v[keep:]]
        remove(self.spark, *(self.folder(name, project, version) for project, version in old for name in SNAPSHOTS))
        return len(old)
