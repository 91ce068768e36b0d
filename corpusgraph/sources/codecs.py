"""Rows of entities, relations and chunks as JSON text, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTITY = "id string, project_id string, file_path string, entity_type string, name string, line_start int, line_end int, declaration string, chunk_id string"
RELATION = "src string, dst string, relation_type string, file_path string, line int"
CHUNK = "chunk_id string, text string, file_path string, language string, chunk_type string, name string, line_start int, line_end int, project_id string, project_name string, document_kind string, semantic_summary string, is_private boolean, privacy_summary string"


def to_records(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, record): each row as one JSON object; null fields are left out."""
    return rows.select(*keys, F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns))).alias("record"))


def from_records(records: DataFrame, schema: str) -> DataFrame:
    """Rows of a schema; fields that a record lacks are null, others are passed over, and records that don't read give none."""
    read = records.select(F.from_json("record", f"{schema}, _cg_bad string", {"columnNameOfCorruptRecord": "_cg_bad"}).alias("r"))
    return read.where("r is not null and r._cg_bad is null").select("r.*").drop("_cg_bad")
