"""Shared helpers of the training-data operators: shared storage, row identity and Arrow plumbing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.sources.scratch import put, remove
from corpusgraph.sources.scratch import shared_root as shared_dir


_STAGED: list[list[str]] = []  # folders made within each staging() that is open


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Folders that stage_table and others make inside go when the block ends; what is read after it must be written elsewhere."""
    _STAGED.append([])
    try:
        yield
    finally:
        remove(spark, *_STAGED.pop())


def staged_path(spark: SparkSession, label: str, keep: bool = False) -> str:
    path = f"{shared_dir(spark)}/corpusgraph/{label}-{uuid.uuid4().hex}"
    if _STAGED and not keep:
        _STAGED[-1].append(path)
    return path


def stage_table(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder (or a given one) and rereads it: lineage ends here and a lost executor costs no recomputation."""
    path = path or staged_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Growing:
    """A Parquet table of the shared folder that is written in parts, one after the other."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.path, self.schema = spark, staged_path(spark, label), None

    def append(self, df: DataFrame) -> None:
        df.write.mode("append").option("compression", "zstd").parquet(self.path)
        self.schema = df.schema

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def share_bytes(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes a small file into the shared folder and has Spark hand it to every executor; tasks find it by SparkFiles.get(name)."""
    spark.sparkContext.addFile(put(spark, f"{shared_dir(spark)}/corpusgraph/{name}", data))
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into pieces of bounded rows, so that a batch of long texts is never expanded at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)


def has_repeats(df: DataFrame, key: str) -> bool:
    """True if a value of key (null counts as a value) is on more than one row."""
    return bool(df.groupBy(key).count().where(F.col("count") > 1).limit(1).count())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(df: DataFrame, column: str, part_bytes: int = 128 << 20) -> int:
    """Partitions for work on the bytes of a column: as many as the session's setting, more where a part would be larger than part_bytes."""
    size = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(partitions(df.sparkSession), -(-size // part_bytes))


def parts_of(rows: DataFrame, row_bytes: int, part_bytes: int = 128 << 20) -> int:
    """The same for rows of about row_bytes; rows should be a stored table, whose count costs nothing."""
    return max(partitions(rows.sparkSession), -(-rows.count() * row_bytes // part_bytes))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, kept_out: Column, rows: int) -> DataFrame:
    """(y, text, _cg_id) of at most ``rows`` labels of each class, chosen by the hash of their id; the chosen ids, 2 * rows at most, are broadcast.

    A label that is repeated counts as often as it is there, one with both values as both; a document row that is repeated gives a row for each of its labels. Labels without an id
    or of another value than 0 and 1, and documents without a label, take no part.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("_cg_id"), F.col(column).cast("int").alias("y"), "doc_id").where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~kept_out).select("_cg_id", "y")
    chosen = None
    for y in (0, 1):
        part = usable.where(F.col("y") == y).orderBy(F.xxhash64("_cg_id"), "_cg_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    return docs.select(F.col("doc_id").cast("long").alias("_cg_doc"), "text").join(F.broadcast(chosen), F.col("_cg_doc") == F.col("_cg_id")).select("y", "text", F.col("_cg_id"))
