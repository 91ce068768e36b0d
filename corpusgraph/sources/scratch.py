"""Fresh folders that driver and executors share, and tables that cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN = os.path.join(tempfile.gettempdir(), "checkpoints", f"corpusgraph-{os.getpid()}")


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. In local mode without that setting a temporary one, which goes with the process; on a cluster an error."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not os.path.isdir(_OWN):
        os.makedirs(_OWN)
        atexit.register(shutil.rmtree, _OWN, ignore_errors=True)
    return f"file://{_OWN}"


def scratch_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def put(spark: SparkSession, path: str, data: bytes) -> str:
    """Writes one small file through Spark's own file system, wherever that is; returns its full name."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(target)
    for at in range(0, len(data), 1 << 20):
        out.write(bytearray(data[at : at + (1 << 20)]))
    out.close()
    return fs.makeQualified(target).toString()


def join_files(spark: SparkSession, folder: str, path: str) -> None:
    """The files of a folder (hidden ones left out) as one file, in order of their names, through Spark's own file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(path)
    fs = source.getFileSystem(conf)
    out = fs.create(target)
    for part in sorted((f.getPath() for f in fs.listStatus(source) if f.getPath().getName()[0] not in "._"), key=lambda x: x.getName()):
        into = fs.open(part)
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(into, out, 1 << 20, False)
        into.close()
    out.close()


def ends(spark: SparkSession, path: str, first: int, last: int) -> list[tuple[str, bytes, bytes]]:
    """(name, first bytes, last bytes) of a file, or of the files of a folder; hidden ones are left out, and none are found where there is nothing."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for f in fs.listStatus(target) if fs.exists(target) else []:
        if f.isFile() and f.getPath().getName()[0] not in "._":
            into = fs.open(f.getPath())
            head = bytes(into.readNBytes(first))
            into.seek(max(0, f.getLen() - last))
            found.append((f.getPath().toString(), head, bytes(into.readNBytes(last))))
            into.close()
    return found


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes files and folders through Spark's own file system; what isn't there is no error."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table of the shared folder: later steps neither recompute it nor depend on the executors that made it."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
