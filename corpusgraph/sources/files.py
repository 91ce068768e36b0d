"""File sources: discovery with exclusions, archives, stored tables that may be missing, labels and rules as JSON."""

from __future__ import annotations

import bz2
import gzip
import io
import json
import os
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgraph.functions.text import base_name, extension
from corpusgraph.operators.rules import PrivacyRules
from corpusgraph.sources.scratch import ends
from corpusgraph.sources.sinks import DOCUMENT_HEAD, DOCUMENT_TAIL

#: Suffixes of languages, and what is never read
EXTENSIONS = {"python": (".py",), "c": (".c", ".h"), "cpp": (".cpp", ".cc", ".cxx", ".hpp", ".hh"), "verilog": (".v",), "systemverilog": (".sv",), "doc": (".md", ".markdown", ".docx")}
EXCLUDED_PARTS = ("__pycache__", "node_modules", ".git", ".pytest_cache", ".ruff_cache", ".mypy_cache", ".venv", "venv", "build", "dist", ".tox", ".eggs", "*.egg-info")
EXCLUDED_SUFFIXES = (".pyc", ".pyo", ".so", ".o", ".obj", ".exe", ".dll", ".dylib")
EXCLUDED_NAMES = (".DS_Store", "Thumbs.db")

FILES = "file_path string, ext string, source string, content_hash string"


def languages_of(text: str) -> list[str]:
    """Comma-separated language names, known ones only; none left is an error."""
    found = [x.strip().lower() for x in text.split(",") if x.strip().lower() in EXTENSIONS]
    if not found:
        raise ValueError(f"no known language in {text!r}; known: {', '.join(sorted(EXTENSIONS))}")
    return list(dict.fromkeys(found))


def is_excluded(path: Column | str) -> Column:
    """Relative path with an excluded or hidden part, a binary suffix or an excluded name."""
    p = F.col(path) if isinstance(path, str) else path
    part = F.exists(F.split(p, "/"), lambda x: x.isin(*EXCLUDED_PARTS) | x.startswith("."))
    return part | extension(p).isin(*EXCLUDED_SUFFIXES) | base_name(p).isin(*EXCLUDED_NAMES)


def discover(spark: SparkSession, root: str, languages: list[str] | None = None, exclude: bool = True) -> DataFrame:
    """files(file_path, ext, source, content_hash) under a root; paths are relative to it, contents UTF-8 with replacements.

    The suffixes reach the source as a glob, so other files aren't opened. exclude=False reads what a watch would.
    """
    suffixes = [e for x in (languages or list(EXTENSIONS)) for e in EXTENSIONS[x]]
    glob = "*{" + ",".join(sorted(suffixes)) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = "/" + root.split("://", 1)[-1].split(":", 1)[-1].strip("/") + "/"
    rows = raw.select(F.substring_index("path", base, -1).alias("file_path"), "content")
    rows = rows.where(~is_excluded("file_path")) if exclude else rows
    return decoded(rows)


def discover_uploaded(spark: SparkSession, root: str, languages: str = "python,c,cpp") -> DataFrame:
    """Files of an uploaded project: Python, C and C++ only, by their exact suffixes, nothing excluded; other languages find nothing."""
    some = [x.strip() for x in languages.split(",") if x.strip() in ("python", "c", "cpp")]
    return discover(spark, root, some, exclude=False) if some else spark.createDataFrame([], FILES)


def decoded(rows: DataFrame) -> DataFrame:
    """Adds ext, source and content_hash to (file_path, content)."""
    return rows.select("file_path", extension("file_path").alias("ext"), F.make_valid_utf8(F.col("content").cast("string")).alias("source"), F.sha2("content", 256).alias("content_hash"))


def with_text(files: DataFrame) -> DataFrame:
    """Files that have something in them."""
    return files.where(F.regexp_replace("source", r"\s+", "") != "")


def unpack(content: bytes, path: str) -> list[tuple[str, bytes]]:
    """Members of a zip or tar archive without hidden ones and resource forks; another file is itself."""
    def wanted(name: str) -> bool:
        parts = name.split("/")
        return not name.endswith("/") and "__MACOSX" not in parts and not any(p.startswith(".") for p in parts if p)

    low = path.lower()
    if low.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return [(n, z.read(n)) for n in z.namelist() if wanted(n)]
    if low.endswith((".tar", ".tar.gz", ".tgz", ".tar.bz2", ".gz", ".bz2")):
        try:
            with tarfile.open(fileobj=io.BytesIO(content)) as t:
                return [(m.name, t.extractfile(m).read()) for m in t.getmembers() if m.isfile() and wanted(m.name)]
        except tarfile.ReadError:
            if low.endswith((".tar", ".tar.gz", ".tgz", ".tar.bz2")):
                raise
        one = gzip.decompress(content) if low.endswith(".gz") else bz2.decompress(content)  # a single compressed file
        return [(path.rsplit("/", 1)[-1].rsplit(".", 1)[0], one)]
    return [(path.rsplit("/", 1)[-1], content)]


def archives(spark: SparkSession, path: str) -> DataFrame:
    """files of all archives (and plain files) under a path: archive/member; archives that can't be opened give no rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, c in zip(b["path"], b["content"], strict=True):
                try:
                    rows += [(f"{p.rsplit('/', 1)[-1]}/{n}", d) for n, d in unpack(c, p)]
                except (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError):
                    continue
            yield pd.DataFrame(rows, columns=["file_path", "content"])

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return decoded(raw.mapInPandas(run, "file_path string, content binary"))


def table_or_empty(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A stored Parquet table, or an empty one of the schema if there is none yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def privacy_rules(spec: dict | str | None, roots: list[str] = ()) -> PrivacyRules | None:
    """Rules from a dict, a JSON file, or found: PRIVACY_CONFIG_PATH first, then .privacy_config.json in a root."""
    if spec is None:
        paths = [os.environ.get("PRIVACY_CONFIG_PATH", ""), *(os.path.join(r, ".privacy_config.json") for r in roots)]
        spec = next((p for p in paths if p and os.path.isfile(p)), None)
        if spec is None:
            return None
    if isinstance(spec, str):
        with open(spec, encoding="utf-8") as f:
            spec = json.load(f)
    spec = spec.get("privacy", spec)
    names = ("exact_paths", "directories", "patterns", "extensions")
    return PrivacyRules(**{n: tuple(spec.get(n) or ()) for n in names}, enabled=bool(spec.get("enabled", True)))


def unit_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of the shape {files: [{path, units: [{name, type, start_line, end_line}]}]}."""
    unit = "struct<name:string,type:string,start_line:int,end_line:int>"
    raw = spark.read.schema(f"files array<struct<path:string,units:array<{unit}>>>").option("multiLine", True).json(path)
    rows = raw.select(F.explode("files").alias("f")).select(F.col("f.path").alias("file_path"), F.posexplode("f.units").alias("pos", "u"))
    return rows.select(F.concat_ws("#", "file_path", "pos").alias("label_id"), "file_path", F.col("u.name").alias("name"), F.col("u.type").alias("kind"), F.col("u.start_line").alias("line_start"), F.col("u.end_line").alias("line_end"))


def pair_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels with predictions: a list, or {labels: [...]}; predicted stands before best_match."""
    one = "struct<type:string,name:string,line_start:int,line_end:int>"
    item = f"struct<file:string,name:string,type:string,line_start:int,line_end:int,predicted:{one},best_match:{one}>"
    text = spark.read.text(path, wholetext=True)
    both = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{item}>")).otherwise(F.from_json("value", f"struct<labels:array<{item}>>")["labels"])
    rows = text.select(F.explode(both).alias("x"))
    p = F.coalesce("x.predicted", "x.best_match")
    return rows.select(F.col("x.file").alias("file_path"), F.col("x.name").alias("name"), F.col("x.type").alias("kind"), F.col("x.line_start").alias("line_start"), F.col("x.line_end").alias("line_end"), p["name"].alias("p_name"), p["type"].alias("p_kind"), p["line_start"].alias("p_start"), p["line_end"].alias("p_end"))


def graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a node-link JSON file; one that is missing or broken is an empty graph. seq ascends in order of the document.

    Documents that sinks.write_document laid out with an element a line are read by lines, in as many tasks as their bytes need; any other is parsed as a whole.
    """
    node = "id string, project_id string, file_path string, entity_type string, name string, line_start int, line_end int"
    edge = "source string, target string, relation_type string"
    head, tail = f"{DOCUMENT_HEAD}\n".encode(), f"\n{DOCUMENT_TAIL}\n".encode()
    found = ends(spark, path, len(head), len(tail))
    if found and all(a == head and e == tail for _, a, e in found):
        lines = spark.read.text([f for f, _, _ in found]).select("value", F.monotonically_increasing_id().alias("seq")).where(F.col("value") != DOCUMENT_HEAD)
        of = lambda start, schema: lines.where(F.col("value").rlike(start)).select(F.from_json(F.ltrim("value", F.lit(", ")), schema).alias("x"), "seq")
        nodes = of(r"^,?\{", node).where("x.id is not null").select("x.*", "seq")
        edges = of(r"^,? \{", edge).where("x.source is not null and x.target is not null")
        return nodes, edges.select(F.col("x.source").alias("src"), F.col("x.target").alias("dst"), F.col("x.relation_type").alias("relation_type"), "seq")
    schema = f"nodes array<struct<{node.replace(' ', ':')}>>, edges array<struct<{edge.replace(' ', ':')}>>, links array<struct<{edge.replace(' ', ':')}>>".replace(",:", ", ")
    try:
        raw = spark.read.schema(schema).option("multiLine", True).json(path)
        raw.limit(1).count()
    except Exception:
        raw = spark.createDataFrame([], schema)
    nodes = raw.select(F.posexplode("nodes").alias("seq", "n")).select("n.*", F.col("seq").cast("long").alias("seq"))
    edges = raw.select(F.posexplode(F.coalesce("edges", "links")).alias("seq", "e")).select(F.col("e.source").alias("src"), F.col("e.target").alias("dst"), F.col("e.relation_type").alias("relation_type"), F.col("seq").cast("long").alias("seq"))
    return nodes.where("id is not null"), edges.where("src is not null and dst is not null")
