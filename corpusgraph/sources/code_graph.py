"""Entities and references of C++ files; names are resolved afterwards, over all files at once."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.operators.relations import containment, resolve
from corpusgraph.sources.cpp import Reader, Unit
from corpusgraph.sources.ranges import tolerant_json

#: Fixed value: an include line
INCLUDE = r'#\s*include\s+["<]([^">]+)[">]'
_COLUMNS = ["record", "file_path", "entity_type", "name", "line_start", "line_end", "declaration", "src", "relation_type", "target_name", "line", "pos"]
_SCHEMA = "record string, file_path string, entity_type string, name string, line_start int, line_end int, declaration string, src string, relation_type string, target_name string, line int, pos int"


def _entity_id(project: str, path: str, kind: str, name: str) -> str:
    return f"{project}:{path}:{kind}:{name}"


def extract(source: str, path: str, project: str) -> list[tuple]:
    """Rows of entities and of references whose target is a name."""
    base = path.replace("\\", "/").rsplit("/", 1)[-1]
    rows: list[tuple] = [("entity", path, "file", base, 1, 1, "", None, None, None, None, 0)]
    refs: list[tuple] = []

    def add(u: Unit, owner: str | None) -> None:
        if u.template_start >= 0:
            add_one(u, "template", u.name, reader.line(u.template_start))
        if u.kind in ("class", "struct") and not u.has_body or not u.name:
            for c in u.children:
                add(c, owner)
            return
        name = f"{owner}::{u.name}" if owner and u.kind == "function" else u.name
        add_one(u, u.kind, name, u.line_start)
        mine = _entity_id(project, path, u.kind, name)
        for kind, found in (("CALLS", u.calls), ("REFERENCES", u.parameters), ("INHERITS_FROM", u.bases), ("REFERENCES", u.members)):
            seen = set()
            for target, line in found:
                if target not in seen:
                    seen.add(target)
                    refs.append(("reference", path, None, None, None, None, None, mine, kind, target, line, 0))
        for c in u.children:
            add(c, name if u.kind in ("class", "struct") else owner)

    def add_one(u: Unit, kind: str, name: str, first: int) -> None:
        start = u.template_start if kind == "template" else u.start
        rows.append(("entity", path, kind, name, first, u.line_end, source[start : u.end].split("\n")[0][:200], None, None, None, None, 0))

    reader = Reader(source)
    for u in reader.units():
        add(u, None)
    for m in re.finditer(INCLUDE, source):
        refs.append(("include", path, None, None, None, None, None, _entity_id(project, path, "file", base), "INCLUDES", m[1], source.count("\n", 0, m.start()) + 1, 0))
    return [(*r[:-1], k) for k, r in enumerate(rows + refs)]


def extract_files(files: DataFrame, project: str) -> DataFrame:
    """Entities and raw references of files(file_path, source); a file that can't be read gives its file entity and includes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for p, s in zip(b["file_path"], b["source"], strict=True) if p is not None for r in extract(s or "", p, project)]
            yield pd.DataFrame(rows, columns=_COLUMNS).astype({c: "Int64" for c in ("line_start", "line_end", "line", "pos")})

    return files.select("file_path", "source").mapInPandas(run, _SCHEMA)


def build(files: DataFrame, project: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, pending) of all files: references go to the one entity of their name (a member also by its own name, a qualified name by its last
    part), containment follows lines, includes go to the id that their path makes. pending: references without a single target."""
    return resolved(extract_files(files, project), project)


def resolved(raw: DataFrame, project: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same from the records of extract_files, as they are stored."""
    seq = F.concat_ws("#", "file_path", F.lpad(F.col("pos").cast("string"), 8, "0"))
    nodes = raw.where("record = 'entity'").select(F.concat_ws(":", F.lit(project), "file_path", "entity_type", "name").alias("id"), F.lit(project).alias("project_id"), "file_path", "entity_type", "name", "line_start", "line_end", "declaration", F.lit("").alias("chunk_id"), seq.alias("seq"))
    nodes = nodes.groupBy("id").agg(*(F.min_by(c, "seq").alias(c) for c in nodes.columns if c not in ("id", "seq")), F.min("seq").alias("seq"))
    called = nodes.where("entity_type not in ('file', 'template')")
    refs = raw.where("record = 'reference'").select("src", "relation_type", "target_name", "file_path", "line")
    full, rest = resolve(refs, called)
    short = called.withColumn("name", F.element_at(F.split("name", "::"), -1))
    last, pending = resolve(rest.withColumn("_cg_last", F.element_at(F.split("target_name", "::"), -1)), short, "_cg_last")
    hits = full.unionByName(last.drop("_cg_last")).where(F.col("src") != F.col("symbol_id"))
    semantic = hits.select("src", F.col("symbol_id").alias("dst"), "relation_type", "file_path", "line").dropDuplicates(["src", "dst", "relation_type"])
    base = F.element_at(F.split("target_name", "/"), -1)
    includes = raw.where("record = 'include'").select("src", F.concat_ws(":", F.lit(project), "target_name", F.lit("file"), base).alias("dst"), "relation_type", "file_path", "line")
    inside = containment(nodes).select(F.col("outer_id").alias("src"), F.col("inner_id").alias("dst"), F.lit("CONTAINS").alias("relation_type"), "file_path", F.lit(0).alias("line"))
    return nodes, semantic.unionByName(includes).unionByName(inside), pending.drop("_cg_last")


def model_extract(files: DataFrame, project: str, complete: Callable[[str], str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that a language model names in each file as JSON {"entities": [...], "relations": [...]}; answers that don't read give nothing."""
    schema = "record string, file_path string, a string, b string, kind string, line_start int, line_end int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, source in zip(batch["file_path"], batch["source"], strict=True):
                try:
                    answer = tolerant_json(complete(f"Name entities and relations of this file as strict JSON.\nFile: {path}\n{source}"))
                except Exception:
                    answer = None
                if isinstance(answer, dict):
                    rows += [("entity", path, str(e.get("name")), None, str(e.get("type") or ""), int(e.get("line_start") or 0), int(e.get("line_end") or 0)) for e in answer.get("entities") or [] if isinstance(e, dict) and e.get("name")]
                    rows += [("relation", path, str(r.get("source")), str(r.get("target")), str(r.get("type") or ""), 0, 0) for r in answer.get("relations") or [] if isinstance(r, dict) and r.get("source") and r.get("target")]
            yield pd.DataFrame(rows, columns=["record", "file_path", "a", "b", "kind", "line_start", "line_end"])

    raw = files.select("file_path", "source").mapInPandas(run, schema)
    nodes = raw.where("record = 'entity'").select(F.concat_ws(":", F.lit(project), "file_path", "kind", "a").alias("id"), F.lit(project).alias("project_id"), "file_path", F.col("kind").alias("entity_type"), F.col("a").alias("name"), "line_start", "line_end")
    edges = raw.where("record = 'relation'").select(F.col("a").alias("src_name"), F.col("b").alias("dst_name"), F.col("kind").alias("relation_type"), "file_path")
    one, _ = resolve(edges, nodes, "src_name")
    two, _ = resolve(one.withColumnRenamed("symbol_id", "src"), nodes, "dst_name")
    return nodes, two.select("src", F.col("symbol_id").alias("dst"), "relation_type", "file_path")
