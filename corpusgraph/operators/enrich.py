"""Enrichment of chunks: project columns, sanitized documents, summaries with and without a language model, embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.functions import text as T
from corpusgraph.operators.chunking import char_windows
from corpusgraph.operators.rules import PrivacyRules, is_private, sensitive_hits

Complete = Callable[[str], str]
SNIPPET = 2000
DIMENSIONS = 384


def annotate(chunks: DataFrame, project_id: str, project_name: str, project_root: str, document_kind: str | None = None) -> DataFrame:
    """Adds project columns and the language family; columns of earlier steps keep their values, missing ones get defaults."""
    have = set(chunks.columns)
    keep = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in have else F.lit(d)
    kind = F.lit(document_kind) if document_kind else F.when(F.col("language").isin("markdown", "docx"), "doc").otherwise("code")
    return chunks.withColumns({
        "project_id": F.lit(project_id), "project_name": F.lit(project_name), "project_root": F.lit(project_root),
        "document_kind": F.coalesce(F.col("document_kind"), kind) if "document_kind" in have else kind,
        "source_language_family": T.language_family("language"), "sanitized": keep("sanitized", False), "declaration": keep("declaration", ""),
        "semantic_summary": keep("semantic_summary", ""), "is_private": keep("is_private", False), "privacy_summary": keep("privacy_summary", ""),
    })


def ask(rows: DataFrame, prompt: Column, fallback: Column, complete: Complete | None, out: str) -> DataFrame:
    """rows with the model's answer to each prompt as ``out``: the fallback where the model fails or answers nothing. complete must pickle."""
    if complete is None:
        return rows.withColumn(out, fallback)
    base = rows.drop(out).withColumns({"_cg_prompt": prompt, "_cg_fallback": fallback})
    columns = [c for c in base.columns if not c.startswith("_cg_")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers = []
            for p, f in zip(b["_cg_prompt"], b["_cg_fallback"], strict=True):
                try:
                    answers.append(str(complete(p)).strip() or f)
                except Exception:
                    answers.append(f)
            yield b[columns].assign(**{out: answers})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name in columns) + f", `{out}` string"
    return base.mapInPandas(run, schema)


def with_behavior(chunks: DataFrame, complete: Complete | None = None) -> DataFrame:
    """declaration and semantic_summary of each chunk."""
    rows = chunks.withColumn("declaration", T.declaration("text", "language", "chunk_type", "name"))
    prompt = F.concat(F.lit("Describe what this code does in plain words, without code, literals or secrets.\nDeclaration: "), "declaration", F.lit("\nLanguage: "), "language", F.lit("\n"), F.substring("text", 1, SNIPPET))
    args = ("name", "chunk_type", "language", "line_start", "line_end")
    return ask(rows, prompt, T.behavior_summary(*args) if complete is None else T.behavior_fallback(*args), complete, "semantic_summary")


def sanitize(chunks: DataFrame, project_name: str, project_root: str, complete: Complete | None = None) -> DataFrame:
    """C and C++ chunks get the nine-line document in the place of their code; sensitive_hits names the rules that it breaks (empty: clean)."""
    rows = with_behavior(chunks, complete)
    doc = T.sanitized_document(F.lit(project_name), F.lit(project_root), "file_path", "language", "chunk_type", "name", "line_start", "line_end", "declaration", "semantic_summary")
    code = F.col("language").isin("c", "cpp")
    rows = rows.withColumns({"text": F.when(code, doc).otherwise(F.col("text")), "sanitized": code, "document_kind": F.when(code, "sanitized_code").when(F.col("language").isin("markdown", "docx"), "doc").otherwise("code")})
    return rows.withColumn("sensitive_hits", F.when(code, sensitive_hits("text")).otherwise(F.array().cast("array<string>")))


def mark_private(chunks: DataFrame, rules: PrivacyRules | None, complete: Complete | None = None) -> DataFrame:
    """is_private by path, and a summary that may stand in a prompt for each private chunk; all else stays as it is."""
    if rules is None:
        return chunks
    rows = chunks.withColumn("is_private", is_private("file_path", rules))
    prompt = F.concat(F.lit("Describe the purpose of this confidential code without any detail of it.\nFile: "), "file_path", F.lit("\n"), F.substring("text", 1, SNIPPET))
    hidden = ask(rows.where("is_private"), prompt, T.privacy_summary("file_path"), complete, "privacy_summary")
    return hidden.unionByName(rows.where("not is_private"), allowMissingColumns=True)


def project_summaries(chunks: DataFrame, complete: Complete | None = None, order: str = "seq") -> DataFrame:
    """One summary chunk for each project, from its first eight chunks; the window keeps eight rows of a project in each task before the shuffle."""
    w = Window.partitionBy("project_id").orderBy(order)
    first = chunks.select("project_id", "project_name", "project_root", "language", "name", "semantic_summary", F.row_number().over(w).alias("k")).where("k <= 8")
    line = F.concat(F.lit("- "), "language", F.lit(":"), "name", F.lit(" -> "), F.substring(F.when(F.coalesce("semantic_summary", F.lit("")) != "", F.col("semantic_summary")).otherwise(F.col("name")), 1, 140))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("k", c.alias("v")))), lambda s: s["v"])
    per = first.groupBy("project_id", "project_name", "project_root").agg(F.array_join(ordered(line), "\n").alias("sample"), F.array_join(F.slice(ordered(F.col("name")), 1, 3), ", ").alias("names"))
    per = per.join(chunks.groupBy("project_id").agg(F.count("*").cast("string").alias("n")), "project_id")
    #: The sentences that stand for a project without a model, and where it fails
    plain = F.concat(F.lit("Project "), "project_name", F.lit(" focuses on "), "n", F.lit(" indexed documents. Representative symbols include "), "names", F.lit("."))
    failed = F.concat(F.lit("Project "), "project_name", F.lit(" includes "), "n", F.lit(" indexed documents and symbols such as "), "names", F.lit("."))
    prompt = F.concat(F.lit("Summarize this project in at most three sentences, without code.\nProject: "), "project_name", F.lit("\n"), "sample")
    out = ask(per, prompt, plain if complete is None else failed, complete, "text")
    return out.select(F.concat(F.lit("project:"), "project_id", F.lit(":summary")).alias("chunk_id"), "text", F.col("project_root").alias("file_path"), F.lit("project").alias("language"), F.lit("project_summary").alias("chunk_type"), F.col("project_name").alias("name"), F.lit(0).alias("line_start"), F.lit(0).alias("line_end"), "project_id", "project_name", "project_root", F.lit("project_summary").alias("document_kind"))


def hash_embedding(text: Column | str, dimensions: int = DIMENSIONS) -> Column:
    """The deterministic embedding of tests: one value from the text's hash, repeated."""
    x = F.col(text) if isinstance(text, str) else text
    n = F.conv(F.substring(F.sha2(x.cast("binary"), 256), 1, 8), 16, 10).cast("long") % 100
    return F.array_repeat((n / 100).cast("float"), dimensions)


def embed(chunks: DataFrame, encode: Callable[[list[str]], list[list[float]]], max_chars: int | None = None) -> DataFrame:
    """chunks with an embedding column from a batch encoder. With max_chars longer texts are cut into overlapping pieces whose vectors are averaged.

    Empty texts have a null embedding. encode must pickle; it sees the pieces of a batch together.
    """
    pieces = char_windows("text") if max_chars is None else F.when(F.length("text") <= max_chars, F.array("text")).otherwise(char_windows("text"))
    base = chunks.drop("embedding").withColumn("_cg_pieces", F.coalesce(pieces, F.array().cast("array<string>")))
    columns = [c for c in base.columns if c != "_cg_pieces"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            flat = [p for ps in b["_cg_pieces"] for p in ps]
            vectors, at, out = encode(flat) if flat else [], 0, []
            for ps in b["_cg_pieces"]:
                own = vectors[at : at + len(ps)]
                at += len(ps)
                if len({len(v) for v in own}) > 1:
                    raise ValueError("the encoder returned vectors of different lengths")
                out.append([sum(x) / len(own) for x in zip(*own, strict=True)] if own else None)
            yield b[columns].assign(embedding=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name in columns) + ", embedding array<float>"
    return base.mapInPandas(run, schema)
