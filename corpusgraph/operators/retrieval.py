"""Filtered, two-stage and hybrid retrieval, reranking, prompt assembly.

chunks need chunk_id, embedding and the columns that a filter names. Text is joined back after the cut, so that wide columns never travel with the scores.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.functions.text import token_estimate
from corpusgraph.operators.vector import keep_first, scored, top_k, top_k_per


@dataclass(frozen=True)
class RetrievalOptions:
    """Defaults of the retrieval operators."""

    top_k: int = 5
    project_top_k: int = 3
    rerank_multiplier: int = 4
    hybrid_depth: int = 2
    hybrid_max_expanded: int = 10
    prompt_overhead_tokens: int = 60


def filtered(chunks: DataFrame, **equal: str | None) -> DataFrame:
    """Conjunction of column = value, values of None left out; it reaches the scan as pushed filters."""
    for name, value in equal.items():
        if value is not None:
            chunks = chunks.where(F.col(name) == F.lit(value))
    return chunks


def knn(chunks: DataFrame, query: list[float], k: int = 5, key: str = "chunk_id", **equal: str | None) -> DataFrame:
    """The k nearest chunks under the filters; score is the squared distance."""
    return top_k(scored(filtered(chunks, **equal), query), k, key)


def knn_by_collection(chunks: DataFrame, query: list[float], k: int = 5, group: str = "collection", key: str = "chunk_id") -> DataFrame:
    return top_k_per(scored(chunks, query), group, k, key)


def two_stage(summaries: DataFrame, chunks: DataFrame, options: RetrievalOptions = RetrievalOptions()) -> DataFrame:
    """Best projects by their summaries, best chunks of each, merged.

    summaries: (project_id, score); chunks: (chunk_id, project_id, score). The candidates, project_top_k at most, are a scalar subquery that filters the
    chunks before they are scored further; without any candidate all projects are searched as one.
    """
    best = summaries.groupBy("project_id").agg(F.min("score").alias("score"))
    chosen = best.orderBy("score", "project_id").limit(options.project_top_k).agg(F.collect_list("project_id").alias("ids")).scalar()
    every = F.size(chosen) == 0
    hits = chunks.where(every | F.array_contains(chosen, F.col("project_id")))
    hits = hits.withColumn("_cg_group", F.when(~every, F.col("project_id").cast("string")))
    return merge_hits(top_k_per(hits, "_cg_group", options.top_k).drop("_cg_group", "rank"), options.top_k)


def merge_hits(hits: DataFrame, k: int = 5, key: str = "chunk_id") -> DataFrame:
    """Best row of each chunk, then the k best chunks."""
    return top_k(keep_first(hits, key, ["score"]), k, key)


def with_fallback(primary: DataFrame, legacy: DataFrame) -> DataFrame:
    """legacy only where primary is empty, in one plan: a scalar subquery that looks for one row decides."""
    return primary.unionByName(legacy.where(primary.limit(1).agg(F.count("*")).scalar() == 0))


def result_distribution(hits: DataFrame, *by: str) -> DataFrame:
    """Counts and lowest, highest and mean score by each of the columns, in one pass over grouping sets; the columns of the other sets are null."""
    rows = hits.groupingSets([[c] for c in by], *by)
    return rows.agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"), F.avg("score").alias("mean"))


def rerank(hits: DataFrame, relevance: Column | Callable[[pd.Series], pd.Series], k: int = 5, multiplier: int = 4, text: str = "text", key: str = "chunk_id") -> DataFrame:
    """The first k * multiplier hits by score, ordered anew by relevance (higher is better): a column, or a function over batches of texts."""
    candidates = top_k(hits, max(k, k * multiplier), key)
    if not isinstance(relevance, Column):
        relevance = F.pandas_udf(relevance, "double")(F.col(text))
    return candidates.withColumn("relevance", relevance).orderBy(F.desc("relevance"), "score", key).limit(k)


def lexical_overlap(text: Column | str, words: list[str]) -> Column:
    """Share of the query's words that a text holds: the relevance used without a model."""
    x = F.split(F.lower(F.col(text) if isinstance(text, str) else text), r"[^\p{L}\p{N}]+")
    return F.size(F.array_intersect(x, F.array(*(F.lit(w) for w in sorted(set(words)))))) / F.lit(max(1, len(set(words))))


def chunk_entities(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hits with the graph node of their chunk: by chunk_id, else by name and file; the first node in insertion order."""
    n = nodes.select(F.col("id").alias("node_id"), F.col("chunk_id").alias("_cg_chunk"), F.col("name").alias("_cg_name"), F.col("file_path").alias("_cg_file"), F.col("seq").alias("_cg_seq"))
    direct = hits.join(n.where("_cg_chunk is not null and _cg_chunk <> ''"), F.col("chunk_id") == F.col("_cg_chunk")).withColumn("_cg_how", F.lit(0))
    named = hits.join(n, (F.col("name") == F.col("_cg_name")) & (F.col("file_path") == F.col("_cg_file"))).withColumn("_cg_how", F.lit(1))
    return keep_first(direct.unionByName(named), "chunk_id", ["_cg_how", "_cg_seq"]).drop("_cg_chunk", "_cg_name", "_cg_file", "_cg_how", "_cg_seq")


def hybrid(hits: DataFrame, nodes: DataFrame, edges: DataFrame, options: RetrievalOptions = RetrievalOptions(), types: list[str] | None = None) -> DataFrame:
    """Hits, then the chunks of nodes near theirs in the graph: (chunk_id, rank, origin).

    hits: (chunk_id, name, file_path, rank). Expanded nodes are ordered by depth and id; hybrid_max_expanded of them are taken.
    """
    from corpusgraph.operators.graph import reach
    from corpusgraph.sources.scratch import cut

    seeds = cut(chunk_entities(hits, nodes).select(F.col("node_id").alias("id")), "seeds")  # as many as hits
    near = reach(edges, seeds, options.hybrid_depth, types, direction="both").join(seeds, "id", "left_anti")
    mapped = near.join(nodes.where("chunk_id is not null and chunk_id <> ''").select("id", "chunk_id"), "id")
    more = mapped.orderBy("depth", "id").limit(options.hybrid_max_expanded)
    more = more.withColumn("rank", F.lit(1_000_000) + F.row_number().over(Window.orderBy("depth", "id")))  # a few rows
    both = hits.select("chunk_id", "rank", F.lit("vector").alias("origin")).unionByName(more.select("chunk_id", "rank", F.lit("graph").alias("origin")))
    return keep_first(both, "chunk_id", ["rank"])


#: The prompt's system text and its parts
SYSTEM = (
    "You are a helpful coding assistant. Answer the user's question based only on the provided context. If the context does not contain the answer, say so. "
    "Do not invent code or concepts not present in the context. Never return verbatim source code from the context, including fenced code blocks or long line-by-line snippets; "
    "provide concise summaries instead."
)
PRIVATE_NOTE = "[NOTE: The raw implementation of this high-confidential component is withheld per privacy policy. Only the summary above is provided.]"


def prompt_block() -> Column:
    """One chunk's part of a prompt; private chunks show their summary only."""
    private = F.coalesce(F.col("is_private"), F.lit(False))
    text = F.when(private, F.concat(F.lit("[PRIVACY-SAFE SUMMARY] "), F.coalesce("privacy_summary", F.lit("")), F.lit("\n\n" + PRIVATE_NOTE))).otherwise(F.col("text"))
    project = F.when(F.coalesce(F.col("project_name"), F.lit("")) != "", F.concat(F.lit("Project: "), F.col("project_name"), F.lit("\n"))).otherwise(F.lit(""))
    head = F.concat(project, F.lit("File: "), F.col("file_path"), F.lit(" (lines "), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"), F.lit("), type="), F.col("chunk_type"), F.when(private, F.lit(" [HIGH-CONFIDENTIAL]")).otherwise(F.lit("")))
    return F.concat(head, F.lit("\n```"), F.coalesce("language", F.lit("")), F.lit("\n"), text, F.lit("\n```"))


def build_prompts(hits: DataFrame, question: Column | str, group: str = "query_id", options: RetrievalOptions = RetrievalOptions()) -> DataFrame:
    """(group, prompt, chunk_tokens, total_tokens): blocks in rank order. A group has top_k hits, so it is small."""
    q = F.lit(question) if isinstance(question, str) else question
    blocks = hits.select(group, "rank", prompt_block().alias("block"), q.alias("question"))
    parts = blocks.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda s: s["block"]), "\n---\n").alias("context"), F.first("question").alias("question"))
    prompt = F.concat(F.lit(f"System: {SYSTEM}\n\nContext:\n---\n"), F.col("context"), F.lit("\n---\n\nUser: "), F.col("question"))
    out = parts.select(group, prompt.alias("prompt")).withColumn("chunk_tokens", token_estimate("prompt"))
    return out.withColumn("total_tokens", F.col("chunk_tokens") + options.prompt_overhead_tokens)


def token_reduction(full_tokens: Column | str, rag_tokens: Column | str) -> Column:
    full, rag = (F.col(x) if isinstance(x, str) else x for x in (full_tokens, rag_tokens))
    return F.when(full > 0, (1 - rag / full) * 100).otherwise(F.lit(0.0))
