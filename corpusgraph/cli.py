"""Command line: index a folder, query it, look at its code graph.

    python -m corpusgraph.cli index --path SRC --store STORE [--name P] [--languages python,cpp] [--privacy FILE] [--dry-run] [--events]
    python -m corpusgraph.cli query --store STORE "text" [-k 5] [--language cpp] [--kind code] [--rerank] [--hybrid] [--prompt | --answer]
    python -m corpusgraph.cli stats --store STORE
    python -m corpusgraph.cli graph callers|callees|hierarchy|deps|dependents|impact|paths|stats|export --store STORE [--entity X] [--to Y] [--format dot]
    python -m corpusgraph.cli graph watch --path SRC --store STORE [--seconds 5]
"""

from __future__ import annotations

import argparse
import json
import os
import re
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from corpusgraph.functions.text import chunk_id, project_id, token_estimate
from corpusgraph.operators import enrich, graph, retrieval
from corpusgraph.operators.answer import answer
from corpusgraph.operators.relations import snapshot_diff
from corpusgraph.operators.rules import is_private
from corpusgraph.operators.vector import scored
from corpusgraph.sources import code_graph, files, parsers, sinks
from corpusgraph.sources.models import DIALECTS, ChatModel, EmbeddingModel
from corpusgraph.sources.scratch import cut
from corpusgraph.sources.store import Store
from corpusgraph.streaming.watch import POLL_SECONDS


def session() -> SparkSession:
    return SparkSession.builder.appName("corpusgraph").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def dry_run(found: DataFrame) -> DataFrame:
    """Files, lines and tokens by suffix."""
    return found.groupBy("ext").agg(F.count("*").alias("files"), F.sum(F.regexp_count("source", F.lit("\n")) + 1).alias("lines"), F.sum(F.greatest(F.lit(1), token_estimate("source"))).alias("tokens")).orderBy(F.desc("files"), "ext")


@dataclass
class IndexRun:
    """What a run did: files by status, and what it wrote."""

    counts: dict[str, int]  # added, updated, skipped, removed
    files: int = 0
    chunks: int = 0
    private_files: int = 0
    version: int | None = None


def project_of(spark: SparkSession, root: str) -> str:
    return spark.range(1).select(project_id(F.lit(root)).alias("p")).first().p


def _root(path: str) -> str:
    return os.path.abspath(path) if "://" not in path else path


def index(spark: SparkSession, path: str, store: str, name: str | None = None, languages: str = "python,c,cpp,doc", privacy: str | None = None, complete=None, encode=None, options: parsers.ChunkOptions | None = None, progress=None, found: DataFrame | None = None) -> IndexRun:
    """Brings a project's part of a store up to its folder: only files that are new or changed are parsed, asked about and embedded; what removed files left is dead.

    Names are resolved over all files of the project, so nodes and edges are derived anew from the stored records. complete: a language model; encode: a batch
    embedder, else the deterministic one of tests. found: files(file_path, ext, source, content_hash) in the place of a discovery. progress(path, action) is called in the tasks.
    """
    root, where = _root(path), Store(spark, store)
    name = name or root.rstrip("/").rsplit("/", 1)[-1] or "project"
    project = project_of(spark, root)
    found = files.with_text(files.discover(spark, root, files.languages_of(languages))) if found is None else found
    found = cut(found.withColumn("project_id", F.lit(project)), "found")  # the files as they are now: read once
    before = where.live("hashes", project)
    if before is None:
        before = spark.createDataFrame([], "project_id string, file_path string, content_hash string, version long")
    diff = cut(snapshot_diff(before, found), "diff")
    run = IndexRun({r.status: r.n for r in diff.groupBy("status").agg(F.count("*").alias("n")).collect()})
    run.files = sum(n for k, n in run.counts.items() if k in ("added", "updated"))
    if not set(run.counts) - {"skipped"}:
        return run
    version = where.next_version(project)
    changed = found.join(diff.where("status in ('added', 'updated')").select("file_path"), "file_path", "left_semi")
    units = parsers.chunk_files(changed, complete=complete, options=options or parsers.ChunkOptions.from_env(), progress=progress)
    rules = files.privacy_rules(privacy, [root] if "://" not in root else [])
    rows = enrich.mark_private(enrich.sanitize(units.withColumn("seq", F.concat_ws("#", "file_path", F.lpad(F.col("line_start").cast("string"), 9, "0"))), name, root, complete), rules, complete)
    rows = enrich.annotate(rows, project, name, root).where("size(sensitive_hits) = 0").drop("sensitive_hits")
    rows = rows.withColumn("chunk_id", chunk_id("file_path", "language", "chunk_type", "name", "chunk_index"))
    embedded = lambda df: df.withColumn("embedding", enrich.hash_embedding("text")) if encode is None else enrich.embed(df, encode)
    seen = Observation("chunks")
    where.append("chunks", embedded(rows).observe(seen, F.count("*").alias("chunks")).drop("project_id"), project, version)
    run.chunks = seen.get["chunks"]
    code = changed.where(F.col("ext").isin(*files.EXTENSIONS["c"], *files.EXTENSIONS["cpp"]))
    where.append("raw", code_graph.extract_files(code, project), project, version)
    where.append("hashes", changed.select("file_path", "content_hash"), project, version)
    where.bury(before.join(diff.where("status in ('updated', 'removed')").select("file_path"), "file_path", "left_semi"), project, version)
    # derived tables, from what lives after this run
    gone = diff.where("status <> 'skipped'").select("file_path")
    current = lambda table: _current(where, table, project, version, gone)
    nodes, edges, _ = code_graph.resolved(current("raw"), project)
    spans = current("chunks").groupBy("file_path", "line_start", "line_end").agg(F.min("chunk_id").alias("chunk_id"))  # a node's chunk has its lines
    nodes = nodes.drop("project_id", "chunk_id").join(spans, ["file_path", "line_start", "line_end"], "left").withColumn("chunk_id", F.when(F.col("entity_type") == "file", "").otherwise(F.coalesce("chunk_id", F.lit(""))))
    where.append("nodes", nodes, project, version)
    order = F.concat_ws("#", F.when(F.col("relation_type") == "CONTAINS", "1").otherwise("0"), "relation_type")  # of several relations between two nodes containment is the last written
    where.append("edges", graph.upsert_edges(edges.withColumn("seq", order)), project, version)
    where.append("summaries", embedded(enrich.project_summaries(current("chunks"), complete)).drop("project_id"), project, version)
    if rules is not None:
        run.private_files = current("hashes").where(is_private("file_path", rules)).count()
    where.commit(project, version)
    run.version = version
    return run


def _current(where: Store, table: str, project: str, version: int, gone: DataFrame) -> DataFrame:
    """A table of files as it will be when the version is committed."""
    own = where.table(table).where((F.col("project_id") == project) & (F.col("version") == version))
    return where.live(table, project).join(gone, "file_path", "left_anti").unionByName(own, allowMissingColumns=True)


def index_events(spark: SparkSession, path: str, store: str, every: float = 0.5, **options) -> Iterator[dict]:
    """An index run as events: status, progress while files are parsed, then done or error."""
    done = spark.sparkContext.accumulator(0)
    yield {"event": "status", "data": {"stage": "discover", "message": "Looking for files"}}
    try:
        languages = files.languages_of(options.get("languages") or "python,c,cpp,doc")
        total = files.with_text(files.discover(spark, _root(path), languages)).count()
        yield {"event": "progress", "data": {"current": 0, "total": total, "message": f"Found {total} files"}}
        with ThreadPoolExecutor(1) as pool:
            job = pool.submit(index, spark, path, store, progress=lambda p, action: done.add(1), **options)
            last = 0
            while not job.done():
                time.sleep(every)
                if done.value > last:
                    last = min(done.value, total)
                    yield {"event": "progress", "data": {"current": last, "total": total, "message": f"Parsed {last} of {total} files"}}
            run = job.result()
        yield {"event": "done", "data": {"total_files": total, "total_chunks": run.chunks, **run.counts, "message": "Indexing complete"}}
    except Exception as e:
        yield {"event": "error", "data": {"message": str(e)}}


def chunks_of(spark: SparkSession, store: str) -> DataFrame:
    """Chunks of all projects with their collection: rag_index, or project_index for summaries."""
    where = Store(spark, store)
    tables = [x.withColumn("collection", F.lit(c)) for c, t in (("rag_index", "chunks"), ("project_index", "summaries")) if (x := where.live(t)) is not None]
    if not tables:
        raise SystemExit(f"nothing is indexed in {store}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def search(spark: SparkSession, store: str, text: str, k: int = 5, language: str | None = None, kind: str | None = None, chunk_type: str | None = None, rerank: bool = False, encode=None, hybrid: bool = False) -> DataFrame:
    """Two-stage retrieval over a store, with text joined back after the cut; the question is embedded once. hybrid adds chunks that the code graph leads to."""
    if encode is None:
        vector = spark.range(1).select(enrich.hash_embedding(F.lit(text)).alias("v")).first().v
    else:
        vector = encode([text])[0]
    every = chunks_of(spark, store)
    summaries = scored(every.where("collection = 'project_index'"), vector).select("project_id", "score")
    wanted = retrieval.filtered(every.where("collection = 'rag_index'"), language=language, document_kind=kind, chunk_type=chunk_type)
    hits = retrieval.two_stage(summaries, scored(wanted, vector).select("chunk_id", "project_id", "score"), retrieval.RetrievalOptions(top_k=4 * k if rerank else k))
    full = hits.join(wanted.drop("embedding"), ["chunk_id", "project_id"])
    if rerank:
        full = retrieval.rerank(full, retrieval.lexical_overlap("text", re.findall(r"\w+", text.lower())), k)
    if hybrid:
        nodes, edges = stored_graph(spark, store)
        ranked = cut(full.withColumn("rank", F.row_number().over(Window.orderBy("score", "chunk_id"))), "hits")  # k rows
        order = retrieval.hybrid(ranked, nodes, edges)
        return order.join(wanted.drop("embedding"), "chunk_id").join(hits.select("chunk_id", "score"), "chunk_id", "left").orderBy("rank")
    return full.orderBy("score", "chunk_id")


def run_query(spark: SparkSession, store: str, text: str, k: int = 5, complete=None, hybrid: bool = False, **options) -> DataFrame:
    """(query_id, prompt, chunk_tokens, total_tokens, answer): retrieval, plain or with the graph, then prompt, model and leak guard."""
    hits = search(spark, store, text, k, hybrid=hybrid, **options)
    if not hybrid:
        hits = hits.withColumn("rank", F.row_number().over(Window.orderBy("score", "chunk_id")))
    return answer(hits.withColumn("query_id", F.lit("q")), text, complete)


def stored_graph(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all projects."""
    where = Store(spark, store)
    nodes, edges = where.live("nodes"), where.live("edges")
    if nodes is None:
        raise SystemExit(f"nothing is indexed in {store}")
    return nodes, edges


def graph_command(spark: SparkSession, store: str, what: str, entity: str | None = None, depth: int = 3, to: str | None = None, form: str = "dot") -> DataFrame | str:
    nodes, edges = stored_graph(spark, store)
    if what == "stats":
        return graph.stats(nodes, edges)
    if what == "export":
        if form == "html":
            return sinks.html_page(nodes, edges)
        return {"dot": sinks.dot_lines, "gexf": sinks.gexf_lines, "json": sinks.graph_document, "lines": sinks.export_json}[form](nodes, edges)
    if what == "paths":
        ends = [graph.find_node(nodes, x).first() for x in (entity, to)]
        if None in ends:
            raise SystemExit(f"no entity {entity!r} or {to!r}")
        return graph.simple_paths(edges, ends[0].id, ends[1].id, depth).select("hops", F.array_join("path", " -> ").alias("path"))
    first = graph.find_file(nodes, entity) if what in ("deps", "dependents") else graph.find_node(nodes, entity)
    row = first.first()
    if row is None:
        raise SystemExit(f"no entity {entity!r}")
    seeds = graph.ids(spark, row.id)
    if what == "impact":
        file = graph.find_file(nodes, row.file_path).first()
        found = graph.impact(edges, row.id, depth, file.id if file else None)
    else:
        found = {"callers": lambda: graph.callers(edges, seeds, depth), "callees": lambda: graph.callees(edges, seeds, depth), "hierarchy": lambda: graph.class_hierarchy(edges, seeds), "deps": lambda: graph.dependencies(edges, row.id), "dependents": lambda: graph.dependents(edges, row.id)}[what]()
    return found.join(nodes.select("id", "name", "entity_type", "file_path"), "id", "left")


def watch_folder(spark: SparkSession, path: str, store: str, ticks: int | None = None, seconds: float = POLL_SECONDS, **options) -> Iterator[dict[str, int]]:
    """Looks at a folder again and again, at every path in it, and brings the store up to it. Yields the counts of changes of each look."""
    n = 0
    while ticks is None or n < ticks:
        if n:
            time.sleep(seconds)
        found = files.with_text(files.discover(spark, _root(path), exclude=False))
        run = index(spark, path, store, found=found, **options)
        yield {k: v for k, v in run.counts.items() if k != "skipped"}
        n += 1


def _model_arguments(a: argparse.ArgumentParser) -> None:
    """Services that answer and embed; the environment gives defaults. Without an address there is no model, and embeddings are those of tests."""
    env = os.environ.get
    a.add_argument("--llm-url", default=env("LOCAL_LLM_BASE_URL"))
    a.add_argument("--llm-model", default=env("LLM_MODEL", ""))
    a.add_argument("--llm-provider", default=env("LLM_PROVIDER", "auto"), choices=["auto", *DIALECTS])
    a.add_argument("--embedding-url", default=env("EMBEDDING_BASE_URL"))
    a.add_argument("--embedding-model", default=env("EMBEDDING_MODEL", ""))
    a.add_argument("--api-key", default=env("LLM_API_KEY"))


def _models(x: argparse.Namespace) -> tuple[ChatModel | None, EmbeddingModel | None]:
    """Which dialect the service speaks is found once, here, and travels with the model."""
    complete = ChatModel(x.llm_url, x.llm_model, x.api_key, x.llm_provider).detected() if x.llm_url else None
    return complete, EmbeddingModel(x.embedding_url, x.embedding_model, x.api_key) if x.embedding_url else None


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="corpusgraph")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("index")
    a.add_argument("--path", required=True)
    a.add_argument("--store", required=True)
    a.add_argument("--name")
    a.add_argument("--languages", default="python,c,cpp,doc")
    a.add_argument("--privacy")
    a.add_argument("--dry-run", action="store_true")
    a.add_argument("--events", action="store_true", help="print the run's events as JSON lines")
    chunks = parsers.ChunkOptions.from_env()
    a.add_argument("--chunk-lines", type=int, default=chunks.lines)
    a.add_argument("--chunk-overlap", type=float, default=chunks.overlap)
    a.add_argument("--chunk-max-tokens", type=int, default=chunks.max_tokens)
    a.add_argument("--chunk-doc-tokens", type=int, default=chunks.doc_tokens)
    a.add_argument("--chunk-backend", default=chunks.backend, choices=["ast", "llm", "hybrid"])
    a.add_argument("--chunk-llm-chunks", type=int, default=chunks.llm_chunks)
    _model_arguments(a)
    a = sub.add_parser("query")
    a.add_argument("text")
    a.add_argument("--store", required=True)
    a.add_argument("-k", type=int, default=5)
    a.add_argument("--language")
    a.add_argument("--kind")
    a.add_argument("--type")
    a.add_argument("--rerank", action="store_true")
    a.add_argument("--prompt", action="store_true")
    a.add_argument("--answer", action="store_true")
    a.add_argument("--hybrid", action="store_true")
    _model_arguments(a)
    a = sub.add_parser("stats")
    a.add_argument("--store", required=True)
    a = sub.add_parser("graph")
    a.add_argument("what", choices=["callers", "callees", "hierarchy", "deps", "dependents", "impact", "paths", "stats", "export", "watch"])
    a.add_argument("--path")
    a.add_argument("--ticks", type=int, help="watch: how often to look; without it, for ever")
    a.add_argument("--seconds", type=float, default=POLL_SECONDS)
    a.add_argument("--store", required=True)
    a.add_argument("--entity")
    a.add_argument("--to", help="paths: where they end")
    a.add_argument("--depth", type=int, default=3)
    a.add_argument("--format", default="dot", choices=["dot", "gexf", "json", "lines", "html"])
    a.add_argument("--output")
    x = p.parse_args(argv)
    spark = session()
    if x.command == "index":
        if x.dry_run:
            dry_run(files.with_text(files.discover(spark, x.path, files.languages_of(x.languages)))).show(truncate=False)
            return
        complete, encode = _models(x)
        options = parsers.ChunkOptions(x.chunk_lines, x.chunk_overlap, x.chunk_max_tokens, x.chunk_doc_tokens, x.chunk_backend, x.chunk_llm_chunks)
        rest = {"name": x.name, "languages": x.languages, "privacy": x.privacy, "complete": complete, "encode": encode, "options": options}
        if x.events:
            for e in index_events(spark, x.path, x.store, **rest):
                print(json.dumps(e), flush=True)
        else:
            run = index(spark, x.path, x.store, **rest)
            print(", ".join(f"{k} {v}" for k, v in sorted(run.counts.items())), f"files; {run.chunks} chunks written, {run.private_files} private files")
    elif x.command == "query":
        complete, encode = _models(x)
        asked = {"language": "cpp" if x.language == "c" else x.language, "kind": x.kind, "chunk_type": x.type, "rerank": x.rerank, "encode": encode, "hybrid": x.hybrid}
        if x.prompt or x.answer:
            row = run_query(spark, x.store, x.text, x.k, complete, **asked).first()
            print(row.answer if x.answer and row is not None else row.prompt if row is not None else "nothing found")
        else:
            search(spark, x.store, x.text, x.k, **asked).select("score", "file_path", "chunk_type", "name", "line_start", "line_end").show(truncate=False)
    elif x.command == "stats":
        chunks_of(spark, x.store).groupBy("collection", "project_name").agg(F.count("*").alias("chunks")).orderBy("collection", "project_name").show(truncate=False)
        sinks.stored_bytes(spark, x.store).show()
    elif x.what == "watch":
        for counts in watch_folder(spark, x.path, x.store, x.ticks, x.seconds):
            print(", ".join(f"{k} {v}" for k, v in sorted(counts.items())) or "nothing changed")
    else:
        out = graph_command(spark, x.store, x.what, x.entity, x.depth, x.to, x.format)
        if isinstance(out, str):
            if x.output:
                with open(x.output, "w", encoding="utf-8") as f:
                    f.write(out)
            else:
                print(out)
        elif x.what == "export" and x.output:
            (sinks.write_document if x.format == "json" else sinks.write_lines)(out, x.output)
        else:
            out.show(200, truncate=False)


if __name__ == "__main__":
    main()
