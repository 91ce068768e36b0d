"""Queries of the vector operators over the embeddings table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusgraph.operators import retrieval as R
from corpusgraph.operators import vector as V
from corpusgraph.plans import derived as D


def _vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _query(spark, sf_dir):
    """The vector of vec_id 0, as a question's vector would come from an embedder; the id is pushed down."""
    return _vectors(spark, sf_dir).where("vec_id = 0").select("embedding").first().embedding


def _hits(spark, sf_dir):
    return V.scored(_vectors(spark, sf_dir), _query(spark, sf_dir))


def knn_topk(spark, sf_dir):
    return V.top_k(_hits(spark, sf_dir).select("vec_id", "score"), 5, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


def knn_filtered_topk(spark, sf_dir):
    return V.top_k(_hits(spark, sf_dir).where("label = 3").select("vec_id", "label", "score"), 5, "vec_id").select("vec_id", "label", F.round("score", 6).alias("score"))


_D = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"
_HITS = f"WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), hits AS (SELECT vec_id, label, embedding, {_D.format(a='embedding', b='q')} AS score FROM embeddings, q) "



def knn_topk_per_partition(spark, sf_dir):
    return V.top_k_per(_hits(spark, sf_dir).select("vec_id", "label", "score"), "label", 3, "vec_id").select("label", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def knn_multi_collection(spark, sf_dir):
    """Three collections searched at once; one of them doesn't exist and gives nothing."""
    hits = _hits(spark, sf_dir).where(F.col("label").isin(2, 5, 77)).select("vec_id", F.concat(F.lit("c"), "label").alias("collection"), "score")
    return V.top_k_per(hits, "collection", 4, "vec_id").select("collection", "vec_id", F.round("score", 6).alias("score"))


def _summaries(spark, sf_dir):
    means = V.vector_mean(_vectors(spark, sf_dir), "label")
    return V.scored(means, _query(spark, sf_dir), "mean").select(F.col("label").alias("project_id"), "score")


def two_stage_retrieval(spark, sf_dir):
    chunks = _hits(spark, sf_dir).select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("project_id"), "score")
    return R.two_stage(_summaries(spark, sf_dir), chunks).select("chunk_id", "project_id", F.round("score", 6).alias("score"))


def _two_queries(spark, sf_dir):
    """Hits of two queries, one list after the other."""
    q = _vectors(spark, sf_dir).where("vec_id in (0, 1)").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    return _vectors(spark, sf_dir).crossJoin(F.broadcast(q)).select(F.col("vec_id").alias("chunk_id"), V.squared_l2("embedding", "q").alias("score"))


def hits_dedup_keep_best(spark, sf_dir):
    return R.merge_hits(_two_queries(spark, sf_dir), 10).select("chunk_id", F.round("score", 6).alias("score"))


def fallback_union(spark, sf_dir):
    hits = _hits(spark, sf_dir).select("vec_id", "label", "score")
    out = R.with_fallback(hits.where("label = 99"), hits.where("label in (1, 4)"))
    return V.top_k(out, 5, "vec_id").select("vec_id", "label", F.round("score", 6).alias("score"))


_WORDS = ["the", "and", "of", "die", "que"]


def rerank_topk(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text", (F.col("n_chars") % 97).cast("double").alias("score"))
    return R.rerank(docs, R.lexical_overlap("text", _WORDS), 5, 8).select("chunk_id", "score", F.round("relevance", 6).alias("relevance"))


def rerank_model(spark, sf_dir):
    """The same with a function over batches of texts in the place of a model."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text", (F.col("n_chars") % 97).cast("double").alias("score"))
    return R.rerank(docs, lambda s: s.str.count("a").astype("float64"), 5, 8).select("chunk_id", "score", "relevance")


def vector_mean(spark, sf_dir):
    means = V.vector_mean(_vectors(spark, sf_dir), "label")
    return means.select("label", F.posexplode("mean").alias("pos", "m")).select("label", "pos", F.round("m", 6).alias("m"))


def pairwise_cosine(spark, sf_dir):
    """All pairs of label means, with the nearest and the farthest pair marked."""
    m = V.vector_mean(_vectors(spark, sf_dir), "label")
    a, b = m.select(F.col("label").alias("a"), F.col("mean").alias("x")), m.select(F.col("label").alias("b"), F.col("mean").alias("y"))
    pairs = a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.round(V.cosine("x", "y"), 6).alias("cosine"), F.round(F.sqrt(V.squared_l2("x", "y")), 6).alias("distance"))
    ends = pairs.agg(F.max("cosine").alias("most"), F.min("cosine").alias("least"))
    return pairs.join(F.broadcast(ends)).select("a", "b", "cosine", "distance", F.when(F.col("cosine") == F.col("most"), "nearest").when(F.col("cosine") == F.col("least"), "farthest").otherwise("").alias("mark"))


def hybrid_retrieval(spark, sf_dir):
    """Nearest vectors stand for parts; chunks of parts and suppliers near them in the graph follow."""
    hits = V.top_k(_hits(spark, sf_dir).select("vec_id", "score"), 5, "vec_id")
    hits = hits.select(F.concat(F.lit("part:"), "vec_id").alias("chunk_id"), F.lit("").alias("name"), F.lit("").alias("file_path"), F.row_number().over(Window.orderBy("score", "vec_id")).alias("rank"))
    nodes = D.nodes(spark, sf_dir).withColumns({"chunk_id": F.when(F.col("entity_type").isin("part", "supplier"), F.col("id")).otherwise(F.lit("")), "file_path": F.lit("-")})
    return R.hybrid(hits, nodes, D.edges(spark, sf_dir, True), types=["CALLS"]).select("chunk_id", "origin", F.col("rank").cast("long").alias("rank"))


QUERIES = {f.__name__: f for f in (knn_topk, knn_filtered_topk, knn_topk_per_partition, knn_multi_collection, two_stage_retrieval, hits_dedup_keep_best, fallback_union, rerank_topk, rerank_model, vector_mean, pairwise_cosine, hybrid_retrieval)}
_MEANS = "means AS (SELECT label, list(m ORDER BY pos) AS mean FROM (SELECT label, pos, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings) GROUP BY ALL) GROUP BY label)"
_WORD_LIST = "[" + ", ".join(f"'{w}'" for w in _WORDS) + "]"
ORACLE_SQL = {
    "knn_topk": _HITS + "SELECT vec_id, round(score, 6) AS score FROM (SELECT * FROM hits ORDER BY score, vec_id LIMIT 5)",
    "knn_filtered_topk": _HITS + "SELECT vec_id, label, round(score, 6) AS score FROM (SELECT * FROM hits WHERE label = 3 ORDER BY score, vec_id LIMIT 5)",
    "knn_topk_per_partition": _HITS + "SELECT label, vec_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score, vec_id) AS rank FROM hits) WHERE rank <= 3",
    "knn_multi_collection": _HITS + "SELECT 'c' || label AS collection, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score, vec_id) AS rank FROM hits WHERE label IN (2, 5, 77)) WHERE rank <= 4",
    "two_stage_retrieval": _HITS + f", {_MEANS}, best AS (SELECT label FROM means, q ORDER BY {_D.format(a='mean', b='q')}, label LIMIT 3), chosen AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score, vec_id) AS rank FROM hits WHERE label IN (SELECT label FROM best)) SELECT vec_id AS chunk_id, label AS project_id, round(score, 6) AS score FROM (SELECT * FROM chosen WHERE rank <= 5 ORDER BY score, vec_id LIMIT 5)",
    "hits_dedup_keep_best": f"WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id IN (0, 1)) SELECT chunk_id, round(score, 6) AS score FROM (SELECT vec_id AS chunk_id, min({_D.format(a='embedding', b='q')}) AS score FROM embeddings, q GROUP BY vec_id ORDER BY score, chunk_id LIMIT 10)",
    "fallback_union": _HITS + "SELECT vec_id, label, round(score, 6) AS score FROM (SELECT * FROM hits WHERE label IN (1, 4) ORDER BY score, vec_id LIMIT 5)",
    "rerank_topk": f"WITH c AS (SELECT doc_id AS chunk_id, text, (n_chars % 97)::DOUBLE AS score FROM documents ORDER BY score, chunk_id LIMIT 40) SELECT chunk_id, score, round(relevance, 6) AS relevance FROM (SELECT *, len(list_intersect(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), {_WORD_LIST})) / 5.0 AS relevance FROM c ORDER BY relevance DESC, score, chunk_id LIMIT 5)",
    "rerank_model": "WITH c AS (SELECT doc_id AS chunk_id, text, (n_chars % 97)::DOUBLE AS score FROM documents ORDER BY score, chunk_id LIMIT 40) SELECT chunk_id, score, (length(text) - length(replace(text, 'a', '')))::DOUBLE AS relevance FROM c ORDER BY relevance DESC, score, chunk_id LIMIT 5",
    "vector_mean": f"WITH {_MEANS} SELECT label, (unnest(range(1, len(mean) + 1)) - 1)::INTEGER AS pos, round(unnest(mean), 6) AS m FROM means",
    "pairwise_cosine": f"WITH {_MEANS}, p AS (SELECT x.label AS a, y.label AS b, round(list_cosine_similarity(x.mean, y.mean), 6) AS cosine, round(list_distance(x.mean, y.mean), 6) AS distance FROM means x JOIN means y ON x.label < y.label) SELECT *, CASE WHEN cosine = (SELECT max(cosine) FROM p) THEN 'nearest' WHEN cosine = (SELECT min(cosine) FROM p) THEN 'farthest' ELSE '' END AS mark FROM p",
    "hybrid_retrieval": f"""{_HITS.replace('WITH', 'WITH RECURSIVE', 1)}, edges AS ({D.EDGES_SQL}), s AS (SELECT 'part:' || vec_id AS id, row_number() OVER (ORDER BY score, vec_id) AS rank FROM hits ORDER BY score, vec_id LIMIT 5),
e AS (SELECT src AS a, dst AS b FROM edges WHERE relation_type = 'CALLS' UNION ALL SELECT dst, src FROM edges WHERE relation_type = 'CALLS'), seen AS (SELECT id FROM s WHERE id IN (SELECT 'part:' || p_partkey FROM part)),
r1 AS (SELECT DISTINCT b AS id FROM e JOIN seen ON a = id WHERE b NOT IN (SELECT id FROM seen)), r2 AS (SELECT DISTINCT b AS id FROM e JOIN r1 ON a = r1.id WHERE b NOT IN (SELECT id FROM seen) AND b NOT IN (SELECT id FROM r1)),
near AS (SELECT id, 1 AS depth FROM r1 UNION ALL SELECT id, 2 FROM r2), more AS (SELECT id, row_number() OVER (ORDER BY depth, id) AS k FROM near WHERE id LIKE 'part:%' OR id LIKE 'supplier:%')
SELECT id AS chunk_id, 'vector' AS origin, rank FROM s UNION ALL SELECT id, 'graph', 1000000 + k FROM more WHERE k <= 10""",
}
