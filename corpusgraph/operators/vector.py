"""Vector search as plain DataFrame expressions: squared Euclidean distance, filtered top-k, pairwise cosine, means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def squared_l2(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance of two float arrays, summed in doubles; shorter arrays are padded with nulls (null result)."""
    step = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(step, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity, zero if either vector has zero length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def scored(vectors: DataFrame, query: list[float], column: str = "embedding") -> DataFrame:
    """vectors with their distance to a constant query vector as score (lower is better)."""
    return vectors.withColumn("score", squared_l2(F.col(column), F.array(*(F.lit(float(x)) for x in query))))


def top_k(hits: DataFrame, k: int = 5, key: str = "chunk_id") -> DataFrame:
    """The k hits of lowest score, ties to the smaller key: one TakeOrderedAndProject, no global sort."""
    return hits.orderBy("score", key).limit(k)


def top_k_per(hits: DataFrame, group: str, k: int = 5, key: str = "chunk_id") -> DataFrame:
    """The k best hits of each group with their rank; Spark prunes each partition to k rows a group before the shuffle."""
    w = Window.partitionBy(group).orderBy("score", key)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def keep_first(hits: DataFrame, key: str, order: list[str | Column]) -> DataFrame:
    """One row a key: the first in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return hits.withColumn("_cg_rn", F.row_number().over(w)).where("_cg_rn = 1").drop("_cg_rn")


def vector_mean(vectors: DataFrame, group: str, column: str = "embedding") -> DataFrame:
    """Element-wise unweighted mean of each group's vectors; positions are averaged with map-side partial sums."""
    parts = vectors.select(group, F.posexplode(column).alias("pos", "x")).groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))
