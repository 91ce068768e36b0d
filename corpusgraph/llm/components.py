"""Connected components by alternating large-star and small-star rounds over an edge table.

Every round is two aggregations and two joins; nothing is gathered on the driver or in one task. A star's centre may
have any number of leaves: the joins are plain shuffle joins that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import stage_table


def _stars(pairs: DataFrame) -> DataFrame:
    """(u, v) with the least of u and its v's as m."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: (a long, b long), any direction, loops and repeats allowed. Returns (node, root), root the least node of the component; nodes without an edge to another node are not returned. No edges: no rows."""
    now = stage_table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:  # stars only get larger and fewer: rounds grow with the logarithm of the longest chain
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _stars(large)
        small = small.select("v", "m").unionByName(small.select(F.col("u").alias("v"), "m")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        now = stage_table(small, "edges")
        row = now.agg(F.count("*"), F.expr("sum(cast(u as decimal(38,0)))"), F.expr("sum(cast(v as decimal(38,0)))"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(row) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(row)
