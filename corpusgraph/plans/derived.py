"""Tables derived from the star schema, for queries that need a graph or code chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


_NODES = (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"), ("orders", "o_orderkey", "o_orderpriority"))
_KIND = {"orders": "order"}


def nodes(spark, sf_dir: str) -> DataFrame:
    parts = []
    for t, key, name in _NODES:
        kind = _KIND.get(t, t)
        parts.append(table(spark, sf_dir, t).select(_id(kind, key).alias("id"), F.lit(kind).alias("entity_type"), F.col(name).alias("name"), F.col(key).cast("long").alias("seq")))
    return reduce(DataFrame.unionByName, parts)


def edges(spark, sf_dir: str, repeated: bool = False) -> DataFrame:
    """The derived graph's edges; repeated: with those that lineitem holds more than once, which a traversal doesn't mind, so that each of its levels is only a scan."""
    t = lambda n: table(spark, sf_dir, n)
    e = lambda df, a, b, kind: df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("relation_type"))
    line = t("lineitem")
    some = lambda a, b: line.select(a, b) if repeated else line.select(a, b).distinct()  # noqa: E731  (on the keys, before they become strings)
    parts = [
        e(some("l_orderkey", "l_partkey"), _id("order", "l_orderkey"), _id("part", "l_partkey"), "CALLS"),
        e(some("l_partkey", "l_suppkey"), _id("part", "l_partkey"), _id("supplier", "l_suppkey"), "CALLS"),
        e(t("orders"), _id("order", "o_orderkey"), _id("customer", "o_custkey"), "REFERENCES"),
        e(t("supplier"), _id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), "INHERITS_FROM"),
        e(t("customer"), _id("customer", "c_custkey"), _id("nation", "c_nationkey"), "INHERITS_FROM"),
        e(t("nation"), _id("nation", "n_nationkey"), _id("region", "n_regionkey"), "CONTAINS"),
        e(t("nation"), _id("nation", "n_nationkey"), F.concat(F.lit("nation:"), ((F.col("n_nationkey") + 1) % 25).cast("string")), "INCLUDES"),
    ]
    return reduce(DataFrame.unionByName, parts)


NODES_SQL = " UNION ALL ".join(f"SELECT '{_KIND.get(t, t)}:' || {key} AS id, '{_KIND.get(t, t)}' AS entity_type, {name} AS name, {key}::BIGINT AS seq FROM {t}" for t, key, name in _NODES)
EDGES_SQL = """
SELECT DISTINCT 'order:' || l_orderkey AS src, 'part:' || l_partkey AS dst, 'CALLS' AS relation_type FROM lineitem
UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'CALLS' FROM lineitem
UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'REFERENCES' FROM orders
UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'INHERITS_FROM' FROM supplier
UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'INHERITS_FROM' FROM customer
UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'CONTAINS' FROM nation
UNION ALL SELECT 'nation:' || n_nationkey, 'nation:' || ((n_nationkey + 1) % 25), 'INCLUDES' FROM nation
"""
