"""Relational passes over extracted units: symbol resolution, containment, interval merge, snapshot differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_symbols(nodes: DataFrame, name: str = "name", key: str = "id") -> DataFrame:
    """(name, id) of the names that exactly one id has."""
    return nodes.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(key).alias("symbol_id"), F.max(key).alias("_cg_max")).where(F.col("symbol_id") == F.col("_cg_max")).drop("_cg_max")


def resolve(references: DataFrame, nodes: DataFrame, name: str = "target_name") -> tuple[DataFrame, DataFrame]:
    """(resolved, pending): references whose name is a unique symbol get its symbol_id; the others stay as they are."""
    symbols = unique_symbols(nodes).withColumnRenamed("name", "_cg_name")
    hit = references.join(symbols, F.col(name) == F.col("_cg_name"))
    rest = references.join(symbols, F.col(name) == F.col("_cg_name"), "left_anti")
    return hit.drop("_cg_name"), rest


#: What contains, and what is never contained
CONTAINERS = ("namespace", "class", "struct", "class_template", "struct_template")
NOT_CONTAINED = ("file", "namespace")


def containment(units: DataFrame, bucket: int = 256, outer: Column | None = None, inner: Column | None = None) -> DataFrame:
    """(file_path, outer_id, inner_id) for each pair of a file where the outer's lines hold the inner's (equal ranges count).

    An outer unit is filed under each block of ``bucket`` lines that it covers, an inner one under the block of its first line: the join has an equality
    on file and block, and a file with many units is spread over its blocks.
    """
    outer = F.col("entity_type").isin(*CONTAINERS) if outer is None else outer
    inner = ~F.col("entity_type").isin(*NOT_CONTAINED) if inner is None else inner
    block = lambda c: F.floor(F.col(c) / bucket)
    o = units.where(outer).select("file_path", F.col("id").alias("outer_id"), F.col("line_start").alias("_cg_a"), F.col("line_end").alias("_cg_e"), F.explode(F.sequence(block("line_start"), F.greatest(block("line_start"), block("line_end")))).alias("_cg_b"))
    i = units.where(inner).select("file_path", F.col("id").alias("inner_id"), F.col("line_start").alias("_cg_s"), F.col("line_end").alias("_cg_t"), block("line_start").alias("_cg_b"))
    pairs = o.join(i, ["file_path", "_cg_b"]).where((F.col("_cg_a") <= F.col("_cg_s")) & (F.col("_cg_e") >= F.col("_cg_t")) & (F.col("outer_id") != F.col("inner_id")))
    return pairs.select("file_path", "outer_id", "inner_id")


def drop_contained(units: DataFrame) -> DataFrame:
    """Units without those that a unit of the same file and name holds and starts before: one pass over each (file, name) in order of starts."""
    w = Window.partitionBy("file_path", "name").orderBy("line_start").rangeBetween(Window.unboundedPreceding, -1)
    return units.withColumn("_cg_max", F.max("line_end").over(w)).where(F.col("_cg_max").isNull() | (F.col("_cg_max") < F.col("line_end"))).drop("_cg_max")


def merge_intervals(ranges: DataFrame, *keys: str) -> DataFrame:
    """Overlapping ranges of a key as one; name and kind come from the range that ends last (the first of equals), an empty value from none.

    Islands start where a start lies beyond every end before; a range takes part in the name if its end exceeds all ends before it.
    """
    order = Window.partitionBy(*keys).orderBy("line_start", F.desc("line_end"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = ranges.withColumn("_cg_end", F.max("line_end").over(before))
    rows = rows.withColumn("_cg_new", (F.col("_cg_end").isNull() | (F.col("line_start") > F.col("_cg_end"))).cast("int"))
    rows = rows.withColumn("_cg_island", F.sum("_cg_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    longer = (F.col("_cg_new") == 1) | (F.col("line_end") > F.col("_cg_end"))
    carry = lambda c: F.max_by(c, F.when(longer & ((F.col("_cg_new") == 1) | (F.coalesce(F.col(c), F.lit("")) != "")), F.col("line_end"))).alias(c)
    return rows.groupBy(*keys, "_cg_island").agg(F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"), carry("name"), carry("kind")).drop("_cg_island")


def content_hash(source: Column | str) -> Column:
    return F.sha2((F.col(source) if isinstance(source, str) else source).cast("binary"), 256)


def snapshot_diff(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("project_id", "file_path")) -> DataFrame:
    """(keys, status): added, updated, skipped or removed, from two tables of (keys, content_hash)."""
    a = old.select(*keys, F.col("content_hash").alias("_cg_old"), F.lit(True).alias("_cg_was"))
    b = new.select(*keys, F.col("content_hash").alias("_cg_new"), F.lit(True).alias("_cg_is"))
    both = a.join(b, list(keys), "full_outer")
    status = F.when(F.col("_cg_is").isNull(), "removed").when(F.col("_cg_was").isNull(), "added").when(F.col("_cg_old").eqNullSafe(F.col("_cg_new")), "skipped").otherwise("updated")
    return both.select(*keys, status.alias("status"))


def stale(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("project_id", "file_path")) -> DataFrame:
    """Keys of old that new no longer has."""
    return old.join(new, list(keys), "left_anti").select(*keys)
