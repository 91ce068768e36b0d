"""Evaluation of chunk boundaries against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Label types, and the chunk types that count as equal to them
COMPATIBLE = {
    "class_template": ("class", "function", "struct"),
    "function_template": ("class", "function", "struct"),
    "struct_template": ("class", "function", "struct"),
    "struct": ("class",),
}
#: Types of chunks by the names that labels use
NORMAL = {"function": "function", "class": "class", "struct": "struct", "module": "namespace", "semantic": "other"}


def types_match(label: Column, chunk: Column) -> Column:
    out = label == chunk
    for kind, others in COMPATIBLE.items():
        out = out | ((label == kind) & chunk.isin(*others))
    return out


def normal_type(kind: Column) -> Column:
    out = kind
    for k, v in NORMAL.items():
        out = F.when(kind == k, F.lit(v)).otherwise(out)
    return out


def judge_labels(labels: DataFrame, chunks: DataFrame, bucket: int = 256) -> DataFrame:
    """Outcome of each label (label_id, file_path, name, kind, line_start, line_end).

    Matches are looked for by name, type and range, else by name and type, else by name; a label without any is contained_no_name if
    a chunk of its file holds its range, else missed. A match that isn't exact is split if it isn't alone or several chunks hold the label, else inexact.

    Chunks of a file meet its labels twice, by name, and by range within blocks of ``bucket`` lines; both sides are pre-aggregated to counts for each label.
    """
    c = chunks.select("file_path", F.col("name").alias("c_name"), F.col("chunk_type").alias("c_kind"), F.col("line_start").alias("c_start"), F.col("line_end").alias("c_end"))
    named = labels.join(c.withColumnRenamed("c_name", "name"), ["file_path", "name"])
    same = (F.col("line_start") == F.col("c_start")) & (F.col("line_end") == F.col("c_end"))
    typed = types_match(F.col("kind"), F.col("c_kind"))
    counts = named.groupBy("label_id").agg(F.count_if(typed & same).alias("n1"), F.count_if(typed).alias("n2"), F.count("*").alias("n3"), F.count_if(same).alias("exact_name"))
    block = lambda x: F.floor(F.col(x) / bucket)
    spread = c.withColumn("_cg_b", F.explode(F.sequence(block("c_start"), F.greatest(block("c_start"), block("c_end")))))
    near = labels.select("label_id", "file_path", "line_start", "line_end", block("line_start").alias("_cg_b")).join(spread, ["file_path", "_cg_b"])
    holding = near.where((F.col("c_start") <= F.col("line_start")) & (F.col("c_end") >= F.col("line_end"))).groupBy("label_id").agg(F.count("*").alias("n_holding"))
    out = labels.join(counts, "label_id", "left").join(holding, "label_id", "left").fillna(0, ["n1", "n2", "n3", "exact_name", "n_holding"])
    matching = F.when(F.col("n1") > 0, F.col("n1")).when(F.col("n2") > 0, F.col("n2")).otherwise(F.col("n3"))
    exact = F.when(F.col("n1") > 0, F.lit(True)).when(F.col("n2") > 0, F.lit(False)).otherwise(F.col("exact_name") > 0)
    outcome = (
        F.when((matching > 0) & exact, "exact").when((matching > 1) | (matching > 0) & (F.col("n_holding") > 1), "split").when(matching > 0, "inexact").when(F.col("n_holding") > 0, "contained_no_name").otherwise("missed")
    )
    return out.select("label_id", "file_path", "name", "kind", outcome.alias("outcome"))


def boundary_rates(outcomes: DataFrame) -> DataFrame:
    """One row: total, detected, exact, split, missed and their rates in percent."""
    n = lambda *xs: F.count_if(F.col("outcome").isin(*xs))
    out = outcomes.agg(F.count("*").alias("total"), n("exact", "split", "inexact", "contained_no_name").alias("detected"), n("exact").alias("exact_match"), n("split").alias("split"), n("missed").alias("missed"))
    rate = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total") * 100).otherwise(F.lit(0.0))
    return out.withColumns({"detect_rate": rate("detected"), "exact_rate": rate("exact_match"), "split_rate": rate("split"), "missed_rate": rate("missed")})


def mismatches(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("outcome").isin("split", "contained_no_name", "missed"))


def compare_rows(pairs: DataFrame) -> DataFrame:
    """Row-wise difference of expected (kind, name, line_start, line_end) and predicted (p_kind, p_name, p_start, p_end); null predictions match nothing."""
    some = F.col("p_name").isNotNull() | F.col("p_kind").isNotNull() | F.col("p_start").isNotNull()
    kind, name = F.coalesce(some & F.col("kind").eqNullSafe(F.col("p_kind")), F.lit(False)), F.coalesce(some & F.col("name").eqNullSafe(F.col("p_name")), F.lit(False))
    far = lambda a, b: F.when(F.coalesce(F.col(b), F.lit(0)) != 0, F.abs(F.col(a) - F.col(b)))
    exact = kind & name & F.col("line_start").eqNullSafe(F.col("p_start")) & F.col("line_end").eqNullSafe(F.col("p_end"))
    return pairs.withColumns({"type_match": kind, "name_match": name, "start_diff": far("line_start", "p_start"), "end_diff": far("line_end", "p_end"), "exact_match": exact})


def accuracy(compared: DataFrame) -> DataFrame:
    matched = F.count_if("exact_match")
    return compared.agg(F.count("*").alias("total"), matched.alias("matched"), F.when(F.count("*") > 0, matched / F.count("*")).otherwise(F.lit(0.0)).alias("accuracy"))
