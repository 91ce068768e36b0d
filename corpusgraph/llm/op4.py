"""Query of operator 4."""

from pyspark.sql import functions as F

from corpusgraph.llm.common import read_table
from corpusgraph.llm.quality import fit, held_out, score


def op4_quality_classifier(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op4_quality_classifier": op4_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
