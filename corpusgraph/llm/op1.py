"""Query of operator 1."""

from pyspark.sql import functions as F

from corpusgraph.llm.common import read_table
from corpusgraph.llm.toxicity import fit, held_out, score


def op1_toxicity(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLE_SQL: dict[str, str] = {}
