"""Query of operator 3."""

from pyspark.sql import functions as F

from corpusgraph.llm.common import read_table
from corpusgraph.llm.licenses import scan


def op3_license_scans(spark, sf_dir):
    return scan(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "license", F.round("coverage", 6).alias("coverage"), "n_matched", "first_word", "end_word", F.array_join("licenses", ",").alias("licenses"))


QUERIES = {"op3_license_scans": op3_license_scans}
ORACLE_SQL: dict[str, str] = {}
