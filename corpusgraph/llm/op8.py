"""Query of operator 8."""

from corpusgraph.llm.common import read_table
from corpusgraph.llm.simhash import near_duplicate_classes


def op8_simhash_near_dedup(spark, sf_dir):
    return near_duplicate_classes(read_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


QUERIES = {"op8_simhash_near_dedup": op8_simhash_near_dedup}
ORACLE_SQL: dict[str, str] = {}
