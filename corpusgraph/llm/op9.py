"""Query of operator 9."""

from corpusgraph.llm.common import read_table
from corpusgraph.llm.topk import top_products


def op9_exact_top_k(spark, sf_dir):
    return top_products(read_table(spark, sf_dir, "embeddings"))


QUERIES = {"op9_exact_top_k": op9_exact_top_k}
ORACLE_SQL = {
    "op9_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p) WHERE rank <= 5
"""
}
