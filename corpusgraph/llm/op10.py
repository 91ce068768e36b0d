"""Query of operator 10."""

from pyspark.sql import functions as F

from corpusgraph.llm.common import read_table
from corpusgraph.llm.suffix_dedup import deduplicate


def op10_suffix_array_dedup(spark, sf_dir):
    out = deduplicate(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op10_suffix_array_dedup": op10_suffix_array_dedup}
#: Bytes as hexadecimal text, two signs each, so that places of bytes are places of text
ORACLE_SQL = {
    "op10_suffix_array_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS g FROM d, unnest(range(0, len(h) // 2 - 49)) AS r(p)),
least AS (SELECT g, min(doc_id) AS first_id FROM s GROUP BY g HAVING count(DISTINCT doc_id) > 1),
hit AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM s JOIN least USING (g) WHERE first_id < doc_id),
islands AS (SELECT doc_id, p, sum((before IS NULL OR p > before + 50)::INTEGER) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM hit),
spans AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS e FROM islands GROUP BY doc_id, k),
pieces AS (SELECT doc_id, k, e - a AS n, substr(h, 2 * coalesce(lag(e) OVER w, 0) + 1, 2 * (a - coalesce(lag(e) OVER w, 0))) AS kept, CASE WHEN lead(a) OVER w IS NULL THEN substr(h, 2 * e + 1) ELSE '' END AS rest
  FROM spans JOIN d USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
cut AS (SELECT doc_id, sum(n)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(kept || rest, '' ORDER BY k) AS kept FROM pieces GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)
"""
}
