"""Query of operator 6."""

from pyspark.sql import functions as F

from corpusgraph.llm.common import read_table
from corpusgraph.llm.decontam import contamination


def op6_benchmark_decontamination(spark, sf_dir):
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    hit = F.aggregate(F.zip_with("starts", "ends", lambda a, e: e - a), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


QUERIES = {"op6_benchmark_decontamination": op6_benchmark_decontamination}
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
ORACLE_SQL = {
    "op6_benchmark_decontamination": f"""
WITH i AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, k, k + least(len(w), 10) - 1), ' ') AS x FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(k) WHERE len(w) > 0),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
spots AS (SELECT doc_id, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS x FROM d, (SELECT DISTINCT n FROM windows) AS s, unnest(range(1, len(w) - n + 2)) AS r(k)),
hits AS (SELECT doc_id, k, n, item_id FROM spots JOIN windows USING (n, x)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, k, n FROM hits), unnest(range(k, k + n)) AS r(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
}
