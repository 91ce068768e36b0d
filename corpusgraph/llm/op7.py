"""Query of operator 7."""

from corpusgraph.llm.common import read_table
from corpusgraph.llm.urlfilter import filter_urls


def op7_url_filters(spark, sf_dir):
    return filter_urls(read_table(spark, sf_dir, "pages"))


QUERIES = {"op7_url_filters": op7_url_filters}
ORACLE_SQL = {
    "op7_url_filters": r"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^[^?#]*') AS rest FROM a),
c AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM b
),
r(rule, rule_host, rule_path, verdict) AS (VALUES
  ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'allow'),
  ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
d AS (
  SELECT c.*, (SELECT max_by(rule, length(rule)) FROM r WHERE (c.host = rule_host OR ends_with(c.host, '.' || rule_host)) AND starts_with(c.path, rule_path)) AS rule FROM c
)
SELECT page_id, host, path, d.rule,
  coalesce((SELECT verdict FROM r WHERE r.rule = d.rule), CASE WHEN regexp_matches(host, '(^|[^0-9A-Za-z])(adserver|casino|porn|spam|xxx)([^0-9A-Za-z]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM d
"""
}
