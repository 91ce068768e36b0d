"""Queries of the text, rule and chunking operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgraph.functions import text as T
from corpusgraph.operators import chunking as C
from corpusgraph.operators import enrich as N
from corpusgraph.operators import retrieval as R
from corpusgraph.operators import rules as S
from corpusgraph.operators.relations import content_hash
from corpusgraph.plans.derived import table
from corpusgraph.sources import sinks as K


def _docs(spark, d):
    return table(spark, d, "documents")


_PLAIN = [n for n in sorted(S.SENSITIVE)]


def sensitive_flags(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(S.sensitive_hits("text", phone=False), ",").alias("hits"))


def sensitive_rollup(spark, d):
    hits = _docs(spark, d).select(F.explode(S.sensitive_hits("text", phone=False)).alias("rule"))
    return hits.groupBy("rule").agg(F.count("*").alias("n"))


def sensitive_phone(spark, d):
    return _docs(spark, d).where(S.has_phone("text")).select("doc_id")


RULES = S.PrivacyRules(exact_paths=("en/820", "/en/7"), directories=("blog.tionsh.example.net", "fr\\"), patterns=(r"utm_source=\w+$", "("), extensions=(".HTML",))


def privacy_match(spark, d):
    return table(spark, d, "pages").select("page_id", S.is_private("url", RULES).alias("is_private"))


_LITERALS = [(-1, "here is the code:\n```\nx\n```"), (-2, "module top ( input a );"), (-3, "a = 1;\nb = 2;\nplain"), (-4, "one; two\nplain\nplain\nplain"), (-5, "")]


def leak_guard(spark, d):
    talk = table(spark, d, "conversations").select("conv_id", "turn", "text")
    rows = talk.unionByName(spark.createDataFrame([(i, 0, t) for i, t in _LITERALS], "conv_id long, turn long, text string"))
    return rows.select("conv_id", "turn", S.leak_guard("text").alias("answer"))


def line_windows(spark, d):
    files = _docs(spark, d).select("doc_id", F.col("text").alias("source"))
    out = C.line_windows(files, 10, 0.2)
    return out.select("doc_id", "name", "line_start", "line_end", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def split_large_units(spark, d):
    units = _docs(spark, d).select("doc_id", F.concat(F.lit("u"), "doc_id").alias("name"), "text", F.lit(5).alias("line_start"), (F.size(F.split("text", "\n")) + 4).alias("line_end"))
    return C.split_large(units, 600, 6, 0.2).select("doc_id", "name", "line_start", "line_end", F.length("text").alias("n"))


def char_windows(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(C.char_windows("text")).alias("pos", "piece")).select("doc_id", "pos", F.md5(F.col("piece").cast("binary")).alias("piece_md5"))


def semantic_windows(spark, d):
    files = _docs(spark, d).select("doc_id", F.col("text").alias("source"))
    return C.semantic_windows(files, 12, 3).select("doc_id", "chunk_index", "line_start", "line_end", F.length("text").alias("n"))


def markdown_sections(spark, d):
    """One Markdown text for each region, made of its nations."""
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("## "), "n_name", F.lit("\nline of "), "n_name", F.lit("\n\n")))), "").alias("body"))
    files = table(spark, d, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey")).select("r_regionkey", F.concat(F.lit("Preface of "), "r_name", F.lit("\n# "), "r_name", F.lit("\n"), "body").alias("source"))
    return C.markdown_sections(files).select("r_regionkey", "chunk_index", "kind", "name", "text", "line_start", "line_end")


def chunk_ids(spark, d):
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return _docs(spark, d).select("doc_id", T.chunk_id(path, F.lit("markdown"), F.lit("section"), F.concat(F.lit("a:b/"), "lang"), F.col("doc_id") % 3).alias("chunk_id"))


def project_ids(spark, d):
    return _docs(spark, d).select("source").distinct().select("source", T.project_id(F.concat(F.lit("/srv/"), "source")).alias("project_id"))


def language_family(spark, d):
    named = _docs(spark, d).withColumn("language", F.element_at(F.array(*(F.lit(x) for x in ("c", "cpp", "systemc", "python", "verilog", "systemverilog", "markdown"))), (F.col("doc_id") % 7 + 1).cast("int")))
    return named.groupBy(T.language_family("language").alias("family")).agg(F.count("*").alias("n"))


def _units(spark, d):
    """Parts as C++ units."""
    body = F.concat(F.lit("  int "), F.translate("p_name", " ", "_"), F.lit("(\n int x )\n{ return "), F.col("p_size").cast("string"), F.lit("; }"))
    text = F.when(F.col("p_partkey") % 5 == 0, F.lit("{ }")).when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("class "), F.translate("p_brand", "#", "_"), F.lit(";"))).otherwise(body)
    language = F.when(F.col("p_partkey") % 3 == 0, "python").otherwise("cpp")
    return table(spark, d, "part").select("p_partkey", text.alias("text"), language.alias("language"), F.lit("function").alias("kind"), F.translate("p_name", " ", "_").alias("name"), F.col("p_size").alias("line_start"), (F.col("p_size") + 3).alias("line_end"))


def declaration_extract(spark, d):
    return _units(spark, d).select("p_partkey", T.declaration("text", "language", "kind", "name").alias("declaration"))


def sanitized_document(spark, d):
    u = _units(spark, d).withColumns({"declaration": T.declaration("text", "language", "kind", "name"), "summary": T.behavior_summary("name", "kind", "language", "line_start", "line_end")})
    doc = T.sanitized_document(F.lit("parts"), F.lit("/srv/parts"), F.concat(F.lit("p"), "p_partkey"), "language", "kind", "name", "line_start", "line_end", "declaration", "summary")
    return u.select("p_partkey", doc.alias("document"))


def project_summary_sample(spark, d):
    """What a language model is shown of each source: its answer here is the question."""
    docs = _docs(spark, d).select(F.col("source").alias("project_id"), "source", F.col("source").alias("project_name"), F.lit("/").alias("project_root"), F.col("lang").alias("language"), F.col("doc_id").cast("string").alias("name"), F.substring("text", 1, 300).alias("semantic_summary"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("seq"))
    return N.project_summaries(docs, lambda prompt: prompt).select(F.col("project_id").alias("source"), F.col("text").alias("sample"))


def prompt_assembly(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("lang").orderBy("doc_id")
    hits = _docs(spark, d).select(F.col("lang").alias("query_id"), F.row_number().over(w).alias("rank"), "text", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("file_path"), F.lit(1).alias("line_start"), F.size(F.split("text", "\n")).alias("line_end"), F.lit("section").alias("chunk_type"), F.col("source").alias("project_name"), F.lit("markdown").alias("language"), (F.col("doc_id") % 4 == 0).alias("is_private"), F.concat(F.lit("summary of "), F.col("doc_id").cast("string")).alias("privacy_summary")).where("rank <= 5")
    return R.build_prompts(hits, "What is it?").select("query_id", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"), "chunk_tokens", "total_tokens")


def token_estimate(spark, d):
    return _docs(spark, d).groupBy("source").agg(F.sum(T.token_estimate("text")).alias("tokens"))


def token_reduction(spark, d):
    per = _docs(spark, d).groupBy("source").agg(F.sum(T.token_estimate("text")).alias("full_tokens"), F.max(T.token_estimate("text")).alias("rag_tokens"))
    return per.select("source", "full_tokens", "rag_tokens", F.round(R.token_reduction("full_tokens", "rag_tokens"), 6).alias("reduction_pct"))


def index_dry_run(spark, d):
    files = _docs(spark, d).select(F.concat(F.lit("."), "lang").alias("ext"), "text")
    tokens = F.greatest(F.lit(1), T.token_estimate("text"))
    return files.groupBy("ext").agg(F.count("*").alias("files"), F.sum(F.regexp_count("text", F.lit("\n")) + 1).alias("lines"), F.sum(tokens).alias("tokens")).orderBy(F.desc("files"), "ext")


def result_distribution(spark, d):
    hits = _docs(spark, d).select("lang", (F.col("doc_id") % 3).cast("string").alias("kind"), "source", F.col("n_chars").cast("double").alias("score"))
    return R.result_distribution(hits, "lang", "kind", "source").withColumn("mean", F.round("mean", 6))


def collection_stats(spark, d):
    return K.collection_stats(_docs(spark, d).withColumnRenamed("lang", "collection"))


def file_hashes(spark, d):
    return _docs(spark, d).select("doc_id", content_hash("text").alias("content_hash"))


QUERIES = {f.__name__: f for f in (sensitive_flags, sensitive_rollup, sensitive_phone, privacy_match, leak_guard, line_windows, split_large_units, char_windows, semantic_windows, markdown_sections, chunk_ids, project_ids, language_family, declaration_extract, sanitized_document, project_summary_sample, prompt_assembly, token_estimate, token_reduction, index_dry_run, result_distribution, collection_stats, file_hashes)}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _re(p: str) -> str:
    return _q(p).replace("\x0b", "\\x0B").replace("\x0c", "\\x0C").replace("\x1c", "\\x1C").replace("\x1d", "\\x1D").replace("\x1e", "\\x1E").replace("\x85", "\\x{85}").replace(" ", "\\x{2028}").replace(" ", "\\x{2029}").replace("\r", "\\r").replace("\n", "\\n")


_FLAGS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, {_q(S.SENSITIVE[n])}) THEN {_q(n)} END" for n in _PLAIN) + "], lambda x: x IS NOT NULL)"
_SP = r"'^\s+|\s+$'"
_TRIM = "regexp_replace({}, " + _SP + ", '', 'g')"
_UNITS = """units AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '{ }' WHEN p_partkey % 5 = 1 THEN 'class ' || translate(p_brand, '#', '_') || ';'
  ELSE '  int ' || translate(p_name, ' ', '_') || '(' || chr(10) || ' int x )' || chr(10) || '{ return ' || p_size || '; }' END AS text,
  CASE WHEN p_partkey % 3 = 0 THEN 'python' ELSE 'cpp' END AS language, translate(p_name, ' ', '_') AS name, p_size AS line_start, p_size + 3 AS line_end FROM part),
heads AS (SELECT *, array_to_string(list_filter(list_transform(string_split(split_part(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '{', 1), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), ' ') AS head FROM units),
decls AS (SELECT *, CASE WHEN language = 'python' THEN 'function ' || name WHEN head = '' THEN 'function ' || name || ';' WHEN ends_with(head, ';') THEN head ELSE head || ';' END AS declaration FROM heads)"""

ORACLE_SQL = {
    "sensitive_flags": f"SELECT doc_id, array_to_string({_FLAGS}, ',') AS hits FROM documents",
    "sensitive_rollup": f"SELECT rule, count(*) AS n FROM (SELECT unnest({_FLAGS}) AS rule FROM documents) GROUP BY rule",
    "privacy_match": "SELECT page_id, ends_with(url, 'en/820') OR ends_with(url, '/en/7') OR contains(url || '/', 'blog.tionsh.example.net/') OR contains(url || '/', 'fr/') OR regexp_matches(url, 'utm_source=\\w+$') OR ends_with(lower(url), '.html') AS is_private FROM pages",
    "leak_guard": f"""WITH rows AS (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT * FROM (VALUES {", ".join(f"({i}, 0, {_q(t)})" for i, t in _LITERALS)})),
lines AS (SELECT *, list_filter(list_transform(regexp_split_to_array(text, {_re(S.LINE_BREAK)}), lambda s: {_TRIM.format('s')}), lambda s: s <> '') AS ls FROM rows),
code AS (SELECT *, len(list_filter(ls, lambda s: regexp_matches(s, {_q(S.CODE_LINE)}) OR {" OR ".join(f"starts_with(s, {_q(x)})" for x in S.CODE_STARTS)})) AS n FROM lines)
SELECT conv_id, turn, CASE WHEN contains(text, '```') OR regexp_matches(text, {_q(S.CODE)}) OR (n >= 2 AND n / len(ls) >= 0.4) THEN {_q(S.BLOCK_MESSAGE)} ELSE text END AS answer FROM code""",
    "line_windows": "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), w AS (SELECT doc_id, ls, unnest(generate_series(0, len(ls) - 1, 8)) AS a FROM l) SELECT doc_id, 'lines_' || (a + 1) || '_' || least(a + 10, len(ls)) AS name, (a + 1)::INTEGER AS line_start, least(a + 10, len(ls))::INTEGER AS line_end, md5(array_to_string(ls[a + 1 : a + 10], chr(10))) AS text_md5 FROM w",
    "split_large_units": "WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents), w AS (SELECT *, unnest(CASE WHEN length(text) // 4 > 600 THEN generate_series(0, len(ls) - 1, 5) ELSE [-1] END) AS a FROM l) SELECT doc_id, CASE WHEN a < 0 THEN 'u' || doc_id ELSE 'u' || doc_id || '_part_' || (a // 5 + 1) END AS name, (CASE WHEN a < 0 THEN 5 ELSE 5 + a END)::INTEGER AS line_start, (CASE WHEN a < 0 THEN len(ls) + 4 ELSE least(5 + a + 5, len(ls) + 4) END)::INTEGER AS line_end, (CASE WHEN a < 0 THEN length(text) ELSE length(array_to_string(ls[a + 1 : a + 6], chr(10))) END)::INTEGER AS n FROM w",
    "char_windows": f"WITH t AS (SELECT doc_id, {_TRIM.format('text')} AS t FROM documents), w AS (SELECT doc_id, t, unnest(generate_series(0, greatest(1, ceil((length(t) - 120) / 780.0))::BIGINT - 1)) AS k FROM t WHERE t <> '') SELECT doc_id, k::INTEGER AS pos, md5(substr(t, k * 780 + 1, 900)) AS piece_md5 FROM w",
    "semantic_windows": f"WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), w AS (SELECT doc_id, ls, unnest(generate_series(0, len(ls) - 1, 9)) AS a FROM l), t AS (SELECT doc_id, a, least(a + 12, len(ls)) AS e, {_TRIM.format('array_to_string(ls[a + 1 : a + 12], chr(10))')} AS t FROM w) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1)::INTEGER AS chunk_index, (a + 1)::INTEGER AS line_start, e::INTEGER AS line_end, length(t)::INTEGER AS n FROM t WHERE t <> ''",
    "markdown_sections": """WITH n AS (SELECT r_regionkey, r_name, n_name, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_name) AS k FROM region JOIN nation ON r_regionkey = n_regionkey)
SELECT r_regionkey, 0 AS chunk_index, 'paragraph' AS kind, 'section_0' AS name, 'Preface of ' || r_name AS text, 1 AS line_start, 1 AS line_end FROM region
UNION ALL SELECT r_regionkey, 1, 'section', r_name, '# ' || r_name, 2, 2 FROM region
UNION ALL SELECT r_regionkey, (k + 1)::INTEGER, 'section', n_name, '## ' || n_name || chr(10) || 'line of ' || n_name, (3 * k)::INTEGER, (3 * k + 2 + CASE WHEN k = max(k) OVER (PARTITION BY r_regionkey) THEN 1 ELSE 0 END)::INTEGER FROM n""",
    "chunk_ids": "SELECT doc_id, concat_ws(':', 'doc', left(sha256(source || '/' || doc_id || '.md'), 8), 'section', translate('a:b/' || lang, ':/', '__'), doc_id % 3) AS chunk_id FROM documents",
    "project_ids": "SELECT DISTINCT source, left(sha256('/srv/' || source), 12) AS project_id FROM documents",
    "language_family": "SELECT CASE doc_id % 7 WHEN 0 THEN 'c_family' WHEN 1 THEN 'c_family' WHEN 2 THEN 'systemc_tlm' WHEN 3 THEN 'python' WHEN 6 THEN 'markdown' ELSE 'hdl' END AS family, count(*) AS n FROM documents GROUP BY 1",
    "declaration_extract": f"WITH {_UNITS} SELECT p_partkey, declaration FROM decls",
    "sanitized_document": f"WITH {_UNITS} SELECT p_partkey, concat_ws(chr(10), 'project: parts', 'project_root: /srv/parts', 'file: p' || p_partkey, 'language: ' || language, 'symbol_type: function', 'symbol_name: ' || name, 'line_range: ' || line_start || '-' || line_end, 'declaration: ' || declaration, 'summary: ' || name || ' is a function in ' || language || ' defined at lines ' || line_start || '-' || line_end || '.') AS document FROM decls",
    "project_summary_sample": "WITH f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) SELECT source, regexp_replace('Summarize this project in at most three sentences, without code.' || chr(10) || 'Project: ' || source || chr(10) || string_agg('- ' || lang || ':' || doc_id || ' -> ' || left(CASE WHEN text = '' THEN doc_id::VARCHAR ELSE text END, 140), chr(10) ORDER BY k), '\\s+$', '') AS sample FROM f WHERE k <= 8 GROUP BY source",
    "prompt_assembly": f"""WITH h AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents),
b AS (SELECT lang, k, 'Project: ' || source || chr(10) || 'File: ' || source || '/' || doc_id || ' (lines 1-' || len(string_split(text, chr(10))) || '), type=section' || CASE WHEN doc_id % 4 = 0 THEN ' [HIGH-CONFIDENTIAL]' ELSE '' END || chr(10) || '```markdown' || chr(10)
  || CASE WHEN doc_id % 4 = 0 THEN '[PRIVACY-SAFE SUMMARY] summary of ' || doc_id || chr(10) || chr(10) || {_q(R.PRIVATE_NOTE)} ELSE text END || chr(10) || '```' AS block FROM h WHERE k <= 5),
p AS (SELECT lang AS query_id, 'System: ' || {_q(R.SYSTEM)} || chr(10) || chr(10) || 'Context:' || chr(10) || '---' || chr(10) || string_agg(block, chr(10) || '---' || chr(10) ORDER BY k) || chr(10) || '---' || chr(10) || chr(10) || 'User: What is it?' AS prompt FROM b GROUP BY lang)
SELECT query_id, md5(prompt) AS prompt_md5, length(prompt) // 4 AS chunk_tokens, length(prompt) // 4 + 60 AS total_tokens FROM p""",
    "token_estimate": "SELECT source, sum(length(text) // 4)::BIGINT AS tokens FROM documents GROUP BY source",
    "token_reduction": "SELECT source, sum(length(text) // 4)::BIGINT AS full_tokens, max(length(text) // 4)::BIGINT AS rag_tokens, round((1 - max(length(text) // 4) / sum(length(text) // 4)) * 100, 6) AS reduction_pct FROM documents GROUP BY source",
    "index_dry_run": "SELECT '.' || lang AS ext, count(*) AS files, sum(len(string_split(text, chr(10))))::BIGINT AS lines, sum(greatest(1, length(text) // 4))::BIGINT AS tokens FROM documents GROUP BY lang",
    "result_distribution": "SELECT lang, kind, source, count(*) AS n, min(score) AS low, max(score) AS high, round(avg(score), 6) AS mean FROM (SELECT lang, (doc_id % 3)::VARCHAR AS kind, source, n_chars::DOUBLE AS score FROM documents) GROUP BY GROUPING SETS ((lang), (kind), (source))",
    "collection_stats": "SELECT lang AS collection, count(*) AS n, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY lang",
    "sensitive_phone": r"""SELECT doc_id FROM documents WHERE len(list_filter(regexp_extract_all(regexp_replace(text, '([^0-9A-Za-z_\s\-().+])', '\1\1', 'g'), '(?:^|[^0-9A-Za-z_])(\+?\d[\d\s\-().]{6,}\d)(?:$|[^0-9A-Za-z_])', 1),
  lambda x: length(regexp_replace(x, '\D', '', 'g')) BETWEEN 7 AND 15 AND regexp_matches(x, '[\s\-().]'))) > 0""",
    "file_hashes": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
}
