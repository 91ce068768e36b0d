"""Declarative screening rules: sensitive data, private paths, leaked source text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions.text import extension, trim_space

#: Patterns of sensitive data and of source text; the names that a text breaks are sorted, so their order has no effect
SENSITIVE = {
    "email": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "ipv4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "password": r"(?i)(password|passwd|pwd|secret|token|api[_-]?key)\s*[:=]\s*\S+",
    "url_credentials": r"(?i)\b(?:https?|ssh)://[^\s:@/]+:[^\s@/]+@",
}
PHONE = r"(?<![0-9A-Za-z_])(?:\+?\d[\d\s\-().]{6,}\d)(?![0-9A-Za-z_])"
CODE = r"""\b(module\s+\w+|endmodule|always\s*@|#include\s*[<"]|import\s+\w+|def\s+\w+\s*\(|class\s+\w+|\w+\s*\([^)]*\)\s*\{)"""
CODE_LINE = r"[{};]|\b(return|if|else|for|while|switch|always|endmodule)\b"
CODE_STARTS = ("#include", "import ", "from ", "def ", "class ")
BLOCK_MESSAGE = "基于安全策略，我不能直接返回源码原文。我可以提供功能说明、模块职责、调用关系和关键风险点的摘要。"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def has_phone(text: Column | str) -> Column:
    """A run of 7 to 15 digits with at least one separator, not inside a word."""
    found = F.regexp_extract_all(text, F.lit(PHONE), F.lit(0))
    digits = lambda c: F.length(F.regexp_replace(c, r"\D", ""))
    return F.exists(found, lambda c: digits(c).between(7, 15) & (F.regexp_count(c, F.lit(r"[\s\-().]")) >= 1))


def sensitive_hits(text: Column | str, phone: bool = True) -> Column:
    """Sorted names of the rules that a text breaks; null text breaks none."""
    x = F.col(text) if isinstance(text, str) else text
    x = F.coalesce(x, F.lit(""))
    flags = [F.when(x.rlike(p), F.lit(n)) for n, p in SENSITIVE.items()]
    if phone:
        flags.append(F.when(has_phone(x), F.lit("phone")))
    return F.array_sort(F.array_compact(F.array(*flags)))


def require_clean(chunks: DataFrame, text: str = "text", name: str = "chunk_id") -> DataFrame:
    """chunks as they are; the job fails on the first row that breaks a rule."""
    hits = sensitive_hits(text)
    message = F.concat(F.lit("Sensitive information detected in "), F.col(name), F.lit(": "), F.array_join(hits, ", "))
    return chunks.withColumn(text, F.when(F.size(hits) > 0, F.raise_error(message).cast("string")).otherwise(F.col(text)))


@dataclass(frozen=True)
class PrivacyRules:
    """Path rules of a project; see sources.config for the file format."""

    exact_paths: tuple[str, ...] = ()
    directories: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    enabled: bool = True
    skipped: tuple[str, ...] = field(default=(), compare=False)

    def summary(self) -> str:
        n = [len(x) for x in (self.exact_paths, self.directories, self.patterns, self.extensions)]
        return f"PrivacyRules(enabled={self.enabled}, exact={n[0]}, dirs={n[1]}, patterns={n[2]}, exts={n[3]}, total={sum(n)})"

    def valid_patterns(self) -> list[str]:
        out = []
        for p in self.patterns:
            try:
                re.compile(p)
                out.append(p)
            except re.error:
                continue
        return out


def is_private(path: Column | str, rules: PrivacyRules) -> Column:
    """Path ends with an exact rule, holds a directory rule, has a listed extension or matches a pattern. Null paths are not private."""
    x = F.col(path) if isinstance(path, str) else path
    if not rules.enabled:
        return F.lit(False)
    normal = F.replace(x, F.lit("\\"), F.lit("/"))
    tests = [normal.endswith(p.replace("\\", "/")) for p in rules.exact_paths]
    tests += [F.concat(normal, F.lit("/")).contains(p.replace("\\", "/").rstrip("/") + "/") for p in rules.directories]
    if rules.extensions:
        tests.append(extension(x).isin([e.lower() for e in rules.extensions]))
    tests += [normal.rlike(p) for p in rules.valid_patterns()]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return F.coalesce(out, F.lit(False))


def leak_guard(answer: Column | str) -> Column:
    """The answer, or the fixed message if it looks like source text."""
    x = F.col(answer) if isinstance(answer, str) else answer
    lines = F.filter(F.transform(F.split(x, LINE_BREAK), trim_space), lambda s: s != "")

    def code_like(s: Column) -> Column:
        out = s.rlike(CODE_LINE)
        for start in CODE_STARTS:
            out = out | s.startswith(start)
        return out

    code = F.size(F.filter(lines, code_like))
    share = (code >= 2) & (code / F.greatest(F.size(lines), F.lit(1)) >= 0.4)
    return F.when(x.contains("```") | x.rlike(CODE) | share, F.lit(BLOCK_MESSAGE)).otherwise(x)
