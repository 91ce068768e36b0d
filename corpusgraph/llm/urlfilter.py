"""URL filtering by pattern rules that are indexed by their rarest literal token.

A rule is a regular expression with the words that every URL it matches must hold between delimiters. Each rule is filed under
the one of its words that fewest URLs of the table hold; a URL's words fetch candidate rules, and only those run. Rules without such a word run
on every URL. The index is broadcast; a rule list above MAX_RULE_BYTES is cut into blocks that judge one after the other, and the longest match of all stays.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import batch_of, map_arrow, slices

WORD = re.compile(r"[0-9A-Za-z]+")
MAX_RULE_BYTES = 64 << 20
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = re.split(r"[?#]", url[at + 3 :], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass"), slash + path


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str  # allow or block
    pattern: str  # runs on host + path
    words: tuple[str, ...]

    @staticmethod
    def prefix(text: str, verdict: str) -> Rule:
        """``host/path``: the host and its subdomains, paths that start with the rule's."""
        host, slash, path = text.partition("/")
        literal = host + slash + path
        ends = [m.end() for m in WORD.finditer(literal)]
        words = tuple(m[0] for m in WORD.finditer(literal) if m.end() < len(literal) or not slash) if ends else ()
        return Rule(text, verdict, r"(?:[^/]*\.)?" + re.escape(literal) + ("" if slash else r"(?:/|\Z)"), words)

    @staticmethod
    def host_word(word: str, verdict: str) -> Rule:
        """The word anywhere in the host, between delimiters."""
        return Rule(f"*{word}*", verdict, rf"(?:[^/]*[^0-9A-Za-z/])?{re.escape(word)}(?:[^0-9A-Za-z]|\Z)", (word,))


#: The rules of the query, and the method's own words for hosts
RULES = (
    Rule.prefix("com/en/", "block"),
    Rule.prefix("example.com/en/7", "allow"),
    Rule.prefix("net/de/", "allow"),
    Rule.prefix("example.net/de/8", "block"),
    Rule.prefix("org/es/", "block"),
)
METHOD_RULES = tuple(Rule.host_word(w, "block") for w in ("adserver", "casino", "porn", "spam", "xxx"))


class Index:
    def __init__(self, rules: tuple[Rule, ...], method: tuple[Rule, ...], counts: dict[str, int]) -> None:
        self.filed: dict[str, list[tuple[int, bool, Rule, re.Pattern]]] = {}
        self.always: list[tuple[int, bool, Rule, re.Pattern]] = []
        for own, some in ((True, rules), (False, method)):
            for r in some:
                entry = (len(r.text), own, r, re.compile(r.pattern))
                if r.words:
                    self.filed.setdefault(min(r.words, key=lambda w: (counts.get(w, 0), w)), []).append(entry)
                else:
                    self.always.append(entry)

    def candidates(self, target: str) -> list[tuple[int, bool, Rule, re.Pattern]]:
        out = list(self.always)
        for w in dict.fromkeys(WORD.findall(target)):
            out += self.filed.get(w, ())
        return out

    def longest(self, host: str, path: str) -> tuple[Rule | None, bool]:
        """The longest fitting rule (of equal length, the greater text), and whether one of the method's own patterns blocks."""
        best, blocked = None, False
        for _, own, rule, pattern in self.candidates(host + path):
            if pattern.match(host + path):
                if not own:
                    blocked = blocked or rule.verdict == "block"
                elif best is None or (len(rule.text), rule.text) > (len(best.text), best.text):
                    best = rule
        return best, blocked

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        """The longest fitting rule, and its verdict or else the method's: block if one of its own patterns fits, allow otherwise."""
        best, blocked = self.longest(host, path)
        return (best.text, best.verdict) if best else (None, "block" if blocked else "allow")


def rules_of(lines: Iterable[str]) -> tuple[Rule, ...]:
    """Rules from lines ``allow host/path`` or ``block host/path``; empty lines and those after # say nothing. Of repeated rules the last counts."""
    parts = [x.split(None, 1) for x in lines if x.strip() and not x.lstrip().startswith("#")]
    if bad := [x for x in parts if len(x) != 2 or x[0] not in ("allow", "block")]:
        raise ValueError(f"not a rule: {' '.join(bad[0])!r}")
    return tuple(Rule.prefix(text, verdict) for text, verdict in {t.strip(): v for v, t in parts}.items())


def blocks_of(rules: tuple[Rule, ...], most: int) -> list[tuple[Rule, ...]]:
    """Rules in blocks of ``most`` bytes of patterns (one longer rule stands alone); one empty block at least."""
    out, size = [[]], 0
    for r in rules:
        if out[-1] and size + len(r.pattern) > most:
            out.append([])
            size = 0
        out[-1].append(r)
        size += len(r.pattern)
    return [tuple(x) for x in out]


def word_frequencies(pages: DataFrame, words: set[str], column: str = "url") -> dict[str, int]:
    """In how many URLs each of the rules' words occurs, over the whole table."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in slices(batches, 4096):
            for url in b.column("url").to_pylist():
                host, path = split_url(url)
                counts.update(words.intersection(WORD.findall(host + path)))
        if counts:
            w, n = zip(*counts.items(), strict=True)
            yield batch_of(schema, word=w, n=n)

    rows = map_arrow(pages.select(F.col(column).alias("url")), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r.word: r.n for r in rows}


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, method: tuple[Rule, ...] = METHOD_RULES, id_column: str = "page_id", column: str = "url", most: int = MAX_RULE_BYTES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages.

    Null urls and urls without ``://`` have empty host and path and fit no rule. Very long urls are judged whole. Repeated rows give one row each; a null page_id stays
    null. Of rules that fit, the longest wins (of equal length, the greater text). No other column is read. Empty table: no rows. most: bytes of patterns that are broadcast in one block.
    """
    spark = pages.sparkSession
    counts = word_frequencies(pages, {w for r in (*rules, *method) for w in r.words}, column)
    kind = dict(pages.dtypes)[id_column]
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("blocked", pa.bool_())])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            host, path = zip(*(split_url(u) for u in b.column("url").to_pylist()), strict=True)
            nulls = pa.nulls(len(host), pa.string())
            yield batch_of(schema, page_id=b.column("page_id"), host=host, path=path, rule=nulls, verdict=nulls, blocked=[False] * len(host))

    def block(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, 4096):
                rule, verdict, blocked = (b.column(c).to_pylist() for c in ("rule", "verdict", "blocked"))
                for k, (host, path) in enumerate(zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)):
                    best, own = shared.value.longest(host, path)
                    blocked[k] = blocked[k] or own
                    if best is not None and (rule[k] is None or (len(best.text), best.text) > (len(rule[k]), rule[k])):
                        rule[k], verdict[k] = best.text, best.verdict
                yield batch_of(schema, rule=rule, verdict=verdict, blocked=blocked, **{c: b.column(c) for c in ("page_id", "host", "path")})

        return run

    sql = "page_id long, host string, path string, rule string, verdict string, blocked boolean"
    out = map_arrow(pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(column).alias("url")), first, sql)
    for n, some in enumerate(blocks_of(rules, most)):
        out = map_arrow(out, block(spark.sparkContext.broadcast(Index(some, () if n else method, counts))), sql)
    verdict = F.coalesce("verdict", F.when(F.col("blocked"), "block").otherwise("allow"))
    return out.select(F.col("page_id").cast(kind).alias("page_id"), "host", "path", "rule", verdict.alias("verdict"))
