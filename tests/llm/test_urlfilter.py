import re

from corpusgraph.llm import urlfilter as U


def brute(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest, re.S)[0]
        path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in ("com/en/", "example.com/en/7", "net/de/", "example.net/de/8", "org/es/") for h in [r.split("/")[0]] if (host == h or host.endswith("." + h)) and path.startswith(r[len(h) :])]
    rule = max(fits, key=len, default=None)
    verdict = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}.get(rule)
    return host, path, rule, verdict or ("block" if set(re.split("[^0-9A-Za-z]", host)) & {"adserver", "casino", "porn", "spam", "xxx"} else "allow")


URLS = [None, "", "example.com/en/7", "http://", "http://com/en/", "http://com/en", "http://COM/en/x", "http://xcom/en/", "http://a.com/EN/", "https://x.example.com/en/75?q", "https://example.com/en/7", "https://notexample.com/en/7", "ftp://b.net/de/8#x", "http://example.net/de/8", "http://example.net/de/88/1", "http://q.example.net/de/9", "http://example.org/es/", "http://example.org/es", "http://example.org?x/es/", "http://example.org#/es/", "a://b://c/en/", "http://u@example.com/en/1", "http://example.com:80/en/1", "http://spam-farm.org/x", "http://notspam.org/", "http://ÀB.com/en/é", "http://a\n.com/en/", "http://.com/en/", "x" * 100_000 + "://com/en/"]


def test_matches_brute_force(spark):
    df = spark.createDataFrame([(n % 9 if n % 5 else None, u, "h") for n, u in enumerate(URLS)], "page_id long, url string, host string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(df).collect()), key=str)
    assert got == sorted(((n % 9 if n % 5 else None, *brute(u)) for n, u in enumerate(URLS)), key=str)
    assert U.filter_urls(df.limit(0)).count() == 0


def test_rules_are_filed_under_their_rarest_word():
    index = U.Index(U.RULES, (), {"com": 50, "en": 90, "example": 70, "net": 3, "de": 2, "org": 9, "es": 10})
    assert {w: [e[2].text for e in es] for w, es in index.filed.items()} == {"com": ["com/en/", "example.com/en/7"], "de": ["net/de/", "example.net/de/8"], "org": ["org/es/"]}
    assert index.candidates("x.fr/a/b") == [] and not index.always


def test_many_rules_in_blocks(spark):
    hosts = [f"h{n % 700}.{t}" for n, t in enumerate(("com", "net", "org") * 700)]
    lines = [f"{'allow' if n % 3 else 'block'} {h}/p{n % 7}/{n % 50}" for n in range(20_000) for h in (hosts[n % len(hosts)],)] + ["# none", "", "block h5.com/"]
    rules = U.rules_of(lines)
    urls = [f"https://{'' if n % 2 else 'w.'}{hosts[n % len(hosts)]}/p{n % 7}/{n % 50}{n % 10}" for n in range(500)]
    texts = {r.text: r.verdict for r in rules}

    def longest(url):
        host, _, path = url.split("://")[1].partition("/")
        names = [host.split(".", k)[-1] for k in range(host.count(".") + 1)]
        fits = [t for h in names for k in range(len(path) + 1) if (t := h + "/" + path[:k]) in texts]
        best = max(fits, key=lambda t: (len(t), t), default=None)
        return best, texts.get(best, "allow")

    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    size = sum(len(r.pattern) for r in rules)
    assert len(U.blocks_of(rules, size // 3)) > 2
    for most in (size, size // 3):
        got = {r.page_id: (r.rule, r.verdict) for r in U.filter_urls(df, rules, (), most=most).collect()}
        assert got == {n: longest(u) for n, u in enumerate(urls)}
    index = U.Index(rules, (), U.word_frequencies(df, {w for r in rules for w in r.words}))
    fetched = [len(index.candidates("".join(U.split_url(u)))) for u in urls]
    assert not index.always and sum(fetched) / len(fetched) < 100  # of 20,000


def test_host_only_rule():
    r = U.Rule.prefix("bad.com", "block")
    index = U.Index((r,), (), {})
    assert index.judge("bad.com", "")[1] == "block" and index.judge("a.bad.com", "/x")[1] == "block" and index.judge("bad.com.org", "/")[1] == "allow"


def test_sql(spark):
    from corpusgraph.llm.op7 import ORACLE_SQL, QUERIES
    from tests.oracle import compare

    assert compare(spark, QUERIES["op7_url_filters"], ORACLE_SQL["op7_url_filters"], "/root/testdata/sf0.01") == 250
