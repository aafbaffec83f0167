import random
import re

from specmill.llm.urlfilter import BLOCK_GLOBS, RULES, HostRule, ShiftAnd, glob_symbols, judged_urls


def as_regex(glob):
    out, at = "", 0
    while at < len(glob):
        if glob[at : at + 2] == "**":
            out, at = out + ".*", at + 2
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(glob[at], re.escape(glob[at]))
        at += 1
    return re.compile(out, re.S)


def test_automaton_against_regular_expressions():
    rng = random.Random(1)
    globs = ["".join(rng.choice(["a", "b", "/", "*", "**", "?"]) for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    subjects = ["".join(rng.choice("ab/") for _ in range(rng.randrange(9))) for _ in range(300)]
    found = ShiftAnd([glob_symbols(g) for g in globs]).matches([s.encode() for s in subjects])
    want = [[bool(as_regex(g).fullmatch(s)) for g in globs] for s in subjects]
    assert found.tolist() == want


def judge(url):
    host, path = "", ""
    if url is not None and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fits, key=lambda r: len(r.name), default=None)
    glob = next((g for g in BLOCK_GLOBS if as_regex(g).fullmatch(f".{host}{path}")), None)
    verdict = rule.verdict if rule else "block" if glob else "allow"
    return host, path, rule.name if rule else None, verdict


URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?q#f", "http://example.com/en/", "http://example.com",
    "https://a.example.com/en", "https://a.example.com/en/1", "ftp://www.example.com/en/9", "http://xexample.com/en/",
    "http://x.net/es/1", "http://net/fr/", "http://x.net/es", "http://x.org/a.example.com/en/", "http://casino.org",
    "http://x.cheap-pills.org/a/b", "http://x.org/cheap-pills", "http://x.org/a.exe", "http://x.org/é/ü.exe?x",
    "http://x.com:80/", "http://u@x.com/#", "a://b://c.com/", "http://x.com/" + "y" * 100_000, "http://ÄX.com/",
]


def test_every_url(spark):
    rows = [(i, u, "host") for i, u in enumerate([*URLS, URLS[4]])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string").repartition(3)
    got = {r.page_id: tuple(r)[1:5] for r in judged_urls(pages).collect()}
    assert got == {i: judge(u) for i, u, _ in rows}


def test_ties_and_empty(spark):
    rules = (HostRule("allow", "b.org", "/xx/"), HostRule("block", "a.b.org", "/x"))
    pages = spark.createDataFrame([(None, "http://a.b.org/xx/")], "page_id bigint, url string")
    assert judged_urls(pages, rules).first().rule == "a.b.org/x"
    assert judged_urls(pages.where("false")).collect() == []
    assert judged_urls(pages, (), ()).first().verdict == "allow"
