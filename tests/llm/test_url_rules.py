"""URL rules by the cascade and, beyond its bytes, by the join, against a plain reading of the rules."""

from __future__ import annotations

import functools
import random

import pytest

from chronogrid.llm import url_filter

RULES = [
    ("com", "/", "allow"), ("Example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/es/", "block"),
    ("net", "/es/", "allow"), ("org", None, "block"), ("a.org", "", "allow"), ("b.org", "/x", None), (None, "/", "block"), ("ü.de", "/ß", "block"),
]
TEXT = "page_id long, url string, rule string"


def urls(seed=3, n=600):
    rng = random.Random(seed)
    hosts = ["com", "x.com", "example.com", "EXAMPLE.com", "www.example.com", "a.www.example.com", "wwwexample.com", "net", "d.net", "org", "a.org", "c.a.org", "b.org", "ü.de", "", "."]
    paths = ["", "/", "/en", "/en/", "/en/a", "/es/", "/es", "/x", "/xy", "/ß/a", "/en/?q=/es/", "#/en/"]
    made = [f"{rng.choice(['http', 'ftp', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(n)]
    return [None, "", "no scheme/en/", "a://b://net/es/", *made, *made[:50]]


def judged(url, rules, default="allow"):
    """(host, path, rule, verdict): the longest rule with a verdict, block before allow."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = []
    for h, p, v in rules:
        if h is None or v is None:
            continue
        h, p = "".join(c.lower() if "A" <= c <= "Z" else c for c in h), p or ""
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h + p), v == "block", h + p, v))
    return (host, path, *max(fits)[2:]) if fits else (host, path, None, default)


@pytest.mark.parametrize("way", ["cascade", "join"])
@pytest.mark.parametrize("rules", [RULES, []], ids=["rules", "none"])
def test_rules(spark, monkeypatch, way, rules):
    if way == "join":
        monkeypatch.setattr(url_filter, "build_cascade", functools.partial(url_filter.build_cascade, max_bytes=-1))
    given = urls()
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = url_filter.judge_urls(pages, table, default="block").orderBy("page_id").collect()
    want = [judged(u, rules, "block") for u in given]
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == want


@pytest.mark.parametrize("way", ["cascade", "join"])
def test_no_pages_and_clashing_names(spark, monkeypatch, way):
    if way == "join":
        monkeypatch.setattr(url_filter, "build_cascade", functools.partial(url_filter.build_cascade, max_bytes=-1))
    table = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert url_filter.judge_urls(spark.createDataFrame([], TEXT), table).count() == 0
    pages = spark.createDataFrame([(1, "http://d.net/es/1", "old")], "page_id long, url string, Rule string").selectExpr("*", "1 AS _k", "2 AS _at", "3 AS k", "4 AS key")
    (row,) = url_filter.judge_urls(pages, table).collect()
    assert (row["rule"], row["verdict"], row["_k"], row["_at"], row["key"]) == ("net/es/", "block", 1, 2, 4)
