"""Text of pages and crawls against planted pages."""

from __future__ import annotations

from chronogrid.operators import pages

HTML = """<html><head><title>t</title><style>p{}</style></head><body><nav>menu</nav><div class="post main"><h1>Head</h1>
<p>One  two<br>three</p><div class="post">inner</div><span id="ad">buy</span></div><script>x()</script><p class="post">Last &amp; end</p></body></html>"""


def test_readers_text(spark):
    df = spark.createDataFrame([(1, HTML), (2, None), (3, ""), (4, "plain")], "page_id long, html string")
    got = {r["page_id"]: r["text"] for r in pages.strip_html(df).collect()}
    assert got == {1: "menu\nHead\nOne two\nthree\ninner\nbuy\nLast & end", 2: None, 3: "", 4: "plain"}


def test_outermost_chosen_blocks(spark):
    df = spark.createDataFrame([(1, HTML), (2, None), (3, "<p class=post>a</p><p class=post>a</p><p>b</p>")], "page_id long, html string")
    got = {r["page_id"]: r["text"] for r in pages.extract_by_selectors(df, [".post"], ["#ad", "h1"]).collect()}
    assert got == {1: "One two\nthree\ninner\n\nLast & end", 2: "", 3: "a"}


def test_links_and_crawls(spark):
    rows = [(1, "http://a.example/x/", '<a href="y#z">1</a><a href="/top">2</a><a href="mailto:q">3</a><a href="http://b.example/">4</a><a href="y">5</a>'), (2, None, '<a href="http://[bad">x</a>'), (3, "http://c.example", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r["page_id"], r["link"]) for r in pages.page_links(df, deny=["b.example"]).collect())
    assert got == [(1, "http://a.example/top"), (1, "http://a.example/x/y")]
    assert [r["link"] for r in pages.page_links(df, allow=["b.example"]).collect()] == ["http://b.example/"]
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 4), (4, 5)], "src int, dst int")
    reach = pages.crawl_reach(links, spark.createDataFrame([(1,), (9,)], "page int"), 2)
    assert sorted(tuple(r) for r in reach.collect()) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 2), (9, 9, 0)]
    texts = spark.createDataFrame([(1, "one"), (3, "three"), (4, ""), (2, "two")], "page int, text string")
    assert [tuple(r) for r in pages.crawl_text(reach, texts).collect()] == [(1, 3, "one\n\ntwo\n\nthree")]
