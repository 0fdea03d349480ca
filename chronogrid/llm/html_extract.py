"""Main text of HTML pages by consensus host paths.

Every page scores its containers by the running text they hold. A container's path is the tags and classes from the root,
with digits taken out, so that pages of one template share paths. Spark sums the score shares by host and path, and counts
the pages whose own best container lies at it. Paths that a twentieth of a host's pages (two at least) elect win. Each page is
then read at its own best path if that won, so that a host may have several templates; else at the winning path of
most votes that holds a good part as much text as the page's own best, however the page's own choice came about (a long
comment box, a list of offers); else, where its host has elected nothing that the page has, at its own best path.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronogrid.llm.common import free_name
from chronogrid.shared import materialise

#: Share of a host's pages, and pages, whose own best a path must be to win; at most 1 / ELECTED paths can.
ELECTED, ELECTED_PAGES = 0.05, 2
#: Bytes of the vote table up to which it is broadcast.
BROADCAST_BYTES = 32 << 20
SALTS = 64
#: Text of a winning path, as a share of the text of the page's own best path, from which consensus goes before it.
ENOUGH = 0.3
#: Characters from which a path, or a tag with its classes, is held as a hash.
LONG_PATH, LONG_LABEL = 1024, 256
#: Characters outside links from which a block is running text.
RUNNING = 80

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINER = frozenset("article body div main section td".split())
SKIPPED = frozenset(
    "aside button canvas datalist dialog footer head iframe input math menu nav noscript object script search select style svg template textarea title".split()
)
CLOSES_P = BLOCK - {"html", "body", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: An opening tag ends an open one of these before it, up to the given holder.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
#: Words of a class, id or role that mark what is no part of the article.
MARKS = frozenset(
    "ad ads adbox adslot adunit advert advertisement advertising adverts alert banner breadcrumb breadcrumbs byline-share captcha comment commentlist "
    "comments consent contentinfo complementary cookie cookies disclaimer disqus dropdown footer form gdpr hidden legal login masthead menu modal nav navbar "
    "navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion recommend recommended related replies "
    "reply respond search share sharing shoutbox sidebar sidenav signup skip social sponsor sponsored subscribe subscription toc toolbar tooltip topbar "
    "tracking widget".split()
)
#: Those of them that stand in other names too: in a compound class inside an article they need to be its last word, or the
#: element to hold no running text.
COMMON_WORDS = frozenset(
    "alert banner disclaimer form hidden legal menu modal notice notices overlay promotion recommend recommended related reply respond search share "
    "sharing skip social toc tracking widget".split()
)
#: Running characters from which a form is one around a page.
FORM_TEXT = 400
HEAD_MARKS = frozenset(["header", "pageheader", "siteheader"])
#: Last words of a class that name the article itself, whatever stands before them.
ARTICLE_HEADS = frozenset("article body content entry main post story text".split())
WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
DIGITS = re.compile(r"\d+")


@dataclass
class Node:
    tag: str
    parent: Node | None
    label: str = ""
    skipped: bool = False
    within: bool = False
    link: bool = False
    path: str = ""
    score: float = 0.0
    order: int = 0
    #: the nearest of its like from here up: block, container, article or main element
    block: Node | None = None
    container: Node | None = None
    article: Node | None = None
    #: the nearest element from here up that counts only if it holds so many characters of running text, and that number
    doubt: Node | None = None
    needs: int = 0


def shortened(text: str, limit: int) -> str:
    """The text, or its 128-bit digest where it is longer: paths of deeply nested pages stay short."""
    return text if len(text) <= limit else "#" + hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


@lru_cache(1 << 14)
def marked(value: str) -> frozenset[str]:
    """The words of a class, id or role, token by token; a token whose last word names the article has none."""
    found: set[str] = set()
    for token in value.split():
        words = [w.lower() for w in WORDS.findall(token)]
        if words and not (len(words) > 1 and words[-1] in ARTICLE_HEADS):
            found |= {*words, token.lower()}
    return frozenset(found)


@lru_cache(1 << 14)
def doubtful(value: str) -> frozenset[str]:
    """The words that mark a class, id or role only as part of a compound that ends in another word."""
    found, sure = set(), set()
    for token in value.split():
        words = [w.lower() for w in WORDS.findall(token)]
        if words and not (len(words) > 1 and words[-1] in ARTICLE_HEADS):
            common = COMMON_WORDS & set(words[:-1]) if token.lower() not in MARKS else set()
            found |= common
            sure |= ({*words, token.lower()} & MARKS) - common
    return frozenset(found - sure if not sure else ())


@dataclass
class Page(HTMLParser):
    """Blocks of text, each with the container that holds it."""

    html: str
    nodes: list[Node] = field(default_factory=list)
    #: (node of the block, text, characters in links)
    blocks: list[tuple[Node, str, int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        HTMLParser.__init__(self, convert_charrefs=True)
        self.at = Node("html", None, "html", path="html")
        self.at.block = self.at.container = self.at
        self.open: Counter[str] = Counter()
        self.nodes.append(self.at)
        self.text: list[str] = []
        self.linked = 0
        self.holder: Node | None = None
        self.feed(self.html)
        self.close()
        self._end_block()
        self._settle()

    def _settle(self) -> None:
        """Leave out the blocks of doubtful elements without enough running text."""
        if not any(n.needs for n in self.nodes):
            return
        running: Counter[int] = Counter()
        for node, text, linked in self.blocks:
            at = node.doubt
            while at is not None and len(text) - 2 * linked >= RUNNING:
                running[at.order] += len(text) - linked
                at = at.parent.doubt if at.parent else None

        def counts(node: Node) -> bool:
            at = node.doubt
            while at is not None:
                if running[at.order] < at.needs:
                    return False
                at = at.parent.doubt if at.parent else None
            return True

        self.blocks = [b for b in self.blocks if counts(b[0])]

    def __hash__(self) -> int:
        return id(self)

    def _end_block(self) -> None:
        joined = " ".join("".join(self.text).split())
        if joined and self.holder is not None:
            self.blocks.append((self.holder, joined, self.linked))
        self.text, self.linked, self.holder = [], 0, None

    def _pop_to(self, node: Node) -> None:
        """Close node and all that is open in it."""
        at = self.at
        block = False
        while at is not node:
            block |= at.tag in BLOCK
            self.open[at.tag] -= 1
            at = at.parent
        self.open[node.tag] -= node.parent is not None
        if block or node.tag in BLOCK:
            self._end_block()
        self.at = node.parent or node

    def _close_open(self, tags, holders) -> None:
        left = sum(self.open[t] for t in tags)
        at, last = self.at, None
        while left > 0 and at.parent and at.tag not in holders:
            if at.tag in tags:
                last = at
                left -= 1
            at = at.parent
        if last is not None:
            self._pop_to(last)

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers are not needed."""
        return j

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "br":
            self.text.append("\n")
            return
        if tag == "html":
            return
        if tag in SIBLINGS:
            self._close_open(*SIBLINGS[tag])
        if tag in CLOSES_P:
            self._close_open({"p"}, {"button", "table", "td", "th", "body"})
        if tag == "body":
            self._close_open({"head"}, ())
        elif tag not in SKIPPED and tag not in ("meta", "link", "base") and self.at.tag == "head":
            self._pop_to(self.at)
        if tag in BLOCK:
            self._end_block()
        if tag in VOID:
            return
        held = {k: v or "" for k, v in attrs if k in ("class", "id", "role", "style")}
        hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)
        up = self.at
        within = up.within or tag in ("article", "main")
        marks = frozenset().union(*(marked(held[k]) for k in ("class", "id", "role") if k in held))
        skip = up.skipped or tag in SKIPPED or hidden or "display:none" in held.get("style", "").replace(" ", "").lower()
        needs = FORM_TEXT if tag == "form" else 0
        if tag not in ("body", "article", "main"):
            named = marks & MARKS
            if named and within and named <= frozenset().union(*(doubtful(held[k]) for k in ("class", "id", "role") if k in held)):
                needs, named = max(needs, RUNNING), frozenset()
            skip = skip or bool(named) or not within and (tag == "header" or bool(marks & HEAD_MARKS))
        classes = sorted({DIGITS.sub("", c) for c in held.get("class", "").lower().split()} - {""})
        label = shortened(".".join([tag, *classes]), LONG_LABEL)
        node = Node(tag, up, label, skip, within, up.link or tag == "a", f"{shortened(up.path, LONG_PATH)}/{label}", order=len(self.nodes))
        node.block = node if tag in BLOCK else up.block
        node.container = node if tag in CONTAINER else up.container
        node.article = node if tag in ("article", "main") else up.article
        node.needs, node.doubt = needs, node if needs else up.doubt
        self.open[tag] += 1
        self.nodes.append(node)
        self.at = node

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("script", "style"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.text.append("\n")
            return
        if tag == "p" and not self._open("p"):
            self._end_block()
            return
        node = self._open(tag)
        if node is not None and node.parent is not None and tag != "body":
            self._pop_to(node)

    def _open(self, tag: str) -> Node | None:
        if self.open[tag] <= 0:
            return None
        at = self.at
        while at.parent:
            if at.tag == tag:
                return at
            if at.tag in ("td", "th", "table") and tag not in BLOCK:
                return None
            at = at.parent
        return None

    def handle_data(self, data: str) -> None:
        if self.at.skipped:
            return
        if self.holder is None and data.strip():
            self.holder = self.at.block
        self.text.append(data)
        if self.at.link:
            self.linked += len(data.strip())

    # ---- containers

    def scored(self) -> list[Node]:
        """Containers with a score, best first: a block counts for its container, half for the next one up, and so on. An
        article element stands for what is in it."""
        for node, text, linked in self.blocks:
            points = max(0.0, len(text) - 2.0 * linked) or 0.01
            at: Node | None = node.container
            while at is not None and points >= 0.005:
                at.score += points
                points /= 2
                at = at.parent.container if at.parent else None
        best = [n for n in self.nodes if n.score > 0]
        best.sort(key=lambda n: (-n.score, n.order))
        return best

    def path_of(self, node: Node) -> str:
        return (node.article or node).path

    def climbed(self, node: Node) -> Node:
        """The container up from node, as far as running text beside it goes; an article element is not left."""
        running = [0] * len(self.nodes)  # blocks of running text within each node; parents stand before their children
        for at, text, linked in self.blocks:
            running[at.order] += len(text) - 2 * linked >= RUNNING
        for at in reversed(self.nodes):
            if at.parent:
                running[at.parent.order] += running[at.order]
        found = up = node
        while up.parent and up.tag not in ("article", "main", "body"):
            up = up.parent.container
            if running[up.order] > running[found.order]:
                found = up
        # a heading beside it, or a line without links after or before, belongs to it
        up = found.parent.container if found.parent and found.tag not in ("article", "main", "body") else None
        if up is not None and up.tag not in ("body", "html") and up.parent:
            beside = [(at, linked) for at, _, linked in self.blocks if at.container is up]
            if any(at.tag in ("h1", "h2") for at, _ in beside) and not any(linked for _, linked in beside):
                found = up
        return found

    def texts_at(self, least: float) -> dict[str, list[tuple[int, int]]]:
        """Ranges of the blocks within each container path that holds at least so many characters; the blocks of a container
        stand in a row, and containers of one path are not nested."""
        n = len(self.nodes)
        size, first, end = [0] * n, [len(self.blocks)] * n, [0] * n
        for i, (node, text, _) in enumerate(self.blocks):
            k = node.order
            size[k] += len(text)
            first[k], end[k] = min(first[k], i), i + 1
        for node in reversed(self.nodes):
            k = node.order
            if node.parent and end[k]:
                up = node.parent.order
                size[up] += size[k]
                first[up], end[up] = min(first[up], first[k]), max(end[up], end[k])
        total: Counter[str] = Counter()
        places: dict[str, list[tuple[int, int]]] = {}
        for node in self.nodes:
            if end[node.order] and node.container is node:
                total[node.path] += size[node.order]
                places.setdefault(node.path, []).append((first[node.order], end[node.order]))
        return {path: x for path, x in places.items() if total[path] >= least}


def parse(html: str | None) -> tuple[str | None, list[str], list[tuple[str, int]], list[tuple[str, list[tuple[int, int]]]]]:
    """(own best path, blocks, votes: (path, millionths of the page's score), (path, block ranges) of the paths that hold
    enough beside the own best one)."""
    page = Page(html) if html else None
    best = page.scored() if page else []
    if not best:
        return None, [], [], []
    own = page.path_of(page.climbed(best[0]))
    total = sum(n.score for n in best)
    votes: dict[str, float] = {own: 0.0}
    for n in best:
        path = page.path_of(n)
        votes[path] = votes.get(path, 0.0) + n.score / total
    places = page.texts_at(0)
    held = sum(len(page.blocks[i][1]) for a, b in places[own] for i in range(a, b))
    enough = page.texts_at(ENOUGH * held)
    return own, [text for _, text, _ in page.blocks], [(p, round(v * 1e6)) for p, v in votes.items()], list(enough.items())


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(host, r":\d+$", ""))


PARSED = "own string, blocks array<string>, votes array<struct<path:string,vote:long>>, places array<struct<path:string,ranges:array<struct<a:int,b:int>>>>"


def parsed_pages(html: Column) -> Column:
    """Each page's blocks, votes and places of its container paths."""

    @F.pandas_udf("struct<" + ",".join(":".join(x.split(" ", 1)) for x in PARSED.split(", ")) + ">")
    def look(htmls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(h) for h in htmls], columns=[x.split()[0] for x in PARSED.split(", ")])

    return look(html)


def host_paths(parsed: DataFrame, host: str, page: str, elected: float = ELECTED) -> DataFrame:
    """(host, paths): the winning container paths of each host by votes, best first. Votes are added up before they are
    shuffled, so a host with a third of all pages costs no more than its paths."""
    cast = parsed.select(F.col(host).alias("host"), F.col(f"{page}.own").alias("own"), F.explode(f"{page}.votes").alias("v"))
    total = cast.groupBy("host", F.col("v.path").alias("path")).agg(F.sum("v.vote").alias("vote"), F.count_if(F.col("v.path") == F.col("own")).alias("own"))
    total = materialise(total)
    size = total.groupBy("host").agg(F.sum("own").alias("pages"))
    enough = F.greatest(F.lit(float(ELECTED_PAGES)), F.col("pages") * elected)
    won = total.filter(F.col("own") >= ELECTED_PAGES).join(size, "host").filter(F.col("own") >= enough)
    return won.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("vote")).alias("v"), "path"))), lambda x: x["path"]).alias("paths"))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages without the html, with text, n_chars and path.

    Each page is parsed once, into a written table of its blocks. A form is left out unless it holds so much running text as a page
    does; so is what a class's words mark, but inside an article words that have other meanings mark a compound class only as its
    last word, or where the element has no running text. Character references are decoded; white space in a block is
    one space; blocks are joined in page order by one space. Null or empty html has an empty text and a null path; a null url
    has the empty host and votes with its like; equal votes go by path; repeated rows stay; long pages are read whole; an
    empty table gives an empty result; columns with the names given here are replaced.
    """
    made = ("text", "n_chars", "path")
    keep = [c for c in pages.columns if c.lower() not in made and c != html_col]
    host, salt, paths, page, path = (free_name(pages, f"extract_{x}") for x in ("host", "salt", "paths", "page", "path"))
    parsed = materialise(pages.select(*keep, host_of(F.col(url_col)).alias(host), F.xxhash64(F.col(id_col), F.col(url_col)).alias(salt), parsed_pages(F.col(html_col)).alias(page)))
    votes = materialise(host_paths(parsed, host, page))
    size = votes.agg(F.sum(F.length("host") + F.length(F.concat_ws("", "paths")) + 40)).first()[0] or 0
    votes = votes.select(F.col("host").alias(host), F.col("paths").alias(paths))
    if size <= BROADCAST_BYTES:
        joined = parsed.join(F.broadcast(votes), host, "left")
    else:  # a hot host's pages go to many tasks
        votes = votes.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = parsed.withColumn(salt, F.pmod(F.col(salt), F.lit(SALTS))).join(votes, [host, salt], "left")
    own, places = F.col(f"{page}.own"), F.col(f"{page}.places")
    here = F.transform(places, lambda x: x["path"])
    elected = F.get(F.array_intersect(F.col(paths), here), F.lit(0))
    chosen = F.when(F.array_contains(F.col(paths), own), own).otherwise(F.coalesce(elected, own))
    ranges = F.get(F.filter(places, lambda x: x["path"] == F.col(path)), F.lit(0))["ranges"]
    blocks = F.flatten(F.transform(ranges, lambda r: F.slice(F.col(f"{page}.blocks"), r["a"] + 1, r["b"] - r["a"])))
    out = joined.withColumn(path, chosen)
    text = F.coalesce(F.array_join(blocks, " "), F.lit(""))
    return out.select(*keep, text.alias("text"), F.char_length(text).cast("long").alias("n_chars"), F.col(path).alias("path"))
