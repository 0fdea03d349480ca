"""Web pages as tables: text, cells, links, crawls, and the population tables that they hold.

Pages are parsed inside tasks, one page at a time; all that follows is joins and groupings.
"""

from __future__ import annotations

from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronogrid.functions.strings import european_number
from chronogrid.operators.curves import expand_value
from chronogrid.operators.series import trim_value
from chronogrid.shared import materialise

UNSEEN = ("script", "style", "noscript", "template", "head")
#: Characters of a page that are read before the cells closed by then are given.
PIECE = 1 << 18
#: Cells that are held before they are given.
ROWS = 10_000
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Reader(HTMLParser):
    """One pass over a page: its text, table cells, links, and the text of chosen elements."""

    def __init__(self, html: str | None, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> None:
        super().__init__(convert_charrefs=True)
        self.include, self.exclude = include, exclude
        self.text: list[str] = []
        self.links: list[str] = []
        self.cells: list[list] = []  # [table, row, column, text parts, has link, html parts]
        self.tables: list[list] = []  # open tables, innermost last: [number, row, column, open cell]
        self.met = 0
        self.blocks: list[list[str]] = []
        self.stack: list[tuple[str, bool, bool]] = []  # (tag, starts a block, is left out)
        self.hidden = self.depth = 0
        self.breaks = False
        if html is not None:
            self.feed(html)
            self.close()

    @staticmethod
    def matches(selector: str, tag: str, attrs: dict[str, str]) -> bool:
        """A simple selector: tag, .class or #id."""
        if selector.startswith("."):
            return selector[1:] in attrs.get("class", "").split()
        return attrs.get("id") == selector[1:] if selector.startswith("#") else tag == selector.lower()

    def handle_starttag(self, tag: str, attrs) -> None:
        held = {k: v or "" for k, v in attrs}
        if tag == "a" and held.get("href"):
            self.links.append(held["href"].strip())
            for cell in self.open_cells():
                cell[4] = True
        inner = self.tables[-1] if self.tables else None
        if tag in ("tr", "td", "th") and inner:
            inner[3] = None
        for cell in self.open_cells():
            cell[5].append(self.get_starttag_text() or "")
        if tag == "table":
            self.tables.append([self.met, -1, -1, None])
            self.met += 1
        elif tag == "tr" and inner:
            inner[1], inner[2] = inner[1] + 1, -1
        elif tag in ("td", "th") and inner:
            inner[2] += 1
            inner[3] = [inner[0], inner[1], inner[2], [], False, []]
            self.cells.append(inner[3])
        if tag in ("br", "p", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.line_break()
        if tag in EMPTY:
            return
        block = not self.depth and any(self.matches(s, tag, held) for s in self.include)
        out = tag in UNSEEN or any(self.matches(s, tag, held) for s in self.exclude)
        self.hidden += out
        if block:
            self.blocks.append([])
        self.depth += block or self.depth > 0
        self.stack.append((tag, block, out))

    def open_cells(self) -> list[list]:
        """The cells that hold what comes next: one for each table around it, as far as those lie in cells."""
        return [table[3] for table in self.tables if table[3]]

    def closed_cells(self) -> list[list]:
        """The cells that nothing more can come into; they, and the text and links so far, are forgotten."""
        held = {id(cell) for cell in self.open_cells()}
        done = [cell for cell in self.cells if id(cell) not in held]
        self.cells = [cell for cell in self.cells if id(cell) in held]
        self.text.clear(), self.links.clear()
        return done

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.tables:
            self.tables.pop()
        elif tag in ("td", "th", "tr") and self.tables:
            self.tables[-1][3] = None
        for cell in self.open_cells():
            cell[5].append(f"</{tag}>")
        if all(t != tag for t, _, _ in self.stack):
            return
        while self.stack:
            t, _, out = self.stack.pop()
            self.hidden -= out
            self.depth -= self.depth > 0
            if t == tag:
                break
        if tag in ("p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.line_break()

    def handle_data(self, data: str) -> None:
        cells = self.open_cells()
        if not self.breaks:
            for cell in cells:
                cell[5].append(data if self.cdata_elem else escape(data, quote=False))
        if self.hidden:
            return
        self.text.append(data)
        if self.depth:
            self.blocks[-1].append(data)
        for cell in cells:
            cell[3].append(data)

    def line_break(self) -> None:
        """A new line of the text, which is not one of the page's own."""
        self.breaks = True
        self.handle_data("\n")
        self.breaks = False


def lines(text: str) -> str:
    """The lines that are not blank, trimmed."""
    return "\n".join(x for x in (" ".join(line.split()) for line in text.split("\n")) if x)


def strip_html(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without the html, with text: what a reader sees, in trimmed lines. Null html has a null text."""

    @F.pandas_udf("string")
    def read(values: pd.Series) -> pd.Series:
        return values.map(lambda h: None if h is None else lines("".join(Reader(h).text)))

    return pages.select(*[c for c in pages.columns if c not in (html, "text")], read(html).alias("text"))


def extract_by_selectors(pages: DataFrame, include: list[str], exclude: list[str], html: str = "html") -> DataFrame:
    """pages without the html, with text: the outermost elements that meet a selector (tag, .class, #id), less what meets one
    to exclude; equal blocks once, joined by blank lines. Without any the text is empty."""

    @F.pandas_udf("array<string>")
    def read(values: pd.Series) -> pd.Series:
        return values.map(lambda h: [] if h is None else [lines("".join(b)) for b in Reader(h, tuple(include), tuple(exclude)).blocks])

    blocks = F.array_distinct(F.filter(read(html), lambda b: b != ""))
    return pages.select(*[c for c in pages.columns if c not in (html, "text")], F.array_join(blocks, "\n\n").alias("text"))


def table_cells(html: str, piece: int = PIECE) -> Iterator[list[list]]:
    """The cells of a page's tables, as they are closed: a page is read piece by piece, however long it is."""
    reader = Reader(None)
    for at in range(0, len(html), piece):
        reader.feed(html[at : at + piece])
        yield reader.closed_cells()
    reader.close()
    yield reader.cells


def html_table_cells(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(id, table, r, c, text, linked, html): every cell of every table; linked tells whether a link stands in it, html is what it holds.

    Tables are numbered as they begin. A table within a cell has rows and columns of its own, and the outer one's go on after
    it; the outer cell's text, links and html hold the inner table's. Rows and cells outside a table are left out.
    """

    names = [id_col, "table", "r", "c", "text", "linked", "html"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for pdf in batches:
            for i, h in zip(pdf[id_col], pdf[html], strict=True):
                for cells in table_cells(h or ""):
                    rows += [(i, t, r, c, lines("".join(x)), link, "".join(held)) for t, r, c, x, link, held in cells]
                    if len(rows) >= ROWS:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            yield pd.DataFrame(rows, columns=names)
            rows = []

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html).mapInPandas(read, f"{id_col} {kind}, table int, r int, c int, text string, linked boolean, html string")


def page_links(pages: DataFrame, allow: list[str] | None = None, deny: list[str] | None = None, id_col: str = "page_id") -> DataFrame:
    """(id, link): the distinct absolute links of each page (url, html), without fragments; links that contain an allowed part,
    if any is given, and no denied one."""

    @F.pandas_udf("array<string>")
    def read(urls: pd.Series, htmls: pd.Series) -> pd.Series:
        def own(url, html):
            found = set()
            for link in Reader(html or "").links:
                try:
                    found.add(urlsplit(urljoin(url or "", link)).geturl().split("#")[0])
                except ValueError:
                    continue
            return sorted(x for x in found if x.startswith(("http://", "https://")))

        return pd.Series([own(u, h) for u, h in zip(urls, htmls, strict=True)], dtype=object)

    out = pages.select(id_col, F.explode(read("url", "html")).alias("link"))
    has = lambda parts: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains("link", p))
    if allow:
        out = out.filter(has(allow))
    return out.filter(~has(deny)) if deny else out


def crawl_reach(links: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, page, depth): pages within ``depth`` links (src, dst) of each seed (page), at the least depth; seeds are at 0. One
    join a level; what was reached before is not visited again."""
    step = links.select("src", "dst").distinct()
    front = materialise(seeds.select(F.col("page").alias("seed"), "page", F.lit(0).alias("depth")).distinct())
    found = front
    for level in range(1, depth + 1):
        new = front.join(step, F.col("page") == F.col("src")).select("seed", F.col("dst").alias("page")).distinct()
        front = materialise(new.join(found.select("seed", "page"), ["seed", "page"], "left_anti").withColumn("depth", F.lit(level)))
        if front.isEmpty():
            break
        found = found.unionAll(front)
    return found


def crawl_text(reach: DataFrame, texts: DataFrame) -> DataFrame:
    """(seed, n_pages, text): the texts (page, text) of all pages reached, by depth and page, joined by blank lines."""
    held = reach.join(texts.select("page", "text"), "page").filter("text is not null and text <> ''")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("depth", "page", "text"))), lambda x: x["text"])
    return held.groupBy("seed").agg(F.count("*").alias("n_pages"), F.array_join(ordered, "\n\n").alias("text"))


def parse_census_table(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, r, name, x, y) of a table's cells (keys, r, c, text): row 0 holds the years, the first number of ``a/b``; the body
    follows the first row whose first cell is blank; the first column is the name, other cells are European numbers."""
    head = cells.filter("r = 0 and c > 0").select(*keys, "c", F.regexp_extract("text", r"\d+", 0).try_cast("int").alias("x")).filter("x is not null")
    start = cells.filter("c = 0 and r > 0 and trim(coalesce(text, '')) = ''").groupBy(*keys).agg(F.min("r").alias("blank"))
    body = cells.join(start, keys).filter("r > blank")
    names = body.filter("c = 0 and trim(text) <> ''").select(*keys, "r", F.trim("text").alias("name"))
    values = body.filter("c > 0").join(head, [*keys, "c"]).select(*keys, "r", "x", european_number(F.col("text")).alias("y")).filter("y is not null")
    return names.join(values, [*keys, "r"]).select(*keys, "r", "name", "x", "y")


def linked_population_table(cells: DataFrame) -> DataFrame:
    """(series_id, x, y) of cells (series_id, x, y, linked): a value counts where it stands as a link, or is 0; zeros are
    expanded to their neighbours and cut at both ends."""
    kept = cells.filter((F.col("linked") & (F.col("y") > 0)) | (F.col("y") == 0)).select("series_id", "x", "y")
    return trim_value(expand_value(kept, 0.0), 0.0)


def populstat_fields(df: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """From (id, name, value) fields: the series (id, x, y) of names that are numbers, and the other names (id, pos, other_name) of
    fields whose value begins with ``variants``, as commas or semicolons part them."""
    series = df.filter(F.rlike("name", F.lit(r"^-?\d+$"))).select(id_col, F.col("name").cast("int").alias("x"), european_number(F.col("value")).alias("y")).filter("y is not null")
    listed = F.split(F.regexp_replace("value", r"(?i)^variants\s*:?\s*", ""), r"\s*[,;]\s*")
    names = df.filter(F.rlike("value", F.lit(r"(?i)^variants\b"))).select(id_col, F.posexplode(listed).alias("pos", "other_name")).filter("other_name <> ''")
    return series, names


def correct_records(series: DataFrame, patches: DataFrame) -> DataFrame:
    """(name, x, y) after patches (op, name, to, x, y): ``rename`` gives a series a new name, then ``delete`` takes a point away and
    ``set`` puts one."""
    renames = patches.filter("op = 'rename'").select("name", "to").dropDuplicates(["name"])
    named = series.join(renames, "name", "left").select(F.coalesce("to", "name").alias("name"), "x", "y")
    gone = patches.filter("op in ('delete', 'set')").select("name", "x").distinct()
    put = patches.filter("op = 'set'").select("name", "x", "y")
    return named.join(gone, ["name", "x"], "left_anti").unionAll(put)


def flatten_country_cities(df: DataFrame) -> DataFrame:
    """(key, x, y): countries (country, cities map of a map of years) as series of ``city-country``, in units for thousands. Cities
    without a value are left out."""
    cities = df.select("country", F.explode("cities").alias("city", "series")).filter(F.size(F.map_filter("series", lambda _, v: v.isNotNull())) > 0)
    long = cities.select(F.concat_ws("-", "city", "country").alias("key"), F.explode("series").alias("x", "v"))
    return long.filter("v is not null").select("key", "x", (F.col("v") * 1000).alias("y"))


def ordered_candidate_lookup(names: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(id, name, lat, lng): of an id's names (id, names array, best first) the first that the gazetteer (name, lat, lng) places
    elsewhere than at (0, 0); of its entries the smallest coordinates. Ids without one have nulls."""
    asked = names.select("id", F.posexplode("names").alias("pos", "name"))
    placed = gazetteer.filter("lat is not null and lng is not null and not (lat = 0 and lng = 0)").groupBy("name").agg(F.min(F.struct("lat", "lng")).alias("p"))
    best = asked.join(placed, "name").groupBy("id").agg(F.min(F.struct("pos", "name", "p")).alias("m"))
    return names.select("id").join(best, "id", "left").select("id", "m.name", "m.p.lat", "m.p.lng")


def most_populous_match(asked: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(query, place, population): of the places (name, place, population, rank) of a name the most populous one; without figures
    the first by rank."""
    met = asked.select("query").distinct().join(gazetteer, F.col("query") == F.col("name"))
    order = F.struct(F.coalesce("population", F.lit(-1.0)), -F.col("rank"))
    return met.groupBy("query").agg(F.max_by(F.struct("place", "population"), order).alias("m")).select("query", "m.place", "m.population")


