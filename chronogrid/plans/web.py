"""Queries of pages, population tables, look-ups, texts, graphs and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronogrid.operators import matrix, nested, pages, statistics, text
from chronogrid.sources.views import base, derive, oracle, view


def _on(sql):
    return lambda s, d: derive(s, d, sql)


def _round(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


#: A nation's customers as rows of a table: two years' figures, European numbers, some in links.
TOWNS = "SELECT c_nationkey AS page_id, c_custkey AS k, c_name AS name, CAST(c_custkey % 1000 AS VARCHAR(8)) || '.' || lpad(CAST(c_nationkey AS VARCHAR(4)), 3, '0') || ',5' AS a, CASE WHEN c_custkey % 4 = 0 THEN 'none' ELSE CAST(c_custkey % 77 AS VARCHAR(8)) END AS b, c_custkey % 3 = 0 AS linked FROM {customer}"
HEAD = "<table border=''><tr><th>Town</th><th>1890/1</th><th>census 1900</th></tr><tr><td> </td><td>x</td></tr>"


def _town_pages(s, d):
    cell = F.when(F.col("linked"), F.concat(F.lit("<a href='/t'>"), F.col("a"), F.lit("</a>"))).otherwise(F.col("a"))
    row = F.concat(F.lit("<tr><td>"), "name", F.lit("</td><td>"), cell, F.lit("<td>"), "b", F.lit("</tr>"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("k", row.alias("row")))), lambda x: x["row"])
    return _on(TOWNS)(s, d).groupBy("page_id").agg(F.concat(F.lit(HEAD), F.array_join(rows, ""), F.lit("</table>")).alias("html"))


def _cells(s, d):
    return pages.html_table_cells(_town_pages(s, d))


LINKS = "SELECT src, dst FROM {edges} WHERE (src + dst) % 5 < 2"
SEEDS = "SELECT n_nationkey AS page FROM {nation} WHERE n_regionkey = 0"
LINKED = "SELECT s_nationkey AS series_id, CAST(l_linenumber * 10 AS INT) AS x, CAST(count(*) % 4 AS DOUBLE) AS y, s_nationkey % 3 <> 0 AS linked FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey GROUP BY s_nationkey, l_linenumber"
FIELDS = "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN CAST(1800 + p_size AS VARCHAR(8)) ELSE p_brand END AS name, CASE WHEN p_partkey % 5 = 0 THEN 'Variants: ' || p_name || '; ' || p_type ELSE CAST(p_size AS VARCHAR(8)) || '.000,25' END AS value FROM {part}"
NAMED = "SELECT c_mktsegment AS name, CAST(c_nationkey AS INT) AS x, CAST(sum(c_custkey) AS DOUBLE) AS y FROM {customer} GROUP BY c_mktsegment, c_nationkey"
PATCHES = "SELECT 'rename' AS op, c_mktsegment AS name, 'renamed ' || c_mktsegment AS to, CAST(NULL AS INT) AS x, CAST(NULL AS DOUBLE) AS y FROM {customer} WHERE c_nationkey = 3 AND c_mktsegment < 'C' GROUP BY c_mktsegment UNION ALL SELECT 'delete', c_mktsegment, CAST(NULL AS VARCHAR(40)), 7, CAST(NULL AS DOUBLE) FROM {customer} WHERE c_mktsegment > 'C' GROUP BY c_mktsegment UNION ALL SELECT 'set', c_mktsegment, CAST(NULL AS VARCHAR(40)), 1000, 5.5 FROM {customer} WHERE c_mktsegment > 'F' GROUP BY c_mktsegment"
GAZETTEER = "SELECT 'n' || CAST(city_id % 700 AS VARCHAR(8)) AS name, CASE WHEN city_id % 6 = 0 THEN 0.0 ELSE lat END AS lat, CASE WHEN city_id % 6 = 0 THEN 0.0 ELSE lng END AS lng FROM {cities_gt}"
PLACES = "SELECT c_mktsegment AS name, c_custkey AS place, CASE WHEN c_custkey % 2 = 0 OR c_mktsegment < 'B' THEN NULL ELSE c_acctbal + 1000 END AS population, c_custkey AS rank FROM {customer}"
RECORDS = "SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN 'no object' ELSE '<\"size\":' || CAST(p_size AS VARCHAR(8)) || CASE WHEN p_size % 2 = 0 THEN ',\"deep\":<\"a\":1,\"b\":2>' ELSE '' END || '>' END AS json FROM {part}"
FEATURES = ["l_quantity", "l_discount", "l_tax"]


def _names(s, d):
    k = F.col("s_suppkey")
    return base(s, d, "supplier").select(k.alias("id"), F.array(F.concat(F.lit("x"), k.cast("string")), F.concat(F.lit("n"), (k * 6).cast("string")), F.concat(F.lit("n"), k.cast("string"))).alias("names"))


def _countries(s, d):
    series = F.map_from_entries(F.collect_list(F.struct("x", "y")))
    cities = view(s, d, "series_gt").withColumn("country", F.col("series_id") % 5).groupBy("country", "series_id").agg(series.alias("m"))
    cities = cities.select("country", "series_id", F.when(F.col("series_id") % 7 == 0, F.map_filter("m", lambda _, v: v < 0)).otherwise(F.col("m")).alias("m"))
    return cities.groupBy("country").agg(F.map_from_entries(F.collect_list(F.struct(F.col("series_id").cast("string"), "m"))).alias("cities"))


def _json(s, d):
    return _on(RECORDS)(s, d).select("id", F.translate("json", "<>", "{}").alias("json"))


#: Objects of up to six levels, beside arrays.
DEEP = "SELECT p_partkey AS id, '<\"a\":<\"b\":<\"c\":' || CASE WHEN p_size % 3 = 0 THEN '<\"d\":<\"e\":<\"n\":' || CAST(p_size AS VARCHAR(8)) || '>>>' ELSE 'null' END || '>,\"list\":[1,<\"n\":5>]>,\"n\":\"' || CAST(p_size % 7 AS VARCHAR(8)) || '\">' AS json FROM {part}"


def _deep(s, d):
    return _on(DEEP)(s, d).select("id", F.translate("json", "<>", "{}").alias("json"))


def _cubes(s, d):
    """Arrays of maps of arrays."""
    row = lambda *v: F.array(*[x.cast("double") for x in v])
    k, size = F.col("p_partkey"), F.col("p_size")
    held = F.array(F.create_map(F.lit("x"), row(size, k % 3), F.lit("y"), row(k % 2)), F.when(size % 4 != 0, F.create_map(F.lit("z"), F.when(size % 5 != 0, row(F.lit(None), size + 1)))))
    return base(s, d, "part").select(k.alias("id"), held.alias("cube"))


def _page_texts(s, d):
    held = pages.strip_html(base(s, d, "pages"))
    return held.select((F.col("page_id") % 25).cast("int").alias("page"), F.concat_ws(" ", F.col("page_id").cast("string"), F.substring("text", 1, 40)).alias("text")).groupBy("page").agg(F.min("text").alias("text"))


QUERIES = {
    "strip_html": lambda s, d: pages.strip_html(base(s, d, "pages").select("page_id", "html")),
    "extract_by_selectors": lambda s, d: pages.extract_by_selectors(base(s, d, "pages").select("page_id", "html"), ["article", ".post"], ["h1", ".ad"]),
    "html_table_cells": _cells,
    "page_links": lambda s, d: pages.page_links(base(s, d, "pages").select("page_id", "url", "html"), deny=["z"]),
    "crawl_reach": lambda s, d: pages.crawl_reach(_on(LINKS)(s, d), _on(SEEDS)(s, d), 2),
    "crawl_text": lambda s, d: pages.crawl_text(pages.crawl_reach(_on(LINKS)(s, d), _on(SEEDS)(s, d), 2), _page_texts(s, d)),
    "parse_census_table": lambda s, d: pages.parse_census_table(_cells(s, d), ["page_id"]),
    "linked_population_table": lambda s, d: pages.linked_population_table(_on(LINKED)(s, d)),
    "populstat_series": lambda s, d: pages.populstat_fields(_on(FIELDS)(s, d))[0],
    "populstat_fields": lambda s, d: pages.populstat_fields(_on(FIELDS)(s, d))[1],
    "correct_records": lambda s, d: pages.correct_records(_on(NAMED)(s, d), _on(PATCHES)(s, d)),
    "flatten_country_cities": lambda s, d: pages.flatten_country_cities(_countries(s, d)),
    "ordered_candidate_lookup": lambda s, d: pages.ordered_candidate_lookup(_names(s, d), _on(GAZETTEER)(s, d)),
    "most_populous_match": lambda s, d: pages.most_populous_match(_on("SELECT DISTINCT c_mktsegment AS query FROM {customer}")(s, d), _on(PLACES)(s, d)),
    "search_relevance_compounding": lambda s, d: _round(text.search_relevance(base(s, d, "part"), ["p_name", "p_type"], "a", "p_partkey", True).select("p_partkey", "score"), "score"),
    "smart_lookup": lambda s, d: text.smart_lookup(base(s, d, "part"), ["p_name", "p_type"], "an", "p_partkey"),
    "chunk_lines": lambda s, d: text.chunk_lines(base(s, d, "documents").select("doc_id", "text"), 3),
    "chunk_markdown": lambda s, d: text.chunk_markdown(base(s, d, "documents").select("doc_id", "text"), 400),
    "json_paths": lambda s, d: nested.json_paths(_json(s, d), "json", "id"),
    "json_paths_deep": lambda s, d: nested.json_paths(_deep(s, d), "json", "id"),
    "json_paths_objects": lambda s, d: nested.json_paths(_deep(s, d), "json", "id", objects_only=True, exclude=["e"]),
    "json_value_at": lambda s, d: _deep(s, d).select("id", nested.value_at(F.col("json"), "a.b.c.d.e").alias("value"), nested.value_at(F.col("json"), "a.list").alias("list")),
    "json_depth": lambda s, d: nested.json_depth(_deep(s, d), "json", "id"),
    "flatten_sum_deep": lambda s, d: nested.flatten_sum(_deep(s, d), "json"),
    "cardinality_deep": lambda s, d: nested.cardinality(_cubes(s, d), "cube", ["id"]),
    "nested_extrema": lambda s, d: nested.nested_extrema(_cubes(s, d), ["id"], "cube").withColumn("mean", F.round("mean", 6)),
    "clean_deep": lambda s, d: nested.clean(_cubes(s, d), "cube", True).select("id", F.to_json("cube").alias("cube")),
    "has_keys": lambda s, d: _json(s, d).select("id", text.has_keys(F.col("json"), ["size", "deep"]).alias("has_all"), text.has_keys(F.col("json"), ["size", "deep"], "any").alias("has_any")),
    "matrix_augment": lambda s, d: matrix.matrix_augment(view(s, d, "coo_matrix"), matrix.matrix_transpose(view(s, d, "coo_matrix")), 20),
    "shortest_costs": lambda s, d: matrix.shortest_costs(view(s, d, "edges"), 0).select("node", "cost"),
    "shortest_path": lambda s, d: matrix.shortest_path(view(s, d, "edges"), 0, 17),
    "ridge_fit": lambda s, d: _round(statistics.ridge_fit(base(s, d, "lineitem"), FEATURES[:2], "l_extendedprice"), "beta", digits=3),
    "vif_scores": lambda s, d: _round(statistics.vif_scores(base(s, d, "lineitem"), FEATURES[:2]), "vif", digits=9),
    "drop_high_vif": lambda s, d: statistics.drop_high_vif(base(s, d, "lineitem").select("l_orderkey", "l_linenumber", *FEATURES[:2]), FEATURES[:2], 1e-5),
    "condition_number": lambda s, d: _round(statistics.condition_number(base(s, d, "lineitem"), FEATURES[:2]), "condition_number", digits=4),
}

G = "SELECT sum(l_quantity * l_quantity) AS a, sum(l_quantity * l_discount) AS b, sum(l_discount * l_discount) AS c, sum(l_quantity * l_extendedprice) AS p, sum(l_discount * l_extendedprice) AS q FROM {lineitem} WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL"
RANKED = f"SELECT page_id, k, name, a, b, linked, row_number() OVER (PARTITION BY page_id ORDER BY k) + 1 AS r FROM ({TOWNS})"
COSTS = """both_ways AS (SELECT src, dst, cost FROM {edges} UNION ALL SELECT dst, src, cost FROM {edges}),
walk AS (SELECT 0 AS node, CAST(0 AS DOUBLE) AS cost, 0 AS hops UNION SELECT node, min(cost) AS cost, hops FROM (SELECT b.dst AS node, w.cost + b.cost AS cost, w.hops + 1 AS hops FROM walk w JOIN both_ways b ON b.src = w.node WHERE w.hops < 24) GROUP BY node, hops),
best AS (SELECT node, min(cost) AS cost FROM walk GROUP BY node)"""
REL = "COALESCE(CASE WHEN contains(lower({0}), 'a') THEN 1.0 / length({0}) ELSE 0 END, 0)"
SUM = f"({REL.format('p_name')} + {REL.format('p_type')})"
ONE = lambda f: f"CASE WHEN {REL.format(f)} > 0 THEN {REL.format(f)} ELSE 1 END"
REACHED = f"l AS (SELECT DISTINCT * FROM ({LINKS})), w AS (SELECT page AS seed, page, 0 AS depth FROM ({SEEDS}) UNION SELECT w.seed, l.dst, w.depth + 1 FROM w JOIN l ON l.src = w.page WHERE w.depth < 2), reach AS (SELECT seed, page, CAST(min(depth) AS INT) AS depth FROM w GROUP BY seed, page)"

CUBES = "SELECT p_partkey, list_filter([p_size::DOUBLE, (p_partkey % 3)::DOUBLE, (p_partkey % 2)::DOUBLE, CASE WHEN p_size % 4 <> 0 AND p_size % 5 <> 0 THEN (p_size + 1)::DOUBLE END], lambda x: x IS NOT NULL) AS v FROM {part}"

ORACLES = {
    k: oracle(sql)
    for k, sql in {
        "html_table_cells": f"SELECT page_id, CAST(0 AS INT) AS table, CAST(r AS INT) AS r, c, CASE c WHEN 0 THEN name WHEN 1 THEN a ELSE b END AS text, c = 1 AND linked AS linked, CASE c WHEN 0 THEN name WHEN 1 THEN CASE WHEN linked THEN '<a href=''/t''>' || a || '</a>' ELSE a END ELSE b END AS html FROM ({RANKED}) CROSS JOIN (VALUES (0), (1), (2)) AS t(c) UNION ALL SELECT page_id, 0, t.r, t.c, trim(t.text), FALSE, t.text FROM (SELECT DISTINCT c_nationkey AS page_id FROM {{customer}}) CROSS JOIN (VALUES (0, 0, 'Town'), (0, 1, '1890/1'), (0, 2, 'census 1900'), (1, 0, ' '), (1, 1, 'x')) AS t(r, c, text)",
        "page_links": "SELECT DISTINCT page_id, regexp_extract(url, '^https?://[^/?#]*') || link AS link FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"#]*)', 1)) AS link FROM {pages}) WHERE starts_with(link, '/') AND NOT contains(regexp_extract(url, '^https?://[^/?#]*') || link, 'z')",
        "crawl_reach": "WITH RECURSIVE " + REACHED + " SELECT * FROM reach",
        "parse_census_table": f"WITH c AS ({RANKED}) SELECT page_id, CAST(r AS INT) AS r, name, 1890 AS x, CAST(replace(replace(a, '.', ''), ',', '.') AS DOUBLE) AS y FROM c UNION ALL SELECT page_id, CAST(r AS INT), name, 1900, CAST(b AS DOUBLE) FROM c WHERE b <> 'none'",
        "linked_population_table": f"WITH f AS (SELECT series_id, x, y FROM ({LINKED}) WHERE linked AND y > 0 OR y = 0), h AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM f WINDOW w AS (PARTITION BY series_id ORDER BY x)), e AS (SELECT series_id, x, y FROM f UNION SELECT series_id, px + 1, 0.0 FROM h WHERE y = 0 AND py <> 0 UNION SELECT series_id, nx - 1, 0.0 FROM h WHERE y = 0 AND ny <> 0) SELECT series_id, x, y FROM e JOIN (SELECT series_id, min(x) AS lo, max(x) AS hi FROM e WHERE y <> 0 GROUP BY series_id) USING (series_id) WHERE x BETWEEN lo AND hi",
        "populstat_series": "SELECT p_partkey AS id, CAST(1800 + p_size AS INT) AS x, p_size * 1000 + 0.25::DOUBLE AS y FROM {part} WHERE p_partkey % 3 = 0 AND p_partkey % 5 <> 0",
        "populstat_fields": "SELECT p_partkey AS id, CAST(0 AS INT) AS pos, p_name AS other_name FROM {part} WHERE p_partkey % 5 = 0 UNION ALL SELECT p_partkey, 1, p_type FROM {part} WHERE p_partkey % 5 = 0",
        "correct_records": f"WITH p AS ({PATCHES}), n AS (SELECT COALESCE(p.to, s.name) AS name, s.x, s.y FROM ({NAMED}) s LEFT JOIN p ON p.op = 'rename' AND p.name = s.name) SELECT name, x, y FROM n WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.op IN ('delete', 'set') AND p.name = n.name AND p.x = n.x) UNION ALL SELECT name, x, y FROM p WHERE op = 'set'",
        "flatten_country_cities": "SELECT CAST(series_id AS VARCHAR) || '-' || CAST(series_id % 5 AS VARCHAR) AS key, x, y * 1000 AS y FROM {series_gt} WHERE series_id % 7 <> 0",
        "ordered_candidate_lookup": f"WITH g AS ({GAZETTEER}), a AS (SELECT s_suppkey AS id, 1 AS pos, 'n' || CAST(s_suppkey * 6 AS VARCHAR) AS name FROM {{supplier}} UNION ALL SELECT s_suppkey, 2, 'n' || CAST(s_suppkey AS VARCHAR) FROM {{supplier}}), b AS (SELECT a.id, a.name, g.lat, g.lng FROM a JOIN g USING (name) WHERE NOT (lat = 0 AND lng = 0) QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY pos, lat, lng) = 1) SELECT s_suppkey AS id, name, lat, lng FROM {{supplier}} LEFT JOIN b ON b.id = s_suppkey",
        "most_populous_match": f"SELECT name AS query, place, population FROM ({PLACES}) QUALIFY row_number() OVER (PARTITION BY name ORDER BY population DESC NULLS LAST, rank) = 1",
        "search_relevance_compounding": f"SELECT p_partkey, round(({ONE('p_name')}) * ({ONE('p_type')}), 6) AS score FROM {{part}} WHERE {SUM} > 0",
        "smart_lookup": "SELECT CAST(CASE WHEN lower(p_name) = 'an' THEN 0 WHEN lower(p_type) = 'an' THEN 1 WHEN contains(lower(p_name), 'an') THEN 2 ELSE 3 END AS INT) AS rank, * FROM {part} WHERE contains(lower(p_name), 'an') OR contains(lower(p_type), 'an') ORDER BY rank, p_partkey LIMIT 1",
        "chunk_lines": "SELECT doc_id, CAST(k AS INT) AS chunk, array_to_string(CASE WHEN k = 0 THEN list_slice(l, 1, 4) ELSE list_slice(l, k * 3 + 2, k * 3 + 4) END, chr(10)) AS body FROM (SELECT doc_id, l, unnest(range(greatest(CAST(floor((len(l) - 2) / 3.0) AS BIGINT), 0) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {documents} WHERE text IS NOT NULL))",
        "json_paths": "SELECT p_partkey AS id, 'size' AS path, CAST(1 AS INT) AS depth FROM {part} WHERE p_partkey % 9 <> 0 UNION ALL SELECT p_partkey, t.path, t.depth FROM {part} CROSS JOIN (VALUES ('deep', 1), ('deep.a', 2), ('deep.b', 2)) AS t(path, depth) WHERE p_partkey % 9 <> 0 AND p_size % 2 = 0",
        "json_paths_deep": "SELECT p_partkey AS id, t.path, t.depth FROM {part} CROSS JOIN (VALUES ('a', 1, FALSE), ('n', 1, FALSE), ('a.b', 2, FALSE), ('a.list', 2, FALSE), ('a.b.c', 3, FALSE), ('a.b.c.d', 4, TRUE), ('a.b.c.d.e', 5, TRUE), ('a.b.c.d.e.n', 6, TRUE)) AS t(path, depth, deep) WHERE NOT deep OR p_size % 3 = 0",
        "json_paths_objects": "SELECT p_partkey AS id, t.path, t.depth FROM {part} CROSS JOIN (VALUES ('a', 1, FALSE), ('a.b', 2, FALSE), ('a.b.c', 3, TRUE), ('a.b.c.d', 4, TRUE)) AS t(path, depth, deep) WHERE NOT deep OR p_size % 3 = 0",
        "json_value_at": "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN '{\"n\":' || CAST(p_size AS VARCHAR) || '}' END AS value, '[1,{\"n\":5}]' AS list FROM {part}",
        "json_depth": "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 6 ELSE 3 END AS depth FROM {part}",
        "flatten_sum_deep": "SELECT 'n' AS leaf, CAST(sum(p_size % 7 + CASE WHEN p_size % 3 = 0 THEN p_size ELSE 0 END) AS DOUBLE) AS total FROM {part} HAVING count(*) > 0",
        "cardinality_deep": "SELECT p_partkey AS id, CAST(3 + CASE WHEN p_size % 4 <> 0 AND p_size % 5 <> 0 THEN 2 ELSE 0 END AS INT) AS n FROM {part}",
        "nested_extrema": f"SELECT p_partkey AS id, list_min(v) AS low, list_max(v) AS high, list_sum(v) AS total, round(list_avg(v), 6) AS mean FROM ({CUBES})",
        "clean_deep": "SELECT p_partkey AS id, '[{\"x\":[' || array_to_string(list_filter([CASE WHEN p_size <> 0 THEN CAST(p_size AS VARCHAR) || '.0' END, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_partkey % 3 AS VARCHAR) || '.0' END], lambda x: x IS NOT NULL), ',') || '],\"y\":[' || CASE WHEN p_partkey % 2 = 1 THEN '1.0' ELSE '' END || ']}' || CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 5 = 0 THEN ',{}' ELSE ',{\"z\":[' || CAST(p_size + 1 AS VARCHAR) || '.0]}' END || ']' AS cube FROM {part}",
        "has_keys": "SELECT p_partkey AS id, p_partkey % 9 <> 0 AND p_size % 2 = 0 AS has_all, p_partkey % 9 <> 0 AS has_any FROM {part}",
        "matrix_augment": "SELECT i, j, v FROM {coo_matrix} UNION ALL SELECT j, i + 20, v FROM {coo_matrix}",
        "shortest_costs": "WITH RECURSIVE " + COSTS + " SELECT node, cost FROM best",
        "shortest_path": "WITH RECURSIVE " + COSTS + ", back AS (SELECT node, cost, 0 AS n FROM best WHERE node = 17 UNION ALL SELECT p.node, p.cost, b.n + 1 FROM back b JOIN LATERAL (SELECT min(w.src) AS node FROM both_ways w JOIN best x ON x.node = w.src WHERE w.dst = b.node AND x.cost + w.cost = b.cost) m ON TRUE JOIN best p ON p.node = m.node) SELECT CAST(max(n) OVER () - n AS INT) AS step, node, cost FROM back",
        "ridge_fit": f"SELECT f AS feature, round(CASE WHEN f = 'l_quantity' THEN ((c + 0.001) * p - b * q) ELSE ((a + 0.001) * q - b * p) END / ((a + 0.001) * (c + 0.001) - b * b), 3) AS beta FROM ({G}) CROSS JOIN (VALUES ('l_quantity'), ('l_discount')) AS t(f)",
        "vif_scores": f"SELECT f AS feature, round(CASE WHEN f = 'l_quantity' THEN c ELSE a END / (a * c - b * b), 9) AS vif FROM ({G}) CROSS JOIN (VALUES ('l_quantity'), ('l_discount')) AS t(f)",
        "drop_high_vif": "SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem}",
        "condition_number": f"SELECT round(sqrt(((a + c) + sqrt((a - c) * (a - c) + 4 * b * b)) / ((a + c) - sqrt((a - c) * (a - c) + 4 * b * b))), 4) AS condition_number FROM ({G})",
    }.items()
}
