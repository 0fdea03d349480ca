"""Queries of curves, anchored series and the fusion of cities."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronogrid.operators import curves, frames, nested, series
from chronogrid.plans.history import BRACKET, VALUE
from chronogrid.sources.views import derive, oracle, view


def _v(name):
    return lambda s, d: view(s, d, name)


def _on(sql):
    return lambda s, d: derive(s, d, sql)


def _round(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


gt, rr, cells = (_v(n) for n in ("series_gt", "series_rr", "cells"))
FLAT = "SELECT series_id, x, CAST(CAST(floor(y / 100.0) AS BIGINT) % 3 AS DOUBLE) AS y FROM {series_rr}"
#: Each city has its nation's series; the relative cities lie a fixed way off, so that those of equal keys are near.
GT_CITIES = "SELECT city_id, lat, lng FROM {cities_gt}"
RR_CITIES = "SELECT city_id, lat, lng FROM {cities_rr}"
GT_SERIES = "SELECT city_id AS series_id, x, y + city_id % 5 AS y FROM {cities_gt} JOIN {series_gt} USING (series_id)"
RR_SERIES = "SELECT city_id AS series_id, x, y - city_id % 3 AS y FROM {cities_rr} JOIN {series_rr} USING (series_id)"
OUTER = "SELECT series_id, min(x) - 20 AS x FROM {series_gt} GROUP BY series_id UNION ALL SELECT series_id, max(x) + 20 AS x FROM {series_gt} GROUP BY series_id"
MAPS = "SELECT p_partkey AS id, map('size', CAST(p_size % 4 AS STRING), 'name', CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END, 'none', '') AS m FROM {part}"
T = [1996, 2002]

QUERIES = {
    "spline_interpolate": lambda s, d: _round(curves.spline_interpolate(gt(s, d), rr(s, d)), "y"),
    "lagrange_interpolate": lambda s, d: _round(curves.lagrange_interpolate(gt(s, d), rr(s, d)), "y", digits=4),
    "interpolate_gt": lambda s, d: _round(curves.interpolate_gt(gt(s, d), rr(s, d)), "y"),
    "expand_value": lambda s, d: curves.expand_value(_on(FLAT)(s, d), 0.0),
    "trim_start": lambda s, d: series.trim_value(_on(FLAT)(s, d), 0.0, end=False),
    "clamp_domain": lambda s, d: curves.clamp_domain(rr(s, d), frames.series_domain(gt(s, d))),
    "remove_zeroes": lambda s, d: curves.remove_zeroes(_on(FLAT)(s, d)),
    "clean": lambda s, d: nested.clean(_on(MAPS)(s, d), "m", True).select("id", F.array_join(F.array_sort(F.map_keys("m")), "|").alias("kept")),
    "series_map": lambda s, d: curves.series_map(rr(s, d), "round(sqrt(abs(n)) * 2 + pow(n, 2) / 100, 4)"),
    "series_zip_expression": lambda s, d: series.series_zip(gt(s, d), rr(s, d).withColumn("x", F.col("x") - 5), expression="i * 2 - x"),
    "series_zip_mul": lambda s, d: series.series_zip(gt(s, d), rr(s, d).withColumn("x", F.col("x") - 5), "mul"),
    "zip_arrays": lambda s, d: gt(s, d).groupBy("series_id").agg(F.array_sort(F.collect_list("y")).alias("a")).join(rr(s, d).groupBy("series_id").agg(F.array_sort(F.collect_list("y")).alias("b")), "series_id").select("series_id", F.array_join(F.transform(series.zip_arrays(F.col("a"), F.col("b"), "sub"), lambda v: v.cast("long").cast("string")), "|").alias("difference")),
    "range_extrema": lambda s, d: _round(frames.range_extrema(view(s, d, "features").withColumn("late", F.when(F.col("feature_id") % 2 == 0, F.col("to_year")).otherwise(F.col("from_year"))).withColumn("early", F.col("from_year") + F.col("to_year") - F.col("late")), "w", "late", "early"), "mean", "total"),
    "linear_extrapolate": lambda s, d: _round(series.linear_interpolate(gt(s, d), _on(OUTER)(s, d)), "y"),
    "interpolate_layers": lambda s, d: series.interpolate_layers(cells(s, d).filter("yr in (1995, 1998, 2001)"), T),
    "fuse_city_series": lambda s, d: curves.fuse_city_series(_on(GT_CITIES)(s, d), _on(GT_SERIES)(s, d), _on(RR_CITIES)(s, d), _on(RR_SERIES)(s, d)),
}

NEAREST = """{name} AS (SELECT *, last_value({v} IGNORE NULLS) OVER up AS av, last_value(CASE WHEN {v} IS NOT NULL THEN x END IGNORE NULLS) OVER up AS ax,
 first_value({v} IGNORE NULLS) OVER dn AS bv, first_value(CASE WHEN {v} IS NOT NULL THEN x END IGNORE NULLS) OVER dn AS bx FROM {source}
 WINDOW up AS (PARTITION BY series_id ORDER BY x ROWS UNBOUNDED PRECEDING), dn AS (PARTITION BY series_id ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
BETWEEN = "CASE WHEN av IS NULL THEN bv WHEN bv IS NULL OR ax = bx THEN av ELSE av + (x - ax)::DOUBLE / (bx - ax) * (bv - av) END"


def anchored(gt: str, rr: str, tag: str = "") -> str:
    """CTEs up to z{tag}: (series_id, x, y) of gt carried by rr."""
    return f"""j{tag} AS (SELECT series_id, x, g.y AS g, r.y AS r FROM {gt} g FULL JOIN {rr} r USING (series_id, x)),
{NEAREST.format(name='k' + tag, v='r', source='j' + tag)},
l{tag} AS (SELECT series_id, x, g, r, {BETWEEN} AS rv, min(CASE WHEN g IS NOT NULL THEN x END) OVER (PARTITION BY series_id) AS lo, max(CASE WHEN g IS NOT NULL THEN x END) OVER (PARTITION BY series_id) AS hi FROM k{tag} WHERE av IS NOT NULL OR bv IS NOT NULL),
m{tag} AS (SELECT series_id, x, rv, COALESCE(g, CASE WHEN lo IS NULL OR x < lo OR x > hi THEN r END) AS an FROM l{tag}),
n{tag} AS (SELECT series_id, x, rv, CASE WHEN an IS NULL THEN NULL WHEN rv = 0 THEN CASE WHEN an = 0 THEN 0.0 ELSE 1.0 END ELSE an / rv END AS ratio FROM m{tag}),
{NEAREST.format(name='o' + tag, v='ratio', source='n' + tag)},
z{tag} AS (SELECT series_id, x, rv * ({BETWEEN}) AS y FROM (SELECT *, count(ratio) OVER (PARTITION BY series_id) AS anchors FROM o{tag}) WHERE anchors > 1 AND av IS NOT NULL AND bv IS NOT NULL)"""


KM = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))))"
def fused_sql(gt_series: str, rr_series: str) -> str:
    """The oracle of the fusion. One neighbour a city at most: the relative cities lie further apart than twice the radius."""
    return f"""WITH pr AS (SELECT a.city_id AS series_id, b.city_id AS b_id FROM ({GT_CITIES}) a JOIN ({RR_CITIES}) b ON abs(a.lat - b.lat) < 0.1 AND {KM} < 5),
gts AS ({gt_series}), own AS (SELECT pr.series_id, s.x, s.y FROM pr JOIN ({rr_series}) s ON s.series_id = pr.b_id),
met AS (SELECT * FROM gts WHERE series_id IN (SELECT series_id FROM own)),
seg AS (SELECT series_id, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1, row_number() OVER w AS n, count(*) OVER (PARTITION BY series_id) AS m FROM own WINDOW w AS (PARTITION BY series_id ORDER BY x)),
pts AS (SELECT series_id, x, y, {VALUE} AS other FROM (SELECT a.series_id, a.x, a.y, s.x0, s.y0, s.x1, s.y1 FROM met a JOIN seg s ON s.series_id = a.series_id AND (m = 1 OR (x1 IS NOT NULL AND (n = 1 OR a.x >= x0) AND (n = m - 1 OR a.x < x1))))),
mean AS (SELECT series_id, x, CASE WHEN y > other AND other <> 0 THEN (y + other) / 2 ELSE y END AS y FROM pts),
{anchored('mean', 'own')}
SELECT series_id, x, CAST(floor(y + 0.5) AS DOUBLE) AS y FROM z UNION ALL SELECT series_id, x, CAST(y AS DOUBLE) FROM gts WHERE series_id NOT IN (SELECT series_id FROM own)"""


def spline_sql(samples: str, asked: str) -> str:
    """The oracle of the spline: the tridiagonal system solved down and up by recursion over the samples' numbers."""
    return f"""WITH RECURSIVE g AS (SELECT series_id, x, CAST(y AS DOUBLE) AS y, ln(CASE WHEN y > 0 THEN y ELSE 1e-6 END) AS l, row_number() OVER (PARTITION BY series_id ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM ({samples})),
d AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, CAST(lead(x) OVER w - x AS DOUBLE) AS h, (lead(l) OVER w - l) / (lead(x) OVER w - x) AS s FROM g WINDOW w AS (PARTITION BY series_id ORDER BY x)),
eqs AS (SELECT * FROM (SELECT series_id, i, n, lag(h) OVER w AS h0, h AS h1, 2 * (lag(h) OVER w + h) AS b, 6 * (s - lag(s) OVER w) AS r FROM d WINDOW w AS (PARTITION BY series_id ORDER BY x)) WHERE i BETWEEN 1 AND n - 2),
down AS (SELECT series_id, i, n, h1, b, r FROM eqs WHERE i = 1 UNION ALL SELECT q.series_id, q.i, q.n, q.h1, q.b - q.h0 / w.b * q.h0, q.r - q.h0 / w.b * w.r FROM down w JOIN eqs q ON q.series_id = w.series_id AND q.i = w.i + 1),
up AS (SELECT series_id, i, r / b AS m FROM down WHERE i = n - 2 UNION ALL SELECT w.series_id, w.i, (w.r - w.h1 * u.m) / w.b FROM up u JOIN down w ON w.series_id = u.series_id AND w.i = u.i - 1),
whole AS (SELECT d.*, COALESCE(a.m, 0) AS m0, COALESCE(c.m, 0) AS m1 FROM d LEFT JOIN up a ON a.series_id = d.series_id AND a.i = d.i LEFT JOIN up c ON c.series_id = d.series_id AND c.i = d.i + 1),
new AS (SELECT q.series_id, q.x, exp(l + (q.x - w.x) * (s - h * (2 * m0 + m1) / 6 + (q.x - w.x) * (m0 / 2 + (q.x - w.x) * (m1 - m0) / (6 * h)))) AS v, w.y, w.y1 FROM (SELECT DISTINCT series_id, x FROM ({asked})) q JOIN whole w ON w.series_id = q.series_id AND q.x > w.x AND q.x < w.x1),
curve AS (SELECT series_id, CAST(x AS INT) AS x, y FROM g UNION ALL SELECT series_id, CAST(x AS INT) AS x, least(greatest(v, least(y, y1)), greatest(y, y1)) AS y FROM new)"""


LAYERS = """WITH k AS (SELECT * FROM {cells} WHERE yr IN (1995, 1998, 2001)), pr AS (SELECT * FROM (VALUES (1996, 1995, 1998), (2002, 1998, 2001)) AS t(t, x0, x1)),
e AS (SELECT layer, t, x0, x1, idx, COALESCE(max(CASE WHEN yr = x0 THEN value END), 0) AS y0, COALESCE(max(CASE WHEN yr = x1 THEN value END), 0) AS y1 FROM k JOIN pr ON yr IN (x0, x1) GROUP BY layer, t, x0, x1, idx)
SELECT layer, t AS yr, idx, CAST(greatest(ceil(CASE WHEN y0 > 0 AND y1 > 0 AND t > x1 THEN y1 * exp(ln(y1 / y0) / (x1 - x0) * (t - x1)) ELSE y0 + (t - x0) * (y1 - y0) / (x1 - x0) END), 0) AS DOUBLE) AS value FROM e"""

ORACLES = {
    k: oracle(sql)
    for k, sql in {
        "spline_interpolate": spline_sql("SELECT * FROM {series_gt}", "SELECT * FROM {series_rr}") + " SELECT series_id, x, round(y, 6) AS y FROM curve",
        "lagrange_interpolate": "WITH t AS (SELECT DISTINCT series_id, x AS t FROM {series_rr}), f AS (SELECT t.series_id, t.t, o.x, any_value(o.y) AS y, COALESCE(product(CASE WHEN q.x <> o.x THEN (t.t - q.x)::DOUBLE / (o.x - q.x) END), 1) AS p FROM t JOIN {series_gt} o ON o.series_id = t.series_id JOIN {series_gt} q ON q.series_id = t.series_id GROUP BY t.series_id, t.t, o.x) SELECT series_id, t AS x, round(sum(y * p), 4) AS y FROM f GROUP BY series_id, t",
        "interpolate_gt": "WITH " + anchored("{series_gt}", "{series_rr}") + " SELECT series_id, x, round(y, 6) AS y FROM z",
        "expand_value": f"WITH f AS ({FLAT}), h AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM f WINDOW w AS (PARTITION BY series_id ORDER BY x)) SELECT series_id, x, y FROM f UNION SELECT series_id, px + 1, 0.0 FROM h WHERE y = 0 AND py <> 0 UNION SELECT series_id, nx - 1, 0.0 FROM h WHERE y = 0 AND ny <> 0",
        "trim_start": f"WITH f AS ({FLAT}) SELECT series_id, x, y FROM f JOIN (SELECT series_id, min(x) AS lo FROM f WHERE y <> 0 GROUP BY series_id) USING (series_id) WHERE x >= lo",
        "clamp_domain": "SELECT series_id, least(greatest(x, lo), hi) AS x, y FROM {series_rr} JOIN (SELECT series_id, min(x) AS lo, max(x) AS hi FROM {series_gt} GROUP BY series_id) USING (series_id)",
        "remove_zeroes": f"SELECT * FROM ({FLAT}) WHERE y <> 0",
        "clean": "SELECT p_partkey AS id, concat_ws('|', CASE WHEN p_partkey % 3 <> 0 THEN 'name' END, CASE WHEN p_size % 4 <> 0 THEN 'size' END) AS kept FROM {part}",
        "series_map": "SELECT series_id, x, round(sqrt(abs(y)) * 2 + pow(y, 2) / 100, 4) AS y FROM {series_rr}",
        "series_zip_expression": "SELECT series_id, x, COALESCE(a.y, 0) * 2 - COALESCE(b.y, 0) AS y FROM {series_gt} a FULL JOIN (SELECT series_id, x - 5 AS x, y FROM {series_rr}) b USING (series_id, x)",
        "series_zip_mul": "SELECT series_id, x, COALESCE(a.y, 0) * COALESCE(b.y, 0) AS y FROM {series_gt} a FULL JOIN (SELECT series_id, x - 5 AS x, y FROM {series_rr}) b USING (series_id, x)",
        "zip_arrays": "WITH a AS (SELECT series_id, y, row_number() OVER (PARTITION BY series_id ORDER BY y) AS n FROM {series_gt}), b AS (SELECT series_id, y, row_number() OVER (PARTITION BY series_id ORDER BY y) AS n FROM {series_rr}) SELECT series_id, string_agg(CAST(CAST(COALESCE(a.y, 0) - COALESCE(b.y, 0) AS BIGINT) AS VARCHAR), '|' ORDER BY n) AS difference FROM a FULL JOIN b USING (series_id, n) WHERE series_id IN (SELECT series_id FROM a) AND series_id IN (SELECT series_id FROM b) GROUP BY series_id",
        "range_extrema": "SELECT w, min(from_year) AS low, max(to_year) AS high, round(sum((from_year + to_year) / 2.0), 6)::DOUBLE AS total, round(avg((from_year + to_year) / 2.0), 6) AS mean FROM {features} GROUP BY w",
        "linear_extrapolate": BRACKET.replace(BRACKET[BRACKET.index("asked AS (") : BRACKET.index("seg AS")], f"asked AS ({OUTER}),\n").replace("FROM series_gt WINDOW", "FROM {series_gt} WINDOW") + f" SELECT series_id, x, round({VALUE}, 6) AS y FROM br",
        "interpolate_layers": LAYERS,
        "fuse_city_series": fused_sql(GT_SERIES, RR_SERIES),
    }.items()
}
