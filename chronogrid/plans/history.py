"""Series and entity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronogrid.operators import entities, series
from chronogrid.sources.views import view, with_views

ASOF = "2024-01-15 00:00:00"
YEARS = [-400, 0, 500, 1000, 1500]


def _v(name):
    return lambda s, d: view(s, d, name)


gt, rr, cells, log, features, cities_gt, cities_rr = (_v(n) for n in ("series_gt", "series_rr", "cells", "entity_log", "features", "cities_gt", "cities_rr"))
#: The relative series' years, asked of the truth series.
ASKED = "SELECT DISTINCT g.series_id, r.x FROM (SELECT DISTINCT series_id FROM series_gt) g JOIN series_rr r USING (series_id)"
#: The relative series less its mean: values of both signs.
SIGNED = "SELECT series_id, x, y - floor(avg(y) OVER (PARTITION BY series_id)) AS y FROM series_rr"
BRACKET = f"""WITH asked AS ({ASKED}),
seg AS (SELECT series_id, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lag(x) OVER w AS px, row_number() OVER w AS n, count(*) OVER (PARTITION BY series_id) AS m FROM series_gt WINDOW w AS (PARTITION BY series_id ORDER BY x)),
br AS (SELECT a.series_id, a.x, s.x0, s.y0, s.x1, s.y1 FROM asked a JOIN seg s ON s.series_id = a.series_id
 AND (m = 1 OR (x1 IS NOT NULL AND (n = 1 OR a.x >= x0) AND (n = m - 1 OR a.x < x1))))"""


def _asked(s, d):
    return gt(s, d).select("series_id").distinct().join(rr(s, d).select("series_id", "x").distinct(), "series_id")


def _signed(s, d):
    from pyspark.sql import Window

    return rr(s, d).select("series_id", "x", (F.col("y") - F.floor(F.avg("y").over(Window.partitionBy("series_id")))).alias("y"))


def _even_x(s, d):
    """The truth series where the relative series' value is zero at both ends: flat runs to trim."""
    return rr(s, d).select("series_id", "x", (F.floor(F.col("y") / 100) % 3).cast("double").alias("y"))


def _round(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


FLAT = "SELECT series_id, x, CAST(CAST(floor(y / 100) AS BIGINT) % 3 AS DOUBLE) AS y FROM series_rr"
GEO = "CASE WHEN count(CASE WHEN y {0} 0 THEN 1 END) = 0 THEN 0 ELSE count(CASE WHEN y {0} 0 THEN 1 END) / count(y)::DOUBLE * exp(avg(CASE WHEN y {0} 0 THEN ln(abs(y)) END)) END"
VALUE = """CASE WHEN x1 IS NULL THEN y0 WHEN y0 > 0 AND y1 > 0 AND x < x0 THEN y0 * exp(ln(y1 / y0) / (x1 - x0) * (x - x0))
 WHEN y0 > 0 AND y1 > 0 AND x > x1 THEN y1 * exp(ln(y1 / y0) / (x1 - x0) * (x - x1)) ELSE y0 + (x - x0) * (y1 - y0) / (x1 - x0) END"""
KM = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))))"

QUERIES = {
    "bracket_years": lambda s, d: series.bracket_years(gt(s, d), _asked(s, d)),
    "linear_interpolate": lambda s, d: _round(series.linear_interpolate(gt(s, d), _asked(s, d)), "y"),
    "carry_last_nonnegative": lambda s, d: series.carry_last_nonnegative(_signed(s, d)),
    "trim_value": lambda s, d: series.trim_value(_even_x(s, d), 0.0),
    "cut_after": lambda s, d: series.cut_after(rr(s, d), 25),
    "series_zip_add": lambda s, d: series.series_zip(gt(s, d), rr(s, d), "add"),
    "series_zip_div": lambda s, d: _round(series.series_zip(gt(s, d), rr(s, d).withColumn("x", F.col("x") - 5), "div"), "y"),
    "weighted_geomean": lambda s, d: _round(series.weighted_geomean(_signed(s, d), ["series_id"]), "gmean", digits=4),
    "resolve_forward": lambda s, d: entities.resolve_forward(log(s, d), ASOF),
    "asof_keyframe": lambda s, d: entities.asof_keyframe(log(s, d), ASOF),
    "negative_diff": lambda s, d: entities.negative_diff(log(s, d)),
    "active_intervals": lambda s, d: entities.active_intervals(features(s, d), YEARS),
    "radius_join": lambda s, d: _round(entities.radius_join(cities_gt(s, d), cities_rr(s, d), 5.0), "km", digits=4),
    "duplicate_coords": lambda s, d: entities.duplicate_coords(cities_gt(s, d), 0),
}

ORACLES = {
    "bracket_years": with_views(BRACKET + " SELECT series_id, x, x0, y0, x1, y1 FROM br", "series_gt", "series_rr"),
    "linear_interpolate": with_views(BRACKET + f" SELECT series_id, x, round({VALUE}, 6) AS y FROM br", "series_gt", "series_rr"),
    "carry_last_nonnegative": with_views(f"SELECT series_id, x, last_value(CASE WHEN y >= 0 THEN y END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY x ROWS UNBOUNDED PRECEDING) AS y FROM ({SIGNED})", "series_rr"),
    "trim_value": with_views(f"WITH f AS ({FLAT}), o AS (SELECT series_id, min(x) AS lo, max(x) AS hi FROM f WHERE y <> 0 GROUP BY series_id) SELECT f.series_id, x, y FROM f JOIN o ON f.series_id = o.series_id AND x BETWEEN lo AND hi", "series_rr"),
    "cut_after": with_views("SELECT series_id, x, y FROM series_rr WHERE x <= 25", "series_rr"),
    "series_zip_add": with_views("SELECT series_id, x, COALESCE(a.y, 0) + COALESCE(b.y, 0) AS y FROM series_gt a FULL JOIN series_rr b USING (series_id, x)", "series_gt", "series_rr"),
    "series_zip_div": with_views("SELECT series_id, x, round(CASE WHEN COALESCE(b.y, 0) = 0 THEN 0.0 ELSE COALESCE(a.y, 0) / b.y END, 6) AS y FROM series_gt a FULL JOIN (SELECT series_id, x - 5 AS x, y FROM series_rr) b USING (series_id, x)", "series_gt", "series_rr"),
    "weighted_geomean": with_views(f"SELECT series_id, round({GEO.format('>')} - {GEO.format('<')}, 4) AS gmean FROM ({SIGNED}) GROUP BY series_id", "series_rr"),
    "resolve_forward": with_views(f"SELECT id, k, v, date FROM entity_log WHERE date <= TIMESTAMP '{ASOF}' QUALIFY row_number() OVER (PARTITION BY id, k ORDER BY date DESC, seq DESC) = 1", "entity_log"),
    "asof_keyframe": with_views(f"SELECT id, date, seq, k, v FROM entity_log WHERE date <= TIMESTAMP '{ASOF}' QUALIFY row_number() OVER (PARTITION BY id ORDER BY date DESC, seq DESC) = 1", "entity_log"),
    "negative_diff": with_views("SELECT id, date, seq, k, was FROM (SELECT id, date, seq, k, v, lag(v) OVER (PARTITION BY id, k ORDER BY date, seq) AS was FROM entity_log) WHERE was IS DISTINCT FROM v", "entity_log"),
    "active_intervals": with_views(f"SELECT yr, feature_id FROM features JOIN (VALUES {', '.join(f'({y})' for y in YEARS)}) AS t(yr) ON yr BETWEEN from_year AND to_year", "features"),
    "radius_join": with_views(f"SELECT a.city_id AS a_id, b.city_id AS b_id, round({KM}, 4) AS km FROM cities_gt a JOIN cities_rr b ON {KM} < 5.0", "cities_gt", "cities_rr"),
    "duplicate_coords": with_views("WITH n AS (SELECT *, count(*) OVER (PARTITION BY round(lat, 0), round(lng, 0)) AS n FROM cities_gt) SELECT city_id, CASE WHEN n = 1 THEN lat END AS lat, CASE WHEN n = 1 THEN lng END AS lng FROM n", "cities_gt"),
}
