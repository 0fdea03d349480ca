"""Queries of masks, domains, layers, cell sets and the way between polygons and cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronogrid.operators import layers, masks, polygons, regions, scaling, series
from chronogrid.sources.views import base, derive, oracle, view

HEIGHT, WIDTH = 40, 50
BAND_YEARS = [1995, 1996, 1998]


def _v(name):
    return lambda s, d: view(s, d, name)


cells, zones, control, dims, mask_cells, kept, areas, area_masks, classes, islands, field, vertices, shapes = map(
    _v, ("cells", "zones", "control", "zone_dims", "mask_cells", "kept_cells", "area_cells", "area_masks", "class_cells", "island_cells", "field_cells", "vertices", "shape_vertices")
)


def _on(sql):
    return lambda s, d: derive(s, d, sql)


def _round(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


YEARS = "(SELECT DISTINCT yr FROM {cells})"
#: Rows of a wide grid: a band a year for each cell.
BANDS = "SELECT idx, array(sum(CASE WHEN yr = 1995 THEN value END), sum(CASE WHEN yr = 1996 THEN value END), sum(CASE WHEN yr = 1998 THEN value END), sum(CASE WHEN yr = 1999 THEN value END)) AS bands FROM {cells} GROUP BY idx"
GRID = "SELECT yr AS layer, r, c, CASE WHEN idx % 13 = 0 THEN -9999.0 ELSE value / 7 END AS v FROM {cells}"
FLAGGED = "SELECT layer, yr, idx FROM {cells} WHERE idx % 5 = 1"
NEXT = "SELECT layer, yr + 1 AS yr, idx, value FROM {cells}"
PAIR = "SELECT yr, idx, value FROM {cells} WHERE idx % 4 <> 0", "SELECT yr, idx, value * 3 AS value FROM {cells} WHERE idx % 3 <> 0"
TARGETS = "SELECT 'north' AS mask, yr, sum(target) AS target FROM {control} GROUP BY yr UNION ALL SELECT 'south' AS mask, yr, sum(target) / 2 AS target FROM {control} WHERE yr > 1997 GROUP BY yr"
DENSITIES = "SELECT mask, CAST(count(*) % 7 + 1 AS DOUBLE) AS density, 1996 AS first_year, 1999 AS last_year FROM {area_masks} GROUP BY mask"
POINTS = "SELECT city_id, lng, lat, CAST(1985 + city_id % 20 AS INT) AS yr FROM {cities_gt}"
SETS = "SELECT idx FROM {cells} WHERE yr <= 1998 AND value > 100", "SELECT idx FROM {cells} WHERE yr >= 1997 AND value > 100"
LEFT = "SELECT DISTINCT idx, 'A' || CAST(idx % 3 AS VARCHAR(4)) AS source, CAST(idx % 5 AS VARCHAR(4)) AS p FROM {cells} WHERE idx % 4 <> 0"
RIGHT = "SELECT DISTINCT idx, 'B' || CAST(idx % 2 AS VARCHAR(4)) AS source, CAST(idx % 7 AS VARCHAR(4)) AS q FROM {cells} WHERE idx % 3 <> 0"
DIVISORS = "SELECT DISTINCT mask AS divisor, idx FROM {mask_cells}"
ROUGH = "SELECT c_custkey AS city_id, CAST((c_custkey * 37) % 400 AS DOUBLE) / 97 - 2 AS lng, CAST((c_custkey * 53) % 300 AS DOUBLE) / 91 - 1.5 AS lat FROM {customer}"
ESTIMATES = "SELECT 'gt' AS source, x, y FROM {series_gt} UNION ALL SELECT 'rr' AS source, x - 5 AS x, y - 60 AS y FROM {series_rr}"
POOLED = "SELECT series_id AS city, x, y FROM {series_gt} UNION ALL SELECT series_id AS city, x - 5 AS x, y FROM {series_rr}"


def _with_props(sql, name):
    return lambda s, d: derive(s, d, sql).select("idx", "source", F.create_map(F.lit(name), F.col(name), F.lit("side"), F.lit(name)).alias("props"))


_left, _right = _with_props(LEFT, "p"), _with_props(RIGHT, "q")


def _overlaid(df):
    return df.select("idx", "source", F.element_at("props", "p").alias("p"), F.element_at("props", "q").alias("q"), F.element_at("props", "side").alias("side"))


def _third(s, d):
    return cells(s, d).filter("yr = 1997").select("idx", F.lit("C").alias("source"), F.create_map(F.lit("side"), F.lit("c")).alias("props"))


def _point_cells(s, d):
    row, col = layers.lnglat_to_cell(F.col("lng"), F.col("lat"), 4320, 2160)
    lng, lat = layers.cell_to_lnglat(F.col("r"), F.col("c"), 4320, 2160)
    return _round(_on(POINTS)(s, d).select("city_id", row.alias("r"), col.alias("c")).select("*", lng.alias("cell_lng"), lat.alias("cell_lat")), "cell_lng", "cell_lat")


def _layer_years(s, d):
    """The layers' years, ascending; one row a layer and year in all."""
    return sorted(r["yr"] for r in cells(s, d).select("yr").distinct().collect())


def _channels(s, d):
    stored = cells(s, d).select("layer", "yr", "idx", "value", *layers.to_channels(F.col("value") * 70_000))
    return stored.select("*", layers.from_channels(*map(F.col, "rgba")).alias("read_back"))


def _geomean(sql, keys):
    return lambda s, d: _round(series.weighted_geomean(derive(s, d, sql), keys), "gmean")


QUERIES = {
    "active_masks": lambda s, d: masks.active_masks(mask_cells(s, d), cells(s, d)),
    "fill_from_fallback": lambda s, d: masks.fill_from_fallback(cells(s, d), _on(NEXT)(s, d), _on(FLAGGED)(s, d)),
    "layer_pair_mean": lambda s, d: masks.layer_pair_mean(_on(PAIR[0])(s, d), _on(PAIR[1])(s, d), (1995, 1998), (1997, 2000)),
    "scale_to_zones_domain": lambda s, d: masks.scale_to_zones_domain(cells(s, d), zones(s, d), control(s, d), dims(s, d)),
    "scale_excluding_masks": lambda s, d: masks.scale_excluding_masks(cells(s, d), zones(s, d), control(s, d), dims(s, d), mask_cells(s, d), kept(s, d)),
    "scale_sequential_masks": lambda s, d: masks.scale_sequential_masks(cells(s, d), area_masks(s, d), _on(TARGETS)(s, d), ["north", "south"]),
    "zonal_area": lambda s, d: masks.zonal_area(areas(s, d), area_masks(s, d)),
    "density_targets": lambda s, d: masks.density_targets(areas(s, d), area_masks(s, d), _on(DENSITIES)(s, d), cells(s, d)),
    "estimates_geomean": _geomean(ESTIMATES, ["x"]),
    "pool_duplicates": _geomean(POOLED, ["city", "x"]),
    "invert_fraction": lambda s, d: _round(scaling.invert_fraction(scaling.standardise_max(cells(s, d))), "value"),
    "ascii_grid_to_cells": lambda s, d: layers.ascii_grid_to_cells(_on(GRID)(s, d)),
    "ascii_grid_percentage": lambda s, d: layers.ascii_grid_to_cells(_on(GRID)(s, d), "percentage"),
    "explode_bands": lambda s, d: layers.explode_bands(_on(BANDS)(s, d), BAND_YEARS, 0.01),
    "explode_time_slices": lambda s, d: layers.explode_time_slices(_on(BANDS)(s, d).withColumn("bands", F.transform("bands", lambda x: F.when(x % 3 == 0, -9.0).otherwise(x))), slices="bands"),
    "write_cells": _channels,
    "nearest_year_layer": lambda s, d: layers.nearest_year_layer(_on(POINTS)(s, d), BAND_YEARS).select("city_id", "layer_year"),
    "sample_points": lambda s, d: layers.sample_points(layers.nearest_year_layer(_on(POINTS)(s, d), _layer_years(s, d)), cells(s, d), WIDTH, HEIGHT).select("city_id", "layer_year", "idx", "sampled"),
    "cell_to_lnglat": _point_cells,
    "cell_union": lambda s, d: layers.cell_union(*(_on(x)(s, d) for x in SETS)),
    "cell_difference": lambda s, d: layers.cell_difference(*(_on(x)(s, d) for x in SETS[::-1])),
    "cell_intersection": lambda s, d: layers.cell_intersection(*(_on(x)(s, d) for x in SETS)),
    "cell_overlay": lambda s, d: _overlaid(layers.cell_overlay(_left(s, d), _right(s, d), 150)),
    "province_overlay": lambda s, d: layers.province_overlay([_left(s, d), _right(s, d), _third(s, d)]).select("idx", "source", F.element_at("props", "side").alias("side")),
    "split_by_divisors": lambda s, d: layers.split_by_divisors(zones(s, d).withColumnRenamed("zone", "feature_id"), _on(DIVISORS)(s, d)),
    "nearest_seed_fill": lambda s, d: regions.nearest_seed_fill(classes(s, d), [-1], [-2]),
    "nearest_seed_fill_field": lambda s, d: regions.nearest_seed_fill(field(s, d), [-1], []),
    "region_edge_list": lambda s, d: regions.directed_edges(classes(s, d)),
    "cell_parts": lambda s, d: regions.cell_parts(islands(s, d)),
    "region_rings": lambda s, d: regions.region_rings(islands(s, d)),
    "interior_pole": lambda s, d: regions.interior_pole(classes(s, d), largest=False),
    "interior_pole_largest": lambda s, d: regions.interior_pole(islands(s, d)),
    "interior_pole_field": lambda s, d: regions.interior_pole(field(s, d), largest=False),
    "polygon_centroid": lambda s, d: _round(polygons.polygon_centroid(vertices(s, d)), "x", "y"),
    "centroid_of_parts": lambda s, d: _round(polygons.polygon_centroid(shapes(s, d)), "x", "y"),
    "rasterise_polygons": lambda s, d: polygons.rasterise_polygons(vertices(s, d), WIDTH, HEIGHT),
    "rasterise_rings": lambda s, d: polygons.rasterise_polygons(shapes(s, d), WIDTH, HEIGHT),
    "geometry_dedupe": lambda s, d: layers.geometry_dedupe(_on(ROUGH)(s, d), 1, ["city_id"]),
}

ACTIVE = """active AS (SELECT yr, mask FROM (SELECT DISTINCT mask FROM {0}) m JOIN (SELECT DISTINCT yr FROM {{cells}}) y
 ON yr BETWEEN CAST(regexp_extract(mask, '_(\\d+)_(\\d+)$', 1) AS INT) AND CAST(regexp_extract(mask, '_(\\d+)_(\\d+)$', 2) AS INT))"""
DOMAIN = """h AS (SELECT cells.layer, cells.yr, cells.idx, cells.value, z.zone, d.first_year, d.last_year, d.scalar AS per, {free} AS free FROM {{cells}} cells LEFT JOIN {{zones}} z ON z.idx = cells.idx LEFT JOIN {{zone_dims}} d ON d.zone = z.zone {join}),
t AS (SELECT layer, yr, zone, first_year, last_year, per, sum(CASE WHEN free AND value > 0 THEN value END) AS total FROM h WHERE zone IS NOT NULL GROUP BY ALL),
s AS (SELECT t.layer, t.yr, t.zone, CASE WHEN t.yr BETWEEN first_year AND last_year AND total > 0 THEN COALESCE(target, 0.0) * per / total ELSE 1.0 END AS scalar FROM t LEFT JOIN {{control}} k ON k.zone = t.zone AND k.yr = t.yr)
SELECT h.layer, h.yr, h.idx, CASE WHEN free AND scalar IS NOT NULL AND value <> 0 THEN CAST(ceil(value * scalar) AS DOUBLE) ELSE value END AS value FROM h LEFT JOIN s ON s.layer = h.layer AND s.yr = h.yr AND s.zone = h.zone"""
UNDER = "SELECT DISTINCT yr, idx FROM {0} JOIN {1} USING (mask)"
GEO = "CASE WHEN count(CASE WHEN y {0} 0 THEN 1 END) = 0 THEN 0 ELSE count(CASE WHEN y {0} 0 THEN 1 END) / count(y)::DOUBLE * exp(avg(CASE WHEN y {0} 0 THEN ln(abs(y)) END)) END"
GMEAN = f"round({GEO.format('>')} - {GEO.format('<')}, 6) AS gmean"
UNIT = {n: f"CAST(floor(whole / {256 ** (3 - i)}) AS BIGINT) % 256" for i, n in enumerate("rgba")}
CELL = "CAST(least({h} - floor((lat + 90) / 180 * {h}), {h} - 1) AS INT) AS r, CAST(least(floor((lng + 180) / 360 * {w}), {w} - 1) AS INT) AS c"
SCALED = """{mask} AS (SELECT {prev}.layer, {prev}.yr, {prev}.idx, CASE WHEN i.idx IS NOT NULL AND s.scalar IS NOT NULL THEN CAST(ceil(value * s.scalar) AS DOUBLE) ELSE value END AS value FROM {prev}
 LEFT JOIN (SELECT DISTINCT idx FROM {{area_masks}} WHERE mask = '{mask}') i USING (idx)
 LEFT JOIN (SELECT a.layer, a.yr, target / total AS scalar FROM (SELECT layer, yr, max(total) AS total FROM (SELECT layer, yr, file, sum(value) AS total FROM {prev} JOIN {{area_masks}} m USING (idx) WHERE m.mask = '{mask}' GROUP BY layer, yr, file) GROUP BY layer, yr) a JOIN targets USING (yr) WHERE targets.mask = '{mask}' AND target <> 0 AND total > 0) s ON s.layer = {prev}.layer AND s.yr = {prev}.yr)"""
OVER = "WITH a AS (" + LEFT + "), b AS (" + RIGHT + "), o AS (SELECT COALESCE(a.idx, b.idx) AS idx, concat_ws(',', a.source, b.source) AS source, p, q, CASE WHEN b.idx IS NOT NULL THEN 'q' ELSE 'p' END AS side FROM a FULL JOIN b USING (idx)) "
NEAR = "SELECT b.r, b.c, arg_min(s.zone, ((b.r - s.r) * (b.r - s.r) + (b.c - s.c) * (b.c - s.c)) * 1000000::BIGINT + s.r * 1000 + s.c) AS zone FROM {class_cells} b, {class_cells} s WHERE b.zone = -1 AND s.zone NOT IN (-1, -2) GROUP BY b.r, b.c"
SIDES = "(SELECT * FROM (VALUES " + ", ".join(f"({i}, {j}, {', '.join(map(str, e))})" for i, j, e in regions.SIDES) + ") AS t(i, j, a, b, p, q))"
EDGES = f"SELECT z.zone, z.c + d.a AS x1, z.r + d.b AS y1, z.c + d.p AS x2, z.r + d.q AS y2, z.r, z.c FROM {{class_cells}} z CROSS JOIN {SIDES} d LEFT JOIN {{class_cells}} o ON o.r = z.r + d.i AND o.c = z.c + d.j WHERE o.zone IS NULL OR o.zone <> z.zone"
FIELD_NEAR = NEAR.replace("class_cells", "field_cells").replace("(-1, -2)", "(-1)").replace("1000000::BIGINT", "1000000000::BIGINT").replace("* 1000 +", "* 10000 +")
FIELD_EDGES = EDGES.replace("class_cells", "field_cells")
POLE = "WITH b AS (SELECT DISTINCT zone, r, c FROM ({edges})), f AS (SELECT a.zone, a.r, a.c, min((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)) AS d2 FROM {cells} a JOIN b USING (zone) GROUP BY a.zone, a.r, a.c) SELECT zone, r, c, CAST(d2 AS BIGINT) AS d2 FROM f QUALIFY row_number() OVER (PARTITION BY zone ORDER BY d2 DESC, r, c) = 1"
#: Every cell with each cell that it hangs together with, and so with the first of them.
PARTS = """reach(zone, r, c, ar, ac) AS (SELECT zone, r, c, r, c FROM {island_cells} UNION SELECT x.zone, o.r, o.c, x.ar, x.ac FROM reach x JOIN {island_cells} o ON o.zone = x.zone AND abs(o.r - x.r) + abs(o.c - x.c) = 1),
parts AS (SELECT zone, r, c, min(ar * 4294967296 + ac) AS part FROM reach GROUP BY zone, r, c)"""
RINGS = f"""sides AS (SELECT p.zone, p.part, p.c + d.a AS x, p.r + d.b AS y, d.p - d.a AS dx, d.q - d.b AS dy FROM parts p CROSS JOIN {SIDES} d LEFT JOIN parts o ON o.r = p.r + d.i AND o.c = p.c + d.j WHERE o.zone IS NULL OR o.zone <> p.zone),
turned AS (SELECT *, CASE WHEN dx = 1 THEN 0 WHEN dy = 1 THEN 1 WHEN dx = -1 THEN 2 ELSE 3 END AS heading FROM sides),
named AS (SELECT *, (y * 1000 + x) * 4 + heading AS id FROM turned),
after AS (SELECT a.zone, a.part, a.id, arg_min(b.id, (b.heading - a.heading + 7) % 4) AS next FROM named a JOIN named b ON b.zone = a.zone AND b.part = a.part AND b.x = a.x + a.dx AND b.y = a.y + a.dy GROUP BY ALL),
walk(start, id, steps) AS (SELECT id, id, 0 FROM named UNION ALL SELECT w.start, s.next, steps + 1 FROM walk w JOIN after s ON s.id = w.id WHERE s.next > w.start),
lengths AS (SELECT w.start, max(steps) + 1 AS n FROM walk w GROUP BY w.start),
whole AS (SELECT l.* FROM lengths l JOIN walk w ON w.start = l.start AND w.steps = l.n - 1 JOIN after s ON s.id = w.id AND s.next = l.start),
points AS (SELECT n.zone, n.part, w.start, w.steps AS seq, n.x, n.y, n.x * (n.y + n.dy) - (n.x + n.dx) * n.y AS crossed, l.n FROM whole l JOIN walk w ON w.start = l.start JOIN named n ON n.id = w.id),
shapes AS (SELECT zone, part, start, sum(crossed) AS area FROM points GROUP BY zone, part, start),
numbers AS (SELECT zone, start, dense_rank() OVER (PARTITION BY zone ORDER BY part) - 1 AS part, row_number() OVER (PARTITION BY zone, part ORDER BY CASE WHEN area < 0 THEN 1 ELSE 0 END, start) - 1 AS ring FROM shapes),
closed AS (SELECT zone, start, seq, x, y FROM points UNION ALL SELECT zone, start, n AS seq, x, y FROM points WHERE seq = 0)
SELECT zone, CAST(part AS INT) AS part, CAST(ring AS INT) AS ring, CAST(seq AS INT) AS seq, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM closed JOIN numbers USING (zone, start)"""
LARGEST = "largest AS (SELECT zone, part FROM (SELECT zone, part, count(*) AS n FROM parts GROUP BY zone, part) QUALIFY row_number() OVER (PARTITION BY zone ORDER BY n DESC, part) = 1), own AS (SELECT zone, r, c FROM parts JOIN largest USING (zone, part)), b AS (SELECT DISTINCT zone, r, c FROM (" + EDGES.replace("class_cells", "island_cells") + "))"
BOXES = "SELECT feature_id, part, ring, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM {shape_vertices} GROUP BY feature_id, part, ring"
RECT = "SELECT feature_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM {vertices} GROUP BY feature_id"

ORACLES = {
    k: oracle(sql)
    for k, sql in {
        "active_masks": "WITH " + ACTIVE.format("{mask_cells}") + " SELECT yr, mask FROM active",
        "fill_from_fallback": f"SELECT a.layer, a.yr, a.idx, CASE WHEN f.idx IS NOT NULL THEN COALESCE(o.value, 0.0) ELSE a.value END AS value FROM {{cells}} a LEFT JOIN ({FLAGGED}) f USING (layer, yr, idx) LEFT JOIN ({NEXT}) o USING (layer, yr, idx)",
        "layer_pair_mean": f"SELECT * FROM (SELECT yr, idx, CASE WHEN yr BETWEEN 1997 AND 1998 THEN (COALESCE(a.value, 0) + COALESCE(b.value, 0)) / 2 WHEN yr BETWEEN 1995 AND 1998 THEN a.value WHEN yr BETWEEN 1997 AND 2000 THEN b.value END AS value FROM ({PAIR[0]}) a FULL JOIN ({PAIR[1]}) b USING (yr, idx)) WHERE value IS NOT NULL",
        "scale_to_zones_domain": "WITH " + DOMAIN.format(free="TRUE", join="").replace("{{", "{").replace("}}", "}"),
        "scale_excluding_masks": "WITH " + ACTIVE.format("{mask_cells}").replace("active AS", "a1 AS") + ", " + ACTIVE.format("{kept_cells}").replace("active AS", "a2 AS") + f", ex AS ({UNDER.format('a1', '{mask_cells}')} EXCEPT {UNDER.format('a2', '{kept_cells}')}), " + DOMAIN.format(free="ex.idx IS NULL", join="LEFT JOIN ex ON ex.yr = cells.yr AND ex.idx = cells.idx").replace("{{", "{").replace("}}", "}"),
        "scale_sequential_masks": f"WITH targets AS ({TARGETS}), start AS (SELECT layer, yr, idx, value FROM {{cells}}), " + SCALED.format(mask="north", prev="start") + ", " + SCALED.format(mask="south", prev="north") + " SELECT layer, yr, idx, value FROM south",
        "zonal_area": "SELECT mask, max(area) AS area FROM (SELECT mask, file, sum(area) AS area FROM {area_masks} JOIN {area_cells} USING (idx) GROUP BY mask, file) GROUP BY mask",
        "density_targets": f"SELECT d.mask, y.yr, a.area * d.density AS target FROM (SELECT mask, max(area) AS area FROM (SELECT mask, file, sum(area) AS area FROM {{area_masks}} JOIN {{area_cells}} USING (idx) GROUP BY mask, file) GROUP BY mask) a JOIN ({DENSITIES}) d USING (mask) JOIN {YEARS} y ON yr BETWEEN first_year AND last_year",
        "estimates_geomean": f"SELECT x, {GMEAN} FROM ({ESTIMATES}) GROUP BY x",
        "pool_duplicates": f"SELECT city, x, {GMEAN} FROM ({POOLED}) GROUP BY city, x",
        "invert_fraction": "SELECT layer, yr, idx, round(1 - CASE WHEN top = 0 THEN 0 ELSE value / top END, 6) AS value FROM (SELECT *, max(value) OVER (PARTITION BY layer, yr) AS top FROM {cells})",
        "ascii_grid_to_cells": f"SELECT layer, r, c, CAST(ceil(v) AS DOUBLE) AS value FROM ({GRID}) WHERE v <> -9999",
        "ascii_grid_percentage": f"SELECT layer, r, c, CAST(CASE WHEN top > 0 THEN least(floor(v / top * 255 + 0.5), 255) ELSE 0 END AS DOUBLE) AS value FROM (SELECT *, max(v) OVER (PARTITION BY layer) AS top FROM ({GRID}) WHERE v <> -9999)",
        "explode_bands": "SELECT idx, yr, CAST(ceil(sum(value) * 0.01::DOUBLE) AS DOUBLE) AS value FROM {cells} WHERE yr IN (1995, 1996, 1998) GROUP BY idx, yr",
        "explode_time_slices": "SELECT idx, CAST(CASE yr WHEN 1995 THEN 1990 WHEN 1996 THEN 1991 WHEN 1998 THEN 1992 ELSE 1993 END AS INT) AS yr, value FROM {cells} WHERE yr IN (1995, 1996, 1998, 1999) AND value % 3 <> 0",
        "write_cells": f"SELECT layer, yr, idx, value, {', '.join(f'CAST({v} AS INT) AS {k}' for k, v in UNIT.items())}, whole AS read_back FROM (SELECT *, least(floor(value * 70000 + 0.5), 4294967295.0::DOUBLE) AS whole FROM {{cells}})",
        "nearest_year_layer": "SELECT city_id, CASE WHEN yr <= 1995 THEN 1995 WHEN yr <= 1997 THEN 1996 ELSE 1998 END AS layer_year FROM (" + POINTS + ")",
        "sample_points": f"WITH p AS (SELECT city_id, yr, {CELL.format(h=HEIGHT, w=WIDTH)} FROM ({POINTS})), ys AS (SELECT DISTINCT yr AS ly FROM {{cells}}), n AS (SELECT city_id, r, c, CAST(arg_min(ly, abs(ly - yr) * 10000 + ly) AS INT) AS layer_year FROM p CROSS JOIN ys GROUP BY city_id, r, c) SELECT city_id, layer_year, CAST(n.r * {WIDTH} + n.c AS BIGINT) AS idx, COALESCE(v.value, 0.0) AS sampled FROM n LEFT JOIN {{cells}} v ON v.yr = layer_year AND v.idx = n.r * {WIDTH} + n.c",
        "cell_to_lnglat": f"SELECT city_id, r, c, round(c / 4320.0::DOUBLE * 360 - 180, 6) AS cell_lng, round(90 - r / 2160.0::DOUBLE * 180, 6) AS cell_lat FROM (SELECT city_id, {CELL.format(h=2160, w=4320)} FROM ({POINTS}))",
        "cell_union": f"{SETS[0]} UNION {SETS[1]}",
        "cell_difference": f"{SETS[1]} EXCEPT {SETS[0]}",
        "cell_intersection": f"{SETS[0]} INTERSECT {SETS[1]}",
        "cell_overlay": OVER + "SELECT idx, source, p, q, side FROM o QUALIFY count(*) OVER (PARTITION BY source) >= 150",
        "province_overlay": OVER + "SELECT COALESCE(o.idx, x.idx) AS idx, concat_ws(',', o.source, x.source) AS source, CASE WHEN x.idx IS NOT NULL THEN 'c' ELSE side END AS side FROM o FULL JOIN (SELECT idx, 'C' AS source FROM {cells} WHERE yr = 1997) x USING (idx)",
        "split_by_divisors": f"SELECT z.zone AS feature_id, COALESCE(p.piece, '') AS piece, z.idx FROM (SELECT DISTINCT zone, idx FROM {{zones}}) z LEFT JOIN (SELECT idx, string_agg(DISTINCT divisor, '+' ORDER BY divisor) AS piece FROM ({DIVISORS}) GROUP BY idx) p USING (idx)",
        "nearest_seed_fill": f"SELECT a.r, a.c, COALESCE(n.zone, a.zone) AS zone FROM {{class_cells}} a LEFT JOIN ({NEAR}) n USING (r, c)",
        "region_edge_list": f"SELECT zone, x1, y1, x2, y2 FROM ({EDGES})",
        "interior_pole": f"WITH b AS (SELECT DISTINCT zone, r, c FROM ({EDGES})), f AS (SELECT a.zone, a.r, a.c, min((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)) AS d2 FROM {{class_cells}} a JOIN b USING (zone) GROUP BY a.zone, a.r, a.c) SELECT zone, r, c, CAST(d2 AS BIGINT) AS d2 FROM f QUALIFY row_number() OVER (PARTITION BY zone ORDER BY d2 DESC, r, c) = 1",
        "polygon_centroid": f"SELECT feature_id, round((x0 + x1) / 2, 6) AS x, round((y0 + y1) / 2, 6) AS y FROM ({RECT})",
        "rasterise_polygons": f"SELECT CAST({HEIGHT - 1} - y AS INT) AS r, CAST(x AS INT) AS c, max(feature_id) AS feature_id FROM ({RECT}) f JOIN (SELECT unnest(range({WIDTH})) AS x) ON x + 0.5 >= x0 AND x + 0.5 < x1 JOIN (SELECT unnest(range({HEIGHT})) AS y) ON y + 0.5 >= y0 AND y + 0.5 < y1 GROUP BY 1, 2",
        "nearest_seed_fill_field": f"SELECT a.r, a.c, COALESCE(n.zone, a.zone) AS zone FROM {{field_cells}} a LEFT JOIN ({FIELD_NEAR}) n USING (r, c)",
        "interior_pole_field": POLE.replace("{edges}", FIELD_EDGES).replace("{cells}", "{field_cells}"),
        "cell_parts": "WITH RECURSIVE " + PARTS + " SELECT r, c, zone, part FROM parts",
        "region_rings": "WITH RECURSIVE " + PARTS + ", " + RINGS,
        "interior_pole_largest": "WITH RECURSIVE " + PARTS + ", " + LARGEST + ", f AS (SELECT a.zone, a.r, a.c, min((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)) AS d2 FROM own a JOIN b USING (zone) GROUP BY a.zone, a.r, a.c) SELECT zone, r, c, CAST(d2 AS BIGINT) AS d2 FROM f QUALIFY row_number() OVER (PARTITION BY zone ORDER BY d2 DESC, r, c) = 1",
        "centroid_of_parts": f"SELECT feature_id, round(avg((x0 + x1) / 2), 6) AS x, round(avg((y0 + y1) / 2), 6) AS y FROM ({BOXES}) WHERE ring = 0 GROUP BY feature_id",
        "rasterise_rings": f"WITH boxes AS ({BOXES}), hit AS (SELECT feature_id, part, x, y FROM boxes JOIN (SELECT unnest(range({WIDTH})) AS x) ON x + 0.5 >= x0 AND x + 0.5 < x1 JOIN (SELECT unnest(range({HEIGHT})) AS y) ON y + 0.5 >= y0 AND y + 0.5 < y1), speck AS (SELECT feature_id, floor((x0 + x1) / 2) AS x, floor((y0 + y1) / 2) AS y FROM boxes ANTI JOIN hit USING (feature_id, part) WHERE ring = 0 AND (x0 + x1) / 2 >= 0 AND (x0 + x1) / 2 < {WIDTH} AND (y0 + y1) / 2 >= 0 AND (y0 + y1) / 2 < {HEIGHT}) SELECT CAST({HEIGHT - 1} - y AS INT) AS r, CAST(x AS INT) AS c, max(feature_id) AS feature_id FROM (SELECT feature_id, x, y FROM hit UNION ALL SELECT feature_id, x, y FROM speck) GROUP BY 1, 2",
        "geometry_dedupe": f"SELECT city_id, lng, lat FROM ({ROUGH}) QUALIFY row_number() OVER (PARTITION BY trunc(lng * 10), trunc(lat * 10) ORDER BY city_id) = 1",
    }.items()
}
