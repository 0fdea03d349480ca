"""Grid queries: scaling to control totals, sums, neighbourhoods."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from chronogrid.operators import raster, scaling
from chronogrid.sources.views import view, with_views

#: The grid reaches to the last cell.
LAST_ROW, LAST_COLUMN = "(SELECT max(r) FROM cells)", "(SELECT max(c) FROM cells)"
SUMS = """zs AS (SELECT layer, yr, zone, SUM(value) AS total, COUNT(*) AS n_cells FROM cells JOIN zones USING (idx) GROUP BY layer, yr, zone),
sc AS (SELECT zs.layer, zs.yr, zs.zone, CASE WHEN target IS NULL THEN NULL WHEN total = 0 THEN 1.0 ELSE target / total END AS scalar
       FROM zs LEFT JOIN control USING (zone, yr))"""
SCALED = f"WITH {SUMS} SELECT cells.layer, cells.yr, cells.idx, zones.zone, {{value}} AS value FROM cells LEFT JOIN zones ON cells.idx = zones.idx LEFT JOIN sc ON sc.layer = cells.layer AND sc.yr = cells.yr AND sc.zone = zones.zone"
TOTALS = "WITH totals AS (SELECT yr, SUM(target) AS target FROM control GROUP BY yr), ls AS (SELECT layer, yr, SUM(value) AS total, MAX(value) AS top FROM cells GROUP BY layer, yr) "
AROUND = f"""WITH d AS (SELECT * FROM (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) AS t(i, j)),
nm AS (SELECT a.layer, a.yr, a.r, a.c, a.value, SUM(COALESCE(b.value, 0)) / COUNT(*) AS neighbour_mean FROM cells a JOIN d ON a.r + d.i BETWEEN 0 AND {LAST_ROW} AND a.c + d.j BETWEEN 0 AND {LAST_COLUMN}
 LEFT JOIN cells b ON b.layer = a.layer AND b.yr = a.yr AND b.r = a.r + d.i AND b.c = a.c + d.j GROUP BY a.layer, a.yr, a.r, a.c, a.value)"""
IS_OUTLIER = f"r BETWEEN 1 AND {LAST_ROW} - 1 AND c BETWEEN 1 AND {LAST_COLUMN} - 1 AND neighbour_mean > 0 AND value > 2 * neighbour_mean"
ZONED = "SELECT DISTINCT r, c, zone FROM cells JOIN zones USING (idx)"


def _cells(spark, sf):
    return view(spark, sf, "cells")


def _zones(spark, sf):
    return view(spark, sf, "zones")


def _control(spark, sf):
    return view(spark, sf, "control")


def _totals(spark, sf):
    return _control(spark, sf).groupBy("yr").agg(F.sum("target").alias("target"))


def _three(spark, sf):
    return _cells(spark, sf), _zones(spark, sf), _control(spark, sf)


def _rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def _fallback(spark, sf):
    """The layer of the year before, as another source for the same cells."""
    return _cells(spark, sf).withColumn("yr", F.col("yr") + 1)


def _field(spark, sf):
    """A grid that grows with the tables, its zones and the control totals."""
    return view(spark, sf, "field_values"), view(spark, sf, "field_zones"), _control(spark, sf)


QUERIES = {
    "scale_to_zones_field": lambda s, d: scaling.scale_to_zones(*_field(s, d)),
    "scale_to_global_field": lambda s, d: scaling.scale_to_global(_field(s, d)[0], _totals(s, d)),
    "zonal_stats_field": lambda s, d: scaling.zonal_stats(*_field(s, d)[:2]),
    "neighbour_mean_field": lambda s, d: _rounded(raster.neighbour_mean(_field(s, d)[0]), "neighbour_mean"),
    "replace_outliers_field": lambda s, d: raster.replace_outliers(_field(s, d)[0], _field(s, d)[0].withColumn("yr", F.col("yr") + 1), k=8.0),
    "scale_to_zones": lambda s, d: scaling.scale_to_zones(*_three(s, d)),
    "scale_to_zones_exclusive": lambda s, d: _rounded(scaling.scale_to_zones_exclusive(*_three(s, d)), "value"),
    "scale_to_global": lambda s, d: scaling.scale_to_global(_cells(s, d), _totals(s, d)),
    "distribute_total": lambda s, d: _rounded(scaling.distribute_total(_cells(s, d), _totals(s, d)), "value"),
    "standardise_max": lambda s, d: _rounded(scaling.standardise_max(_cells(s, d)), "value"),
    "layer_sum": lambda s, d: scaling.layer_sum(_cells(s, d)),
    "zonal_stats": lambda s, d: scaling.zonal_stats(_cells(s, d), _zones(s, d)),
    "zone_assign": lambda s, d: scaling.zone_assign(_cells(s, d), _zones(s, d)).select("layer", "yr", "idx", "zone", "value"),
    "conservation_check": lambda s, d: scaling.conservation_check(_cells(s, d), scaling.scale_to_zones(*_three(s, d))),
    "neighbour_mean": lambda s, d: _rounded(raster.neighbour_mean(_cells(s, d)), "neighbour_mean"),
    "detect_outliers": lambda s, d: _rounded(raster.detect_outliers(_cells(s, d), k=2.0), "neighbour_mean"),
    "replace_outliers": lambda s, d: raster.replace_outliers(_cells(s, d), _fallback(s, d), k=2.0),
    "replace_outliers_masked": lambda s, d: raster.replace_outliers(_cells(s, d), _fallback(s, d), k=2.0, masked=_cells(s, d).filter("yr % 2 = 0 and idx % 17 = 0")),
    "pixel_centroid": lambda s, d: _rounded(raster.pixel_centroid(_cells(s, d), _zones(s, d)), "x", "y"),
    "region_edges": lambda s, d: raster.region_edges(_cells(s, d).join(_zones(s, d), "idx").select("r", "c", "zone").distinct()),
}

ALL = ("cells", "zones", "control")


def on_field(sql: str) -> str:
    """A statement over cells and zones, over the grid that grows."""
    return with_views(re.sub(r"\bzones\b", "field_zones", re.sub(r"\bcells\b", "field_values", sql)), "field_values", "field_zones", "control")


ORACLES = {
    "scale_to_zones_field": on_field(SCALED.format(value="COALESCE(CAST(ceil(value * scalar) AS DOUBLE), value)")),
    "scale_to_global_field": on_field(TOTALS + "SELECT layer, yr, idx, CASE WHEN target IS NULL THEN value ELSE CAST(ceil(value * CASE WHEN total = 0 THEN 1.0 ELSE target / total END) AS DOUBLE) END AS value FROM cells JOIN ls USING (layer, yr) LEFT JOIN totals USING (yr)"),
    "zonal_stats_field": on_field("SELECT layer, yr, zone, SUM(value) AS total, COUNT(*) AS n_cells FROM cells JOIN zones USING (idx) GROUP BY layer, yr, zone"),
    "neighbour_mean_field": on_field(AROUND + " SELECT layer, yr, r, c, value, round(neighbour_mean, 6) AS neighbour_mean FROM nm"),
    "replace_outliers_field": on_field(AROUND + f", bad AS (SELECT layer, yr, r, c FROM nm WHERE {IS_OUTLIER.replace('2 * neighbour', '8 * neighbour')}) SELECT nm.layer, nm.yr, nm.r, nm.c, CASE WHEN bad.r IS NOT NULL THEN COALESCE(f.value, 0.0) ELSE nm.value END AS value FROM nm LEFT JOIN bad USING (layer, yr, r, c) LEFT JOIN cells f ON f.layer = nm.layer AND f.yr + 1 = nm.yr AND f.r = nm.r AND f.c = nm.c"),
    "scale_to_zones": with_views(SCALED.format(value="COALESCE(CAST(ceil(value * scalar) AS DOUBLE), value)"), *ALL),
    "scale_to_zones_exclusive": with_views(
        "WITH all_cells AS (" + SCALED.format(value="round(CASE WHEN zones.zone IS NULL THEN 0.0 ELSE value * COALESCE(scalar, 1.0) END, 6)") + ") SELECT layer, yr, idx, value FROM all_cells", *ALL
    ),
    "scale_to_global": with_views(TOTALS + "SELECT layer, yr, idx, CASE WHEN target IS NULL THEN value ELSE CAST(ceil(value * CASE WHEN total = 0 THEN 1.0 ELSE target / total END) AS DOUBLE) END AS value FROM cells JOIN ls USING (layer, yr) LEFT JOIN totals USING (yr)", "cells", "control"),
    "distribute_total": with_views(TOTALS + "SELECT layer, yr, idx, round(value * CASE WHEN total = 0 THEN 0.0 ELSE target / total END, 6) AS value FROM cells JOIN ls USING (layer, yr) JOIN totals USING (yr)", "cells", "control"),
    "standardise_max": with_views(TOTALS + "SELECT layer, yr, idx, round(CASE WHEN top = 0 THEN 0.0 ELSE value / top END, 6) AS value FROM cells JOIN ls USING (layer, yr)", "cells", "control"),
    "layer_sum": with_views("SELECT layer, yr, SUM(value) AS total FROM cells GROUP BY layer, yr", "cells"),
    "zonal_stats": with_views("SELECT layer, yr, zone, SUM(value) AS total, COUNT(*) AS n_cells FROM cells JOIN zones USING (idx) GROUP BY layer, yr, zone", "cells", "zones"),
    "zone_assign": with_views("SELECT layer, yr, cells.idx, zone, value FROM cells LEFT JOIN zones ON cells.idx = zones.idx", "cells", "zones"),
    "conservation_check": with_views(
        "WITH out_cells AS (" + SCALED.format(value="COALESCE(CAST(ceil(value * scalar) AS DOUBLE), value)") + "), b AS (SELECT layer, yr, SUM(value) AS t FROM cells GROUP BY layer, yr), a AS (SELECT layer, yr, SUM(value) AS t FROM out_cells GROUP BY layer, yr) SELECT layer, yr, b.t AS total_before, a.t AS total_after, a.t - b.t AS change FROM b JOIN a USING (layer, yr)", *ALL
    ),
    "neighbour_mean": with_views(AROUND + " SELECT layer, yr, r, c, value, round(neighbour_mean, 6) AS neighbour_mean FROM nm", "cells"),
    "detect_outliers": with_views(AROUND + f" SELECT layer, yr, r, c, value, round(neighbour_mean, 6) AS neighbour_mean FROM nm WHERE {IS_OUTLIER}", "cells"),
    "replace_outliers": with_views(AROUND + f", bad AS (SELECT layer, yr, r, c FROM nm WHERE {IS_OUTLIER}) SELECT nm.layer, nm.yr, nm.r, nm.c, CASE WHEN bad.r IS NOT NULL THEN COALESCE(f.value, 0.0) ELSE nm.value END AS value FROM nm LEFT JOIN bad USING (layer, yr, r, c) LEFT JOIN cells f ON f.layer = nm.layer AND f.yr + 1 = nm.yr AND f.r = nm.r AND f.c = nm.c", "cells"),
    "replace_outliers_masked": with_views(AROUND + f", bad AS (SELECT layer, yr, r, c FROM nm WHERE {IS_OUTLIER}) SELECT nm.layer, nm.yr, nm.r, nm.c, CASE WHEN bad.r IS NOT NULL OR (nm.yr % 2 = 0 AND (nm.r * 50 + nm.c) % 17 = 0) THEN COALESCE(f.value, 0.0) ELSE nm.value END AS value FROM nm LEFT JOIN bad USING (layer, yr, r, c) LEFT JOIN cells f ON f.layer = nm.layer AND f.yr + 1 = nm.yr AND f.r = nm.r AND f.c = nm.c", "cells"),
    "pixel_centroid": with_views(f"SELECT zone, round(avg(c), 6) AS x, round(avg(r), 6) AS y FROM ({ZONED}) GROUP BY zone", "cells", "zones"),
    "region_edges": with_views(f"WITH z AS ({ZONED}), d AS (SELECT * FROM (VALUES (-1,0),(1,0),(0,-1),(0,1)) AS t(i, j)) SELECT z.zone, COUNT(*) AS n_edges FROM z CROSS JOIN d LEFT JOIN z o ON o.r = z.r + d.i AND o.c = z.c + d.j WHERE o.zone IS NULL OR o.zone <> z.zone GROUP BY z.zone", "cells", "zones"),
}
