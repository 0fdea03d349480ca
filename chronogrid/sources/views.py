"""Grid, series and entity tables derived from the star-schema tables; the same statements serve Spark and the oracles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The rows and the columns that the growing grid's cells are crossed from.
FIELD_ROWS = "SELECT DISTINCT CAST(l_orderkey % side AS INT) AS r FROM {lineitem} CROSS JOIN {field_side}"
FIELD_COLUMNS = "SELECT DISTINCT CAST((l_orderkey + l_linenumber) % side AS INT) AS c FROM {lineitem} CROSS JOIN {field_side}"
#: Parts that the grid's rows are dealt to, for each core (for eight at least). A part writes a file for every partition that it is dealt
#: on to, so parts by the session's shuffle partitions would be their square in files.
FIELD_PARTS = 8

VIEWS = {
    "cells": "SELECT 'pop' AS layer, CAST(year(l_shipdate) AS INT) AS yr, CAST(l_suppkey % 40 AS INT) AS r, CAST(l_partkey % 50 AS INT) AS c, CAST((l_suppkey % 40) * 50 + (l_partkey % 50) AS BIGINT) AS idx, CAST(SUM(l_quantity) AS DOUBLE) AS value FROM {lineitem} GROUP BY year(l_shipdate), l_suppkey % 40, l_partkey % 50",
    "zones": "SELECT DISTINCT 'region' AS mask, CAST((l_suppkey % 40) * 50 + (l_partkey % 50) AS BIGINT) AS idx, CAST(floor((l_suppkey % 40) / 10.0) AS INT) AS zone FROM {lineitem} WHERE l_suppkey % 40 < 30",
    "control": "SELECT CAST(o_custkey % 3 AS INT) AS zone, CAST(year(o_orderdate) AS INT) AS yr, CAST(floor(SUM(o_totalprice) / 1000.0 + 0.5) AS DOUBLE) AS target FROM {orders} GROUP BY o_custkey % 3, year(o_orderdate)",
    "series_gt": "SELECT c_nationkey AS series_id, CAST((year(o_orderdate) - 1992) * 10 AS INT) AS x, CAST(COUNT(*) AS DOUBLE) AS y FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE year(o_orderdate) % 2 = 0 GROUP BY c_nationkey, year(o_orderdate)",
    "series_rr": "SELECT s_nationkey AS series_id, CAST((year(l_shipdate) - 1993) * 10 + 5 AS INT) AS x, CAST(COUNT(*) AS DOUBLE) AS y FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey GROUP BY s_nationkey, year(l_shipdate)",
    "cities_gt": "SELECT c_custkey AS city_id, c_nationkey AS series_id, CAST((c_custkey * 7919) % 16000 AS DOUBLE) / 100.0 - 80.0 AS lat, CAST((c_custkey * 104729) % 36000 AS DOUBLE) / 100.0 - 180.0 AS lng FROM {customer}",
    "cities_rr": "SELECT s_suppkey AS city_id, s_nationkey AS series_id, CAST((s_suppkey * 7919) % 16000 AS DOUBLE) / 100.0 - 80.0 + 0.01 AS lat, CAST((s_suppkey * 104729) % 36000 AS DOUBLE) / 100.0 - 180.0 + 0.01 AS lng FROM {supplier}",
    "features": "SELECT p_partkey AS feature_id, CAST((p_partkey * 37) % 45 AS INT) AS x0, CAST((p_partkey * 53) % 35 AS INT) AS y0, CAST(1 + p_size % 5 AS INT) AS w, CAST(1 + p_size % 4 AS INT) AS h, CAST(-500 + (p_partkey * 13) % 2000 AS INT) AS from_year, CAST(-500 + (p_partkey * 13) % 2000 + p_size * 10 AS INT) AS to_year FROM {part}",
    "entity_log": "SELECT user_id AS id, ts AS date, event_type AS k, CAST(value AS VARCHAR(32)) AS v, event_id AS seq FROM {events}",
    "edges": "SELECT c_nationkey AS src, s_nationkey AS dst, CAST(MIN(l_quantity) + c_nationkey % 7 AS DOUBLE) AS cost FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey WHERE c_nationkey < s_nationkey GROUP BY c_nationkey, s_nationkey",
    "coo_matrix": "SELECT CAST(l_suppkey % 20 AS INT) AS i, CAST(l_partkey % 20 AS INT) AS j, CAST(SUM(l_linenumber) AS DOUBLE) AS v FROM {lineitem} GROUP BY l_suppkey % 20, l_partkey % 20",
    # names carry the years of a mask; masks overlap in cells and years
    "mask_cells": "SELECT DISTINCT 'mask_' || CAST(1995 + idx % 4 AS VARCHAR(8)) || '_' || CAST(1997 + idx % 4 AS VARCHAR(8)) AS mask, idx FROM {cells} WHERE idx % 11 < 3",
    "kept_cells": "SELECT DISTINCT 'keep_1996_1999' AS mask, idx FROM {cells} WHERE idx % 22 = 0",
    "zone_dims": "SELECT zone, CAST(MIN(yr) + zone AS INT) AS first_year, CAST(MAX(yr) - 1 AS INT) AS last_year, CAST(1 AS DOUBLE) + CAST(zone AS DOUBLE) / 4 AS scalar FROM {control} GROUP BY zone",
    "area_cells": "SELECT idx, CAST(10 + idx % 7 AS DOUBLE) AS area FROM {cells} GROUP BY idx",
    "area_masks": "SELECT DISTINCT CASE WHEN idx % 3 = 0 THEN 'north' ELSE 'south' END AS mask, CASE WHEN idx % 2 = 0 THEN 'file_a' ELSE 'file_b' END AS file, idx FROM {cells} WHERE idx % 5 < 2",
    "vertices": "SELECT feature_id, seq, CAST(x0 + dx * w AS DOUBLE) + 0.25 AS x, CAST(y0 + dy * h AS DOUBLE) + 0.25 AS y FROM {features} CROSS JOIN (SELECT * FROM (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)) AS t(seq, dx, dy)) AS corners",
    # features of several parts and rings, each ring closed by its first vertex: a body, often with a hole, and by their number
    # an island and a speck that holds no cell's centre
    "shape_vertices": "SELECT feature_id, part, ring, seq, CAST(ax + dx * wx AS DOUBLE) AS x, CAST(ay + dy * wy AS DOUBLE) AS y FROM (SELECT feature_id, 0 AS part, 0 AS ring, x0 + 0.25 AS ax, y0 + 0.25 AS ay, CAST(w AS DOUBLE) AS wx, CAST(h AS DOUBLE) AS wy FROM {features} UNION ALL SELECT feature_id, 0 AS part, 1 AS ring, x0 + 1.25 AS ax, y0 + 1.25 AS ay, w - 2.0 AS wx, h - 2.0 AS wy FROM {features} WHERE w > 2 AND h > 2 UNION ALL SELECT feature_id, 1 AS part, 0 AS ring, x0 + 7.25 AS ax, y0 + 6.25 AS ay, 2.0 AS wx, 1.0 AS wy FROM {features} WHERE feature_id % 3 = 0 UNION ALL SELECT feature_id, 2 AS part, 0 AS ring, x0 + 3.625 AS ax, y0 - 1.375 AS ay, 0.25 AS wx, 0.125 AS wy FROM {features} WHERE feature_id % 5 = 0) AS boxes CROSS JOIN (SELECT * FROM (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0)) AS t(seq, dx, dy)) AS corners",
    # a grid of about as many cells as lineitem has rows, with classes of ragged borders, open cells and gaps
    "field_side": "SELECT CAST(floor(sqrt(COUNT(*))) AS BIGINT) AS side FROM {lineitem}",
    "field_cells": "SELECT r, c, CAST(CASE WHEN (r * 31 + c * 17) % 29 = 0 THEN -1 ELSE floor((r + (c * c) % 7) * 8.0 / side) * 10 + floor((c + (r * r) % 5) * 9.0 / side) END AS INT) AS zone FROM (" + FIELD_ROWS + ") AS a CROSS JOIN (" + FIELD_COLUMNS + ") AS b CROSS JOIN {field_side} WHERE (r * 7 + c * 13) % 37 <> 0",
    "field_values": "SELECT 'pop' AS layer, yr, r, c, CAST(r AS BIGINT) * 100000 + c AS idx, CAST((r * 31 + c * 17 + yr) % 89 + CASE WHEN (r * 13 + c * 7) % 211 = 0 THEN 4000 ELSE 0 END AS DOUBLE) AS value FROM {field_cells} CROSS JOIN (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS yr FROM {orders} WHERE year(o_orderdate) IN (1995, 1996)) AS years",
    "field_zones": "SELECT 'region' AS mask, CAST(r AS BIGINT) * 100000 + c AS idx, CAST(floor((r + (c * c) % 7) * 4.0 / side) AS INT) AS zone FROM {field_cells} CROSS JOIN {field_side} WHERE floor((r + (c * c) % 7) * 4.0 / side) < 3",
    # classes of several parts, and of blocks that touch at corners
    "island_cells": "SELECT r, c, CAST(CASE WHEN zone < 0 THEN zone ELSE zone % 3 END AS INT) AS zone FROM {class_cells}",
    "class_cells": "SELECT DISTINCT r, c, CAST(CASE WHEN idx % 9 = 0 THEN -1 WHEN idx % 31 = 0 THEN -2 ELSE floor(r / 8.0) * 10 + floor(c / 9.0) END AS INT) AS zone FROM {cells}",
}


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def names_in(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A statement over {views} and {base tables}."""
    return spark.sql(sql, **{n: view(spark, sf_dir, n) if n in VIEWS else base(spark, sf_dir, n) for n in names_in(sql)})


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return field_cells(spark, sf_dir) if name == "field_cells" else derive(spark, sf_dir, VIEWS[name])


def field_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view of that name, whose rows are dealt before they are crossed: they are so few that they come in one part otherwise,
    and one task would make the whole grid."""
    n = FIELD_PARTS * max(8, spark.sparkContext.defaultParallelism)
    # dealt by r itself, into so many parts as the session has, they would stay as DISTINCT left them: coalesced to one
    rows = derive(spark, sf_dir, FIELD_ROWS).repartition(n, F.xxhash64("r"))
    columns = F.broadcast(derive(spark, sf_dir, FIELD_COLUMNS))
    crossed = VIEWS["field_cells"].replace(f"({FIELD_ROWS})", "{rows}").replace(f"({FIELD_COLUMNS})", "{columns}")
    return spark.sql(crossed, rows=rows, columns=columns, field_side=F.broadcast(view(spark, sf_dir, "field_side")))


def plain(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def with_views(sql: str, *names: str) -> str:
    """sql after a WITH list of the named views, and those that they need, over the plain base tables."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for other in names_in(VIEWS[name]):
            if other in VIEWS:
                add(other)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        add(n)
    parts = ", ".join(f"{n} AS ({plain(VIEWS[n])})" for n in ordered)
    body = sql.strip()
    if not parts:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {parts}, {body[15:]}"
    return f"WITH {parts}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {parts} {body}"


def oracle(sql: str) -> str:
    """The oracle's form of a statement over {views} and {base tables}."""
    return with_views(plain(sql), *[n for n in names_in(sql) if n in VIEWS])
