"""Queries of frames, sheets, lists and keyed records."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronogrid.operators import nested, tables
from chronogrid.sources.views import derive, oracle

A = "SELECT CAST(c_custkey AS INT) AS row_idx, c_acctbal AS balance, CAST(c_nationkey AS DOUBLE) AS nation FROM {customer}"
B = "SELECT CAST(p_partkey AS INT) AS row_idx, p_retailprice AS price, CAST(p_size AS DOUBLE) AS size FROM {part}"
HOLES = "SELECT CAST(c_custkey AS INT) AS row_idx, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS balance, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM {customer}"
VALUES = "SELECT CAST(p_partkey AS INT) AS row_idx, p_retailprice AS value FROM {part} WHERE p_partkey % 2 = 0"
SHEET = "SELECT 'sheet' || CAST(o_orderkey % 2 AS VARCHAR(2)) AS sheet, CAST(floor(o_orderkey / 20.0) AS INT) AS r, CAST(o_orderkey % 20 AS INT) AS c, CASE WHEN o_orderkey % 7 = 0 THEN '=A1' WHEN o_orderkey % 5 = 0 THEN o_orderstatus WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR(12)) END AS v FROM {orders}"
RAGGED = "SELECT CAST(p_partkey AS INT) AS row_idx, split(p_name, ' ') AS cells FROM {part}"
NESTED = "SELECT CAST(p_partkey AS INT) AS row_idx, array(split(p_name, ' '), split(p_type, ' ')) AS parts FROM {part}"
LISTS = "SELECT s_nationkey AS nation, s_suppkey AS row_no, s_name AS name, CAST(s_suppkey * 3 AS INT) AS code FROM {supplier}"
WIDE = "SELECT c_custkey AS city, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_nationkey AS VARCHAR(8)) END AS bc_500, CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE CAST(c_custkey AS VARCHAR(8)) END AS ad_100, CAST(c_custkey * 2 AS VARCHAR(8)) AS AD_1800, c_name AS other FROM {customer}"
SERIES_JSON = "SELECT '<\"z' || CAST(zone AS VARCHAR(4)) || '\":<\"population\":<\"' || CAST(yr AS VARCHAR(8)) || '\":' || CAST(CAST(target AS BIGINT) AS VARCHAR(20)) || ',\"x\":1,\"1900\":\"bad\">>>' AS json FROM {control}"
SUM_JSON = "SELECT '<\"a\":' || CAST(p_size AS VARCHAR(8)) || ',\"deep\":<\"a\":1,\"b' || CAST(p_size % 3 AS VARCHAR(2)) || '\":2>>' AS json FROM {part}"
HALF = "SELECT series_id, x, y FROM {series_gt} WHERE x <> 20", "SELECT series_id, x + 10 AS x, CASE WHEN x < 20 THEN y ELSE y * 2 END AS y FROM {series_gt}"
OLD = "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM {customer}"
NEW = "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice END AS balance FROM {part} WHERE p_partkey % 2 = 0"
JOBS = "SELECT c_nationkey AS worker, o_orderkey AS job_id, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'done' ELSE 'failed' END AS status, o_orderdate AS started, o_orderdate + INTERVAL 3 HOURS AS ended FROM {orders} JOIN {customer} ON o_custkey = c_custkey"


def _on(sql):
    return lambda s, d: derive(s, d, sql)


def _json(sql):
    """A statement whose texts have <> for braces."""
    return lambda s, d: derive(s, d, sql).select(F.translate("json", "<>", "{}").alias("json"))


def _round(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


EQUATIONS = {"total": "a$balance + b$price * 2", "share": "round(a$nation / (b$size + 1), 6)"}

QUERIES = {
    "operate_frames": lambda s, d: tables.operate_frames(_on(A)(s, d), _on(B)(s, d), EQUATIONS),
    "merge_frames": lambda s, d: tables.merge_frames(_on(A)(s, d), _on(B)(s, d), {"balance": "a$balance + b$price"}),
    "frame_to_long": lambda s, d: tables.frame_to_long(_on(HOLES)(s, d).withColumn("nation", F.col("row_idx") % 25), ["balance", "nation"]),
    "long_to_frame": lambda s, d: tables.long_to_frame(tables.frame_to_long(_on(A)(s, d), ["balance", "nation"]), ["balance", "nation"]),
    "frame_profile": lambda s, d: tables.frame_profile(_on(RAGGED)(s, d)),
    "select_row": lambda s, d: tables.select_row(_on(A)(s, d), 7),
    "set_row": lambda s, d: tables.set_row(_on(A)(s, d), 7, {"balance": 1.5}),
    "set_column": lambda s, d: tables.set_column(_on(HOLES)(s, d), "balance", _on(VALUES)(s, d)),
    "range_select": lambda s, d: tables.range_select(_on(SHEET)(s, d), "sheet1", (2, 9), (3, 8)),
    "range_series": lambda s, d: tables.range_series(_on(SHEET)(s, d), "sheet1", (2, 9), (3, 8)).withColumn("values", F.array_join("values", "|")),
    "coerce_cells": lambda s, d: tables.coerce_cells(_on(SHEET)(s, d)),
    "filter_elements": lambda s, d: tables.filter_elements(_on(A)(s, d), "nation", geq=3.0, not_range=(10.0, 12.0), index_not_in=[3, 4, 5]),
    "filter_cardinality": lambda s, d: tables.filter_elements(_on(RAGGED)(s, d), "cells", cardinality_geq=2).select("row_idx"),
    "filter_in_set": lambda s, d: tables.filter_elements(_on(A)(s, d), "row_idx", in_set=_on("SELECT DISTINCT o_custkey FROM {orders} WHERE o_totalprice > 200000")(s, d)),
    "filter_substring": lambda s, d: nested.filter_substring(_on(NESTED)(s, d), "parts", "an").withColumn("parts", F.array_join("parts", "|")),
    "rows_at_indexes": lambda s, d: tables.rows_at_indexes(_on(A)(s, d), _on("SELECT CAST(s_suppkey AS INT) AS row_idx FROM {supplier} UNION ALL SELECT CAST(s_suppkey AS INT) AS row_idx FROM {supplier}")(s, d)),
    "read_csv_grouped": lambda s, d: tables.grouped_lists(_on(LISTS)(s, d), "nation", "row_no").withColumn("values", F.array_join("values", "|")),
    "csv_horizontal": lambda s, d: tables.csv_horizontal(_on(LISTS)(s, d), "nation", "row_no").select("name", F.explode("values").alias("v")).select("name", "v.key", "v.value"),
    "read_year_columns": lambda s, d: tables.year_columns(_on(WIDE)(s, d), ["city"]),
    "read_nested_series_json": lambda s, d: tables.nested_series(_json(SERIES_JSON)(s, d), scalar=1e6),
    "flatten_sum": lambda s, d: nested.flatten_sum(_json(SUM_JSON)(s, d)),
    "cardinality": lambda s, d: nested.cardinality(_on(NESTED)(s, d), "parts", ["row_idx"]),
    "distinct_elements": lambda s, d: tables.distinct_elements(_on("SELECT o_custkey AS k, o_orderpriority AS v FROM {orders}")(s, d), ["k"], "v"),
    "merge_distinct": lambda s, d: tables.merge_distinct(_on("SELECT c_nationkey AS k, c_mktsegment AS v FROM {customer}")(s, d), _on("SELECT s_nationkey AS k, s_name AS v FROM {supplier}")(s, d), ["k"], "v").withColumn("v", F.array_join("v", "|")),
    "merge_records": lambda s, d: tables.merge_records(*(_on(x)(s, d) for x in HALF), ["series_id", "x"], "y", must_differ=True),
    "merge_records_overwrite": lambda s, d: tables.merge_records(*(_on(x)(s, d) for x in HALF), ["series_id", "x"], "y", overwrite=True),
    "hybrid_refresh": lambda s, d: tables.hybrid_refresh(_on(OLD)(s, d), _on(NEW)(s, d), ["id"]),
    "worker_job_summary": lambda s, d: tables.worker_job_summary(_on(JOBS)(s, d)),
}

MERGED = f"FROM ({HALF[0]}) a FULL JOIN ({HALF[1]}) b USING (series_id, x)"
ORACLES = {
    k: oracle(sql)
    for k, sql in {
        "operate_frames": f"SELECT row_idx, COALESCE(balance, 0) + COALESCE(price, 0) * 2 AS total, round(COALESCE(nation, 0) / (COALESCE(size, 0) + 1), 6) AS share FROM ({A}) a FULL JOIN ({B}) b USING (row_idx)",
        "merge_frames": f"SELECT row_idx, nation, COALESCE(balance, 0) + COALESCE(price, 0) AS balance FROM ({A}) a FULL JOIN ({B}) b USING (row_idx)",
        "frame_to_long": f"SELECT row_idx, 'balance' AS name, balance AS value FROM ({HOLES}) WHERE balance IS NOT NULL UNION ALL SELECT row_idx, 'nation', CAST(row_idx % 25 AS DOUBLE) FROM ({HOLES})",
        "long_to_frame": A,
        "frame_profile": "SELECT count(*) AS n_rows, CAST(max(len(string_split(p_name, ' '))) AS INT) AS n_columns, len(list_filter(string_split(arg_min(p_name, p_partkey), ' '), lambda x: TRY_CAST(x AS DOUBLE) IS NOT NULL)) = 0 AS has_header FROM {part}",
        "select_row": f"SELECT * FROM ({A}) WHERE row_idx = 7",
        "set_row": f"SELECT * FROM ({A}) WHERE row_idx <> 7 UNION ALL SELECT 7, 1.5, NULL",
        "set_column": f"SELECT row_idx, segment, value AS balance FROM ({HOLES}) a FULL JOIN ({VALUES}) b USING (row_idx) WHERE segment IS NOT NULL OR value IS NOT NULL",
        "range_select": f"SELECT * FROM ({SHEET}) WHERE sheet = 'sheet1' AND r BETWEEN 2 AND 9 AND c BETWEEN 3 AND 8",
        "range_series": f"SELECT c, max(v) FILTER (r = 2) AS name, COALESCE(string_agg(v, '|' ORDER BY r) FILTER (r > 2), '') AS values FROM ({SHEET}) WHERE sheet = 'sheet1' AND r BETWEEN 2 AND 9 AND c BETWEEN 3 AND 8 GROUP BY c",
        "coerce_cells": f"SELECT *, CASE WHEN kind = 'number' THEN TRY_CAST(v AS DOUBLE) END AS number FROM (SELECT *, CASE WHEN v IS NULL OR v = '' THEN 'empty' WHEN starts_with(v, '=') THEN 'formula' WHEN TRY_CAST(v AS DOUBLE) IS NOT NULL THEN 'number' ELSE 'text' END AS kind FROM ({SHEET}))",
        "filter_elements": f"SELECT * FROM ({A}) WHERE nation >= 3 AND NOT nation BETWEEN 10 AND 12 AND row_idx NOT IN (3, 4, 5)",
        "filter_cardinality": "SELECT CAST(p_partkey AS INT) AS row_idx FROM {part} WHERE len(string_split(p_name, ' ')) >= 2",
        "filter_in_set": f"SELECT * FROM ({A}) WHERE row_idx IN (SELECT o_custkey FROM {{orders}} WHERE o_totalprice > 200000)",
        "filter_substring": "SELECT row_idx, array_to_string(parts, '|') AS parts FROM (SELECT CAST(p_partkey AS INT) AS row_idx, list_filter(list_concat(string_split(p_name, ' '), string_split(p_type, ' ')), lambda x: contains(x, 'an')) AS parts FROM {part}) WHERE len(parts) > 0",
        "rows_at_indexes": f"SELECT * FROM ({A}) WHERE row_idx IN (SELECT s_suppkey FROM {{supplier}})",
        "read_csv_grouped": f"SELECT nation, 'name' AS name, string_agg(name, '|' ORDER BY row_no) AS values FROM ({LISTS}) GROUP BY nation UNION ALL SELECT nation, 'code', string_agg(CAST(code AS VARCHAR), '|' ORDER BY row_no) FROM ({LISTS}) GROUP BY nation",
        "csv_horizontal": f"SELECT 'name' AS name, nation AS key, name AS value FROM ({LISTS}) UNION ALL SELECT 'code', nation, CAST(code AS VARCHAR) FROM ({LISTS})",
        "read_year_columns": f"SELECT city, -500 AS x, CAST(bc_500 AS DOUBLE) AS y FROM ({WIDE}) WHERE bc_500 IS NOT NULL UNION ALL SELECT city, 100, CAST(ad_100 AS DOUBLE) FROM ({WIDE}) WHERE ad_100 <> ' ' UNION ALL SELECT city, 1800, CAST(AD_1800 AS DOUBLE) FROM ({WIDE})",
        "read_nested_series_json": "SELECT 'z' || CAST(zone AS VARCHAR) AS zone, yr, target * 1000000 AS target FROM {control}",
        "flatten_sum": "SELECT leaf, CAST(sum(v) AS DOUBLE) AS total FROM (SELECT 'a' AS leaf, p_size + 1 AS v FROM {part} UNION ALL SELECT 'b' || CAST(p_size % 3 AS VARCHAR), 2 FROM {part}) GROUP BY leaf",
        "cardinality": "SELECT CAST(p_partkey AS INT) AS row_idx, CAST(len(string_split(p_name, ' ')) + len(string_split(p_type, ' ')) AS INT) AS n FROM {part}",
        "distinct_elements": "SELECT DISTINCT o_custkey AS k, o_orderpriority AS v FROM {orders}",
        "merge_distinct": "SELECT k, string_agg(v, '|' ORDER BY side, v) AS v FROM (SELECT DISTINCT c_nationkey AS k, c_mktsegment AS v, 0 AS side FROM {customer} UNION ALL SELECT DISTINCT s_nationkey, s_name, 1 FROM {supplier}) GROUP BY k",
        "merge_records": f"SELECT series_id, x, CASE WHEN a.y = b.y THEN a.y WHEN a.y IS NOT NULL AND b.y IS NOT NULL THEN a.y + b.y ELSE COALESCE(a.y, b.y) END AS y {MERGED}",
        "merge_records_overwrite": f"SELECT series_id, x, COALESCE(b.y, a.y) AS y {MERGED}",
        "hybrid_refresh": f"SELECT id, o.name, COALESCE(n.balance, o.balance) AS balance FROM ({OLD}) o LEFT JOIN ({NEW}) n USING (id)",
        "worker_job_summary": f"SELECT worker, status, count(*) AS n, CAST(sum(epoch_us(ended) - epoch_us(started)) AS BIGINT) AS elapsed, any_value(last_done) AS last_done FROM ({JOBS}) LEFT JOIN (SELECT worker, arg_max(job_id, (ended, job_id)) AS last_done FROM ({JOBS}) WHERE status = 'done' GROUP BY worker) USING (worker) GROUP BY worker, status",
    }.items()
}
