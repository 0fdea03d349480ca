"""Queries of frames, records, intervals and simple layers."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from chronogrid.operators import frames
from chronogrid.sources.views import base, derive, view, with_views

NEAR = "2024-01-15 12:00:00"
YEARS = [-20, -10, 0, 10, 20]


def _v(name):
    return lambda s, d: view(s, d, name)


gt, rr, cells, log = (_v(n) for n in ("series_gt", "series_rr", "cells", "entity_log"))
SIGNED = "SELECT series_id, x, y - 3 * (x + 20) AS y FROM series_rr"
LATE = "SELECT series_id, x, CASE WHEN series_id % 2 = 0 AND x = min(x) OVER (PARTITION BY series_id) THEN 0.0 ELSE y END AS y FROM series_gt"
ODD, LOW = "SELECT * FROM cells WHERE yr % 2 = 1", "SELECT * FROM cells WHERE idx < 900"


def _on(sql, *names):
    """The Spark form of a statement over the named views."""
    for n in names:
        sql = re.sub(rf"\b{n}\b", "{" + n + "}", sql)
    return lambda s, d: derive(s, d, sql)


signed, late, odd, low = _on(SIGNED, "series_rr"), _on(LATE, "series_gt"), _on(ODD, "cells"), _on(LOW, "cells")


def _round(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def _intervals(s, d):
    f, by = view(s, d, "features"), F.col("w") - 3
    ops = {op: frames.interval(F.col("from_year").cast("double"), F.col("to_year").cast("double"), by, op) for op in ("add", "subtract", "multiply")}
    return f.select("feature_id", *[c.getField(e).alias(f"{op}_{e}") for op, c in ops.items() for e in ("low", "high")], ((F.col("from_year") + F.col("to_year")) / 2).alias("midpoint"))


def _ends(op, sign):
    a, b = f"from_year {sign} (w - 3)", f"to_year {sign} (w - 3)"
    return f"CAST(least({a}, {b}) AS DOUBLE) AS {op}_low, CAST(greatest({a}, {b}) AS DOUBLE) AS {op}_high"


QUERIES = {
    "append_frames": lambda s, d: frames.append_frames(base(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), "c_mktsegment"), base(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), "s_name"), "none"),
    "concat_records": lambda s, d: frames.concat_records(gt(s, d).withColumn("x", F.col("x") + 5), rr(s, d), ["series_id", "x"]),
    "accumulate_keys": lambda s, d: frames.accumulate_keys(signed(s, d), ["series_id"], "y", True),
    "unique_values_only": lambda s, d: frames.unique_values_only(rr(s, d), "y", ["series_id"]),
    "series_extrema": lambda s, d: _round(frames.series_extrema(signed(s, d)), "mean"),
    "series_domain": lambda s, d: frames.series_domain(rr(s, d)),
    "filled_domain": lambda s, d: frames.filled_domain(rr(s, d)),
    "mean_deviation": lambda s, d: _round(frames.mean_deviation(gt(s, d).withColumn("x", F.col("x") + 5), rr(s, d)), "deviation"),
    "nearest_signed": lambda s, d: frames.nearest_signed(signed(s, d), 20),
    "zero_before_first": lambda s, d: frames.zero_before_first(late(s, d), YEARS),
    "layer_fallback": lambda s, d: frames.layer_fallback(odd(s, d), cells(s, d)),
    "layer_mean": lambda s, d: frames.layer_mean([cells(s, d), low(s, d)]),
    "greyscale_sum": lambda s, d: _round(frames.greyscale_sum(frames.greyscale(cells(s, d))), "total"),
    "write_percentage_layer": lambda s, d: frames.greyscale(cells(s, d)),
    "standardise_total": lambda s, d: _round(frames.standardise_total(rr(s, d), 1000.0), "y"),
    "standardise_total_rounded": lambda s, d: frames.standardise_total(rr(s, d), 1000.0, True),
    "nearest_signed_negative": lambda s, d: frames.nearest_signed(signed(s, d).withColumn("y", F.col("y") - 100), 20, False),
    "interval_divide": lambda s, d: _round(view(s, d, "features").select("feature_id", frames.interval(F.col("from_year").cast("double"), F.col("to_year").cast("double"), F.col("w") + 0.0, "divide").alias("q")).select("feature_id", "q.low", "q.high"), "low", "high"),
    "nearest_keyframe": lambda s, d: frames.nearest_keyframe(log(s, d), NEAR),
    "merge_logs": lambda s, d: frames.merge_logs(log(s, d), log(s, d).filter("seq % 3 = 0").withColumn("v", F.concat(F.lit("n"), F.col("v")))),
    "fx_range": _intervals,
}

GREY = "SELECT layer, yr, idx, CAST(CASE WHEN top > 0 THEN least(floor(value / top * 255 + 0.5), 255) ELSE 0 END AS INT) AS grey FROM (SELECT *, max(value) OVER (PARTITION BY layer, yr) AS top FROM cells)"

ORACLES = {
    "append_frames": "SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment, NULL AS s_name FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 'none', s_name FROM supplier",
    "concat_records": with_views("SELECT series_id, x, COALESCE(a.y, b.y) AS y FROM (SELECT series_id, x + 5 AS x, y FROM series_gt) a FULL JOIN series_rr b USING (series_id, x)", "series_gt", "series_rr"),
    "accumulate_keys": with_views(f"SELECT series_id, sum(y) AS y FROM ({SIGNED}) GROUP BY series_id HAVING sum(y) > 0", "series_rr"),
    "unique_values_only": with_views("SELECT series_id, x, y FROM series_rr QUALIFY count(*) OVER (PARTITION BY series_id, y) = 1", "series_rr"),
    "series_extrema": with_views(f"SELECT series_id, min(y) AS low, max(y) AS high, sum(y) AS total, round(avg(y), 6) AS mean FROM ({SIGNED}) GROUP BY series_id", "series_rr"),
    "series_domain": with_views("SELECT series_id, min(x) AS first_x, max(x) AS last_x FROM series_rr GROUP BY series_id", "series_rr"),
    "filled_domain": with_views("SELECT series_id, CAST(unnest(range(min(x), max(x) + 1)) AS INT) AS x FROM series_rr GROUP BY series_id", "series_rr"),
    "mean_deviation": with_views("SELECT a.series_id, round(avg(a.y / b.y), 6) AS deviation FROM (SELECT series_id, x + 5 AS x, y FROM series_gt) a JOIN (SELECT series_id, min(x) AS lo, max(x) AS hi FROM series_rr GROUP BY series_id) s ON s.series_id = a.series_id JOIN series_rr b ON b.series_id = a.series_id AND b.x = least(greatest(a.x, lo), hi) WHERE b.y <> 0 GROUP BY a.series_id", "series_gt", "series_rr"),
    "nearest_signed": with_views(f"SELECT series_id, x, y FROM ({SIGNED}) WHERE y > 0 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY abs(x - 20), x DESC) = 1", "series_rr"),
    "zero_before_first": with_views(f"WITH l AS ({LATE}) SELECT series_id, x, y FROM l UNION ALL SELECT f.series_id, t.x, 0.0 FROM (SELECT series_id, min(x) AS x0, arg_min(y, x) AS y0 FROM l GROUP BY series_id) f JOIN (VALUES {', '.join(f'({y})' for y in YEARS)}) AS t(x) ON t.x < x0 WHERE y0 < 1e-4", "series_gt"),
    "layer_fallback": with_views(f"{ODD} UNION ALL SELECT * FROM cells WHERE yr % 2 <> 1", "cells"),
    "layer_mean": with_views(f"SELECT a.yr, a.idx, (a.value + COALESCE(b.value, 0)) / 2 AS value FROM cells a LEFT JOIN ({LOW}) b ON a.yr = b.yr AND a.idx = b.idx", "cells"),
    "greyscale_sum": with_views(f"SELECT layer, yr, round(sum(grey / 255.0::DOUBLE), 6) AS total FROM ({GREY}) GROUP BY layer, yr", "cells"),
    "write_percentage_layer": with_views(GREY, "cells"),
    "standardise_total": with_views("SELECT series_id, x, round(CASE WHEN t <> 0 THEN y / t * 1000 ELSE 0 END, 6) AS y FROM (SELECT *, sum(y) OVER (PARTITION BY series_id) AS t FROM series_rr)", "series_rr"),
    "standardise_total_rounded": with_views("SELECT series_id, x, CAST(ceil(CASE WHEN t <> 0 THEN y / t * 1000 ELSE 0 END) AS DOUBLE) AS y FROM (SELECT *, sum(y) OVER (PARTITION BY series_id) AS t FROM series_rr)", "series_rr"),
    "nearest_signed_negative": with_views(f"SELECT series_id, x, y - 100 AS y FROM ({SIGNED}) WHERE y < 100 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY abs(x - 20), x DESC) = 1", "series_rr"),
    "interval_divide": with_views("SELECT feature_id, round(from_year / w::DOUBLE, 6) AS low, round(to_year / w::DOUBLE, 6) AS high FROM features", "features"),
    "nearest_keyframe": with_views(f"SELECT id, date, seq, k, v FROM entity_log QUALIFY row_number() OVER (PARTITION BY id ORDER BY abs(epoch_us(date) - epoch_us(TIMESTAMP '{NEAR}')), date, seq) = 1", "entity_log"),
    "merge_logs": with_views("SELECT id, date, k, CASE WHEN bool_or(seq % 3 = 0) THEN 'n' || arg_max(v, seq) FILTER (seq % 3 = 0) ELSE arg_max(v, seq) END AS v FROM entity_log GROUP BY id, date, k", "entity_log"),
    "fx_range": with_views(f"SELECT feature_id, {_ends('add', '+')}, {_ends('subtract', '-')}, {_ends('multiply', '*')}, (from_year + to_year) / 2.0 AS midpoint FROM features", "features"),
}
