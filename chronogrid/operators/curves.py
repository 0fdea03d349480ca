"""Curves through year series (series_id, x, y): splines, polynomials, anchored ratios, and series of cities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronogrid.functions.expressions import checked
from chronogrid.operators.entities import radius_join
from chronogrid.shared import materialise

#: What stands for values of zero or less where logarithms are taken.
LEAST = 1e-6


def natural_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The cubic spline through (x, y), x ascending, with no curvature at its ends."""
    n = len(x)
    h = np.diff(x).astype(float)
    slope = np.diff(y) / h
    bend = np.zeros(n)
    if n > 2:  # tridiagonal system of the inner points' curvatures
        diagonal, right = 2 * (h[:-1] + h[1:]), 6 * np.diff(slope)
        for i in range(1, n - 2):
            f = h[i] / diagonal[i - 1]
            diagonal[i] -= f * h[i]
            right[i] -= f * right[i - 1]
        for i in range(n - 3, -1, -1):
            bend[i + 1] = (right[i] - (h[i + 1] * bend[i + 2] if i + 2 < n - 1 else 0.0)) / diagonal[i]
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    t = at - x[k]
    linear = slope[k] - h[k] * (2 * bend[k] + bend[k + 1]) / 6
    return y[k] + t * (linear + t * (bend[k] / 2 + t * (bend[k + 1] - bend[k]) / (6 * h[k])))


def spline_interpolate(series: DataFrame, targets: DataFrame) -> DataFrame:
    """The series with the asked points (series_id, x) inside its domain: a spline of the logarithms, kept between the two
    samples around; samples stay. A series of one sample stays as it is. One series is one group."""
    asked = targets.select("series_id", "x").distinct()

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf[pdf["y"].notna()].sort_values("x")
        x, y = known["x"].to_numpy(), known["y"].to_numpy(dtype=float)
        out = known[["series_id", "x", "y"]]
        if len(x) > 1:
            at = np.setdiff1d(pdf["x"][pdf["y"].isna()], x)
            at = at[(at >= x[0]) & (at <= x[-1])]
            k = np.searchsorted(x, at) - 1
            low, high = np.minimum(y[k], y[k + 1]), np.maximum(y[k], y[k + 1])
            new = np.clip(np.exp(natural_spline(x, np.log(np.where(y > 0, y, LEAST)), at)), low, high)
            out = pd.concat([out, pd.DataFrame({"series_id": pdf["series_id"].iat[0], "x": at, "y": new})])
        return out

    both = series.select("series_id", F.col("x").cast("int").alias("x"), F.col("y").cast("double").alias("y")).unionAll(asked.select("series_id", F.col("x").cast("int"), F.lit(None).cast("double")))
    return both.groupBy("series_id").applyInPandas(fill, both.schema)


def lagrange_interpolate(series: DataFrame, targets: DataFrame) -> DataFrame:
    """The value at each target (series_id, x) of the polynomial through all points of its series."""
    points = series.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("p"))
    asked = targets.select("series_id", F.col("x").alias("t")).distinct().join(points, "series_id")
    factor = lambda own: F.aggregate("p", F.lit(1.0), lambda a, q: a * F.when(q["x"] == own["x"], 1.0).otherwise((F.col("t") - q["x"]) / (own["x"] - q["x"])))
    value = F.aggregate(F.transform("p", lambda own: own["y"] * factor(own)), F.lit(0.0), lambda a, b: a + b)
    return asked.select("series_id", F.col("t").alias("x"), value.alias("y"))


def interpolate_gt(gt: DataFrame, rr: DataFrame) -> DataFrame:
    """The truth series gt, carried between its years by the shape of the relative series rr.

    Anchors are gt's points and rr's points outside gt's years. Between two anchors the ratio anchor / rr goes linearly and
    multiplies rr, itself linear between its points and flat outside them, at every year of either series. Where rr is 0 the
    ratio is 0 for an anchor of 0, else 1. Series without rr, or of one anchor, are left out.
    """
    left, right = gt.select("series_id", "x", F.col("y").alias("g")), rr.select("series_id", "x", F.col("y").alias("r"))
    both = left.join(right, ["series_id", "x"], "full")
    whole, order = Window.partitionBy("series_id"), Window.partitionBy("series_id").orderBy("x")
    upto, onward = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)

    def near(value: Column, window) -> Column:
        point = F.when(value.isNotNull(), F.struct("x", value.alias("v")))
        return (F.last if window is upto else F.first)(point, ignorenulls=True).over(window)

    def between(a: Column, b: Column) -> Column:
        weight = (F.col("x") - a["x"]) / (b["x"] - a["x"])
        return F.when(a.isNull(), b["v"]).when(b.isNull() | (a["x"] == b["x"]), a["v"]).otherwise(a["v"] + weight * (b["v"] - a["v"]))

    gx = F.when(F.col("g").isNotNull(), F.col("x"))
    placed = both.select("series_id", "x", "g", "r", F.min(gx).over(whole).alias("lo"), F.max(gx).over(whole).alias("hi"), near(F.col("r"), upto).alias("p"), near(F.col("r"), onward).alias("q"))
    placed = placed.filter("p is not null or q is not null").withColumn("rv", between(F.col("p"), F.col("q")))
    outside = F.coalesce((F.col("x") < F.col("lo")) | (F.col("x") > F.col("hi")), F.lit(True))
    anchor = F.coalesce("g", F.when(outside, F.col("r")))
    ratio = F.when(anchor.isNotNull(), F.when(F.col("rv") == 0, F.when(anchor == 0, 0.0).otherwise(1.0)).otherwise(anchor / F.col("rv")))
    placed = placed.withColumn("ratio", ratio)
    anchors = F.count("ratio").over(whole)
    done = placed.select("series_id", "x", "rv", near(F.col("ratio"), upto).alias("a"), near(F.col("ratio"), onward).alias("b"), anchors.alias("n")).filter("n > 1")
    return done.filter("a is not null and b is not null").select("series_id", "x", (F.col("rv") * between(F.col("a"), F.col("b"))).alias("y"))


def expand_value(series: DataFrame, value: float = 0.0, down: bool = True, up: bool = True) -> DataFrame:
    """A point of the value also stands one unit beside the differing point before it and after it."""
    order = Window.partitionBy("series_id").orderBy("x")
    held = series.select("series_id", "x", "y", F.lag(F.struct("x", "y")).over(order).alias("p"), F.lead(F.struct("x", "y")).over(order).alias("n"))
    own = held.filter(F.col("y") == value)
    sides = [own.filter(F.col("p.y") != value).select("series_id", (F.col("p.x") + 1).alias("x"))] if down else []
    sides += [own.filter(F.col("n.y") != value).select("series_id", (F.col("n.x") - 1).alias("x"))] if up else []
    out = series.select("series_id", "x", "y")
    for side in sides:
        new = side.distinct().join(out.select("series_id", "x"), ["series_id", "x"], "left_anti")
        out = out.unionAll(new.select("series_id", "x", F.lit(value).alias("y")))
    return out


def clamp_domain(values: DataFrame, domain: DataFrame, column: str = "x") -> DataFrame:
    """values with the column kept within its series' [first_x, last_x]; series without a domain are left out."""
    return values.join(domain, "series_id").withColumn(column, F.least(F.greatest(column, "first_x"), "last_x")).select(*values.columns)


def remove_zeroes(series: DataFrame) -> DataFrame:
    return series.filter((F.col("y") != 0) & F.col("y").isNotNull())


def series_map(series: DataFrame, expression: str) -> DataFrame:
    """Each value by an equation over ``n``, the value: arithmetic and the functions that expressions.checked lists. Anything
    else in it is a ValueError, other columns' names too."""
    value = checked(expression, {"n"})
    names = [c for c in series.columns if c != "y"]
    held = series.select(F.struct(*names).alias("key_of_row"), F.col("y").alias("n"))
    return held.select(*[F.col("key_of_row")[c].alias(c) for c in names], value.alias("y"))


def _on_segment(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """two_point() of series.py, of one series' neighbouring samples."""
    if len(x) == 1:
        return np.full(len(at), y[0])
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
    x0, y0, x1, y1 = x[i], y[i], x[i + 1], y[i + 1]
    out = y0 + (at - x0) * (y1 - y0) / (x1 - x0)
    grows = (y0 > 0) & (y1 > 0)
    for side, base, value in ((grows & (at < x0), x0, y0), (grows & (at > x1), x1, y1)):
        growth = np.log(y1[side] / y0[side]) / (x1[side] - x0[side])
        out[side] = value[side] * np.exp(growth * (at[side] - base[side]))
    return out


def _between(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Linear between samples, flat outside them."""
    a, b = np.searchsorted(x, at, "right") - 1, np.searchsorted(x, at, "left")
    a, b = np.where(a < 0, b, a), np.where(b == len(x), a, b)
    a = np.minimum(a, len(x) - 1)
    weight = np.where(a == b, 0.0, (at - x[a]) / np.where(a == b, 1, x[b] - x[a]))
    return y[a] + weight * (y[b] - y[a])


def _carried(gx: np.ndarray, gy: np.ndarray, rx: np.ndarray, ry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """interpolate_gt() of one series."""
    x = np.union1d(gx, rx)
    rv = _between(rx, ry, x)
    anchor = np.full(len(x), np.nan)
    outside = np.ones(len(rx), dtype=bool) if not len(gx) else (rx < gx[0]) | (rx > gx[-1])
    anchor[np.searchsorted(x, rx[outside])] = ry[outside]
    anchor[np.searchsorted(x, gx)] = gy
    held = ~np.isnan(anchor)
    ratio = np.where(rv == 0, np.where(anchor == 0, 0.0, 1.0), anchor / np.where(rv == 0, 1.0, rv))
    if held.sum() < 2:
        return x[:0], rv[:0]
    at = x[held]
    inside = (x >= at[0]) & (x <= at[-1])
    return x[inside], rv[inside] * _between(at, ratio[held], x[inside])


def _same(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> bool:
    return all(map(np.array_equal, a, b))


def _fold(x: np.ndarray, y: np.ndarray, others: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One city's series, with its neighbours' worked in by their order. A series that has changed nothing changes nothing when it
    comes again."""
    idle = None
    for rx, ry in others:
        if idle and _same(idle, (rx, ry)):
            continue
        there = _on_segment(rx, ry, x) if len(x) else y
        there = np.where(np.isnan(there), 0.0, there)
        nx, ny = _carried(x, np.where((y > there) & (there != 0), (y + there) / 2, y), rx, ry)
        ny = np.floor(ny + 0.5)
        idle = (rx, ry) if _same((x, y), (nx, ny)) else None
        x, y = nx, ny
    return x, y


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row a class of cities: its points (x, y) and its neighbours' (xs, ys) by their ids' order."""

    def points(x, y) -> tuple[np.ndarray, np.ndarray]:
        return np.asarray(x, np.int64), np.asarray(y, float)

    for pdf in batches:
        told = [_fold(*points(x, y), list(map(points, xs, ys))) for x, y, xs, ys in zip(pdf["x"], pdf["y"], pdf["xs"], pdf["ys"], strict=True)]
        sizes = [len(x) for x, _ in told]
        flat = [np.concatenate([np.zeros(0), *(t[k] for t in told)]) for k in (0, 1)]
        yield pd.DataFrame({"k": pdf["k"].repeat(sizes).to_numpy(), "x": flat[0].astype(np.int32), "y": flat[1]})


def fuse_city_series(gt_cities: DataFrame, gt: DataFrame, rr_cities: DataFrame, rr: DataFrame, km: float = 5.0) -> DataFrame:
    """(series_id, x, y) of the truth cities, with the relative series of every city under km away worked in.

    Cities: (city_id, lat, lng); series by city. A truth value above the relative one (interpolated, not 0) becomes their
    mean; then the truth series is carried by the relative one and rounded half up. Several neighbours are worked in one after
    another, by id, each into what the one before gave; repeated pairs count once. Points without a value are left out.

    Cities at the same places have the same neighbours, so these are listed once for the places. Cities of the same points, whose
    neighbours' points are the same, are one class, which is folded once. A fold is one pass over a row for each class, which holds its
    points and those of its neighbours within km.
    """
    kind = gt.schema["series_id"].dataType.simpleString()
    points = lambda s: s.select("series_id", F.col("x").cast("int").alias("x"), F.col("y").cast("double").alias("y")).dropna()
    listed = lambda s: points(s).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("p"))
    stood = gt_cities.groupBy(F.col("city_id").alias("series_id")).agg(F.array_sort(F.collect_set(F.struct("lat", "lng"))).alias("at"))
    places = stood.groupBy("at").agg(F.min("series_id").alias("place"))
    pairs = radius_join(places.select(F.col("place").alias("city_id"), F.inline("at")), rr_cities, km).select(F.col("a_id").alias("place"), "b_id").distinct()
    met = pairs.join(listed(rr).withColumnRenamed("series_id", "b_id"), "b_id").groupBy("place").agg(F.array_sort(F.collect_list(F.struct("b_id", "p"))).alias("o"))
    met = materialise(met.select("place", F.col("o.p").alias("o")).join(places, "place"))
    lists = met.groupBy("o").agg(F.min("place").alias("list"))
    both = materialise(listed(gt).join(stood.join(met.join(lists, "o").select("at", "list"), "at").select("series_id", "list"), "series_id", "full"))
    alone = both.filter("list is null").select("series_id", F.inline("p"))
    near = both.filter("list is not null").withColumn("p", F.coalesce("p", F.array().cast(both.schema["p"].dataType)))
    classes = materialise(near.groupBy("list", "p").agg(F.min("series_id").alias("k")))
    each = lambda n: F.transform("o", lambda o: o[n]).alias(f"{n}s")
    rows = classes.join(lists, "list").select("k", F.col("p.x").alias("x"), F.col("p.y").alias("y"), each("x"), each("y"))
    # classes are few bytes and much work: the engine would join them into few parts
    rows = rows.repartition(int(gt.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k")
    folded = rows.mapInPandas(_folded, f"k {kind}, x int, y double")
    members = near.join(classes, ["list", "p"]).select("series_id", "k")
    return alone.unionAll(members.join(folded, "k").select("series_id", "x", "y"))
