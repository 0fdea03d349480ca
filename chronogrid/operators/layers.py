"""Grids in and out of cells, and sets of cells: bands, time slices, overlays, points on the grid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODATA = -9999.0


def ascii_grid_to_cells(grid: DataFrame, mode: str = "number") -> DataFrame:
    """grid: (layer, r, c, v). number: values rounded up; percentage: shares of the layer's greatest value in 255ths, rounded
    half up. Cells without data are dropped."""
    held = grid.filter((F.col("v") != NODATA) & F.col("v").isNotNull())
    if mode == "number":
        return held.select("layer", "r", "c", F.ceil("v").cast("double").alias("value"))
    top = held.groupBy("layer").agg(F.max("v").alias("top"))
    share = F.when(F.col("top") > 0, F.least(F.floor(F.col("v") / F.col("top") * 255 + 0.5), F.lit(255))).otherwise(0)
    return held.join(top, "layer").select("layer", "r", "c", share.cast("double").alias("value"))


def explode_bands(df: DataFrame, years: list[int], scalar: float = 1.0, bands: str = "bands") -> DataFrame:
    """One row a band: the n-th band belongs to the n-th year; value x scalar, rounded up. Bands beyond the years are dropped."""
    rest = [c for c in df.columns if c != bands]
    held = df.select(*rest, F.posexplode(bands).alias("band", "v"))
    year = F.get(F.array(*map(F.lit, years)), F.col("band"))
    return held.select(*rest, year.cast("int").alias("yr"), F.ceil(F.col("v") * scalar).cast("double").alias("value")).filter("yr is not null and value is not null")


def explode_time_slices(df: DataFrame, first_year: int = 1990, nodata: float = -9.0, slices: str = "slices") -> DataFrame:
    """One row a slice: the year is ``first_year`` plus its place; values without data are dropped."""
    rest = [c for c in df.columns if c != slices]
    held = df.select(*rest, F.posexplode(slices).alias("t", "value"))
    return held.filter((F.col("value") != nodata) & F.col("value").isNotNull()).select(*rest, (F.col("t") + first_year).alias("yr"), F.col("value").cast("double").alias("value"))


def to_channels(value: Column) -> list[Column]:
    """Four bytes r, g, b, a of a whole number up to 2^32 - 1, greatest first; fractions are rounded, larger numbers stop there."""
    whole = F.least(F.greatest(F.floor(value + 0.5), F.lit(0)), F.lit(2**32 - 1)).cast("long")
    return [F.shiftright(whole, 8 * (3 - i)).bitwiseAND(F.lit(255)).cast("int").alias(n) for i, n in enumerate("rgba")]


def from_channels(r: Column, g: Column, b: Column, a: Column) -> Column:
    return (((r.cast("long") * 256 + g) * 256 + b) * 256 + a).cast("double")


def nearest_of(years: list[int], x: Column) -> Column:
    """The one of the listed years closest to x; the one listed first of equally close ones."""
    ranked = F.transform(F.array(*map(F.lit, years)), lambda y, i: F.struct(F.abs(y - x).alias("gap"), i.alias("i"), y.alias("y")))
    return F.array_min(ranked)["y"]


def nearest_year_layer(points: DataFrame, years: list[int], year: str = "yr") -> DataFrame:
    """points with layer_year: of the listed years (those of the layers, few) the closest. Null without a year."""
    if not years:
        return points.withColumn("layer_year", F.lit(None).cast("int"))
    return points.withColumn("layer_year", F.when(F.col(year).isNotNull(), nearest_of(years, F.col(year))).cast("int"))


def lnglat_to_cell(lng: Column, lat: Column, width: int, height: int) -> tuple[Column, Column]:
    """Row (from the north) and column of a point on an equirectangular grid; the south-west corner's row is clamped into it."""
    col = F.least(F.floor((lng + 180) / 360 * width), F.lit(width - 1)).cast("int")
    row = F.least(height - F.floor((lat + 90) / 180 * height), F.lit(height - 1)).cast("int")
    return row, col


def cell_to_lnglat(row: Column, col: Column, width: int, height: int) -> tuple[Column, Column]:
    return col / width * 360 - 180, 90 - row / height * 180


def sample_points(points: DataFrame, cells: DataFrame, width: int, height: int) -> DataFrame:
    """points (…, lng, lat, layer_year) with the value of the cell beneath in that year's layer; 0 where it is absent."""
    row, col = lnglat_to_cell(F.col("lng"), F.col("lat"), width, height)
    at = points.withColumn("idx", (row * width + col).cast("long"))
    there = cells.select(F.col("yr").alias("layer_year"), "idx", F.col("value").alias("sampled"))
    return at.join(there, ["layer_year", "idx"], "left").withColumn("sampled", F.coalesce("sampled", F.lit(0.0)))


def cell_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("idx").unionAll(b.select("idx")).distinct()


def cell_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("idx").distinct().join(b.select("idx"), "idx", "left_anti")


def cell_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("idx").distinct().join(b.select("idx"), "idx", "left_semi")


def cell_overlay(a: DataFrame, b: DataFrame, least: int = 1) -> DataFrame:
    """Two layers (idx, source, props map) over one another: a's cells alone, b's alone, and both with b's properties before
    a's and the source ``a,b``. A piece is the cells of one pair of sources; pieces of fewer than ``least`` cells are dropped."""
    left = a.select("idx", F.col("source").alias("sa"), F.col("props").alias("pa"))
    both = left.join(b.select("idx", F.col("source").alias("sb"), F.col("props").alias("pb")), "idx", "full")
    none = F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")
    over = F.coalesce("pb", none)
    props = F.map_concat(F.map_filter(F.coalesce("pa", none), lambda k, _: ~F.map_contains_key(over, k)), over)
    pieces = both.select("idx", F.concat_ws(",", "sa", "sb").alias("source"), props.alias("props"))
    big = pieces.groupBy("source").agg(F.count("*").alias("n_cells")).filter(F.col("n_cells") >= least).select("source")
    return pieces.join(big, "source", "left_semi").select("idx", "source", "props")


def province_overlay(layers: list[DataFrame], least: int = 1) -> DataFrame:
    """All layers over one another in order."""
    return reduce(lambda a, b: cell_overlay(a, b, least), layers)


def split_by_divisors(cells: DataFrame, divisors: DataFrame) -> DataFrame:
    """(feature_id, piece, idx): a feature's cells by the set of divisors that hold them, named in order; '' outside all."""
    held = divisors.groupBy("idx").agg(F.array_join(F.array_sort(F.collect_set(F.col("divisor").cast("string"))), "+").alias("piece"))
    return cells.select("feature_id", "idx").distinct().join(held, "idx", "left").select("feature_id", F.coalesce("piece", F.lit("")).alias("piece"), "idx")


def geometry_dedupe(points: DataFrame, digits: int, keys: list[str]) -> DataFrame:
    """Of rows whose coordinates agree after cutting them to ``digits`` decimals the one with the lowest keys."""
    cut = [(F.signum(n) * F.floor(F.abs(n) * 10**digits) / 10**digits).alias(f"{n}_cut") for n in ("lng", "lat")]
    rest = [c for c in points.columns if c not in keys]
    best = points.groupBy(*cut).agg(F.min(F.struct(*keys, *rest)).alias("m"))
    return best.select("m.*")
