"""Sparse year series (series_id, x, y): windows over x for each series, never a driver loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from chronogrid.functions.expressions import checked

def by_x() -> WindowSpec:
    return Window.partitionBy("series_id").orderBy("x")


def two_point(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Linear between two points; outside them exponential where both values are positive, else linear."""
    line = y0 + (x - x0) * (y1 - y0) / (x1 - x0)
    growth = F.ln(y1 / y0) / (x1 - x0)
    out = F.when(x < x0, y0 * F.exp(growth * (x - x0))).when(x > x1, y1 * F.exp(growth * (x - x1)))
    return F.when((y0 > 0) & (y1 > 0) & ((x < x0) | (x > x1)), out).otherwise(line)


def bracket_years(series: DataFrame, targets: DataFrame) -> DataFrame:
    """(series_id, x, x0, y0, x1, y1) for every target (series_id, x): the sample at or below x and the next one; outside
    the samples the first or last two. Series of a single sample have a null x1."""
    ends = by_x().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pair = F.struct("x", "y")
    known = series.select(
        "series_id",
        "x",
        F.lit(False).alias("wanted"),
        pair.alias("here"),
        F.lead(pair).over(by_x()).alias("after"),
        F.lag(pair).over(by_x()).alias("before"),
        F.first(pair).over(ends).alias("first"),
        F.nth_value(pair, 2).over(ends).alias("second"),
    )
    # the segment of a sample starts there, but the last sample's is the one that ends there
    last = F.col("after").isNull() & F.col("before").isNotNull()
    known = known.select(
        "series_id", "x", "wanted", F.struct(F.when(last, F.col("before")).otherwise(F.col("here")).alias("a"), F.when(last, F.col("here")).otherwise(F.col("after")).alias("b")).alias("seg"), F.struct(F.col("first").alias("a"), F.col("second").alias("b")).alias("head")
    )
    asked = targets.select("series_id", "x", F.lit(True).alias("wanted"), F.lit(None).cast(known.schema["seg"].dataType).alias("seg"), F.lit(None).cast(known.schema["head"].dataType).alias("head"))
    upto = Window.partitionBy("series_id").orderBy("x", "wanted").rowsBetween(Window.unboundedPreceding, 0)
    beyond = Window.partitionBy("series_id").orderBy("x", "wanted").rowsBetween(0, Window.unboundedFollowing)
    seg = F.coalesce(F.last("seg", ignorenulls=True).over(upto), F.first("head", ignorenulls=True).over(beyond))
    return (
        known.unionAll(asked)
        .select("series_id", "x", "wanted", seg.alias("seg"))
        .filter("wanted and seg is not null")
        .select("series_id", "x", F.col("seg.a.x").alias("x0"), F.col("seg.a.y").alias("y0"), F.col("seg.b.x").alias("x1"), F.col("seg.b.y").alias("y1"))
    )


def linear_interpolate(series: DataFrame, targets: DataFrame) -> DataFrame:
    """The series' value at every target; a series of one sample is constant."""
    c = F.col
    value = F.when(c("x1").isNull(), c("y0")).otherwise(two_point(c("x"), c("x0"), c("y0"), c("x1"), c("y1")))
    return bracket_years(series, targets).select("series_id", "x", value.alias("y"))


def carry_last_nonnegative(series: DataFrame) -> DataFrame:
    """Negative values become the last one that was not; null before the first."""
    return series.withColumn("y", F.last(F.when(F.col("y") >= 0, F.col("y")), ignorenulls=True).over(by_x().rowsBetween(Window.unboundedPreceding, 0)))


def trim_value(series: DataFrame, value: float, start: bool = True, end: bool = True) -> DataFrame:
    """Without the runs of a value at the start, the end or both; a series of that value alone goes if either is cut."""
    other = series.filter(F.col("y") != value).groupBy("series_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    held = series.join(other, "series_id") if start or end else series
    kept = (F.col("x") >= F.col("lo") if start else F.lit(True)) & (F.col("x") <= F.col("hi") if end else F.lit(True))
    return held.filter(kept).select("series_id", "x", "y")


def cut_after(series: DataFrame, year: int) -> DataFrame:
    return series.filter(F.col("x") <= year)


def series_zip(a: DataFrame, b: DataFrame, op: str | None = None, expression: str | None = None) -> DataFrame:
    """Two series over the union of their keys, missing values 0; op is add, sub, mul or div (a quotient by 0 is 0), or
    an equation over ``i`` (a's value) and ``x`` (b's value) of arithmetic and the functions that expressions.checked lists."""
    left, right = a.select("series_id", F.col("x").alias("at"), F.col("y").alias("i")), b.select("series_id", F.col("x").alias("at"), F.col("y").alias("x"))
    both = left.join(right, ["series_id", "at"], "full").select("series_id", "at", F.coalesce("i", F.lit(0.0)).alias("i"), F.coalesce("x", F.lit(0.0)).alias("x"))
    p, q = F.col("i"), F.col("x")
    known = {"add": p + q, "sub": p - q, "mul": p * q, "div": F.when(q == 0, 0.0).otherwise(p / q)}
    value = checked(expression, {"i", "x"}) if expression else known[op]
    return both.select("series_id", F.col("at").alias("x"), value.alias("y"))


def zip_arrays(a: Column, b: Column, op: str) -> Column:
    """Two arrays place by place, missing places 0."""
    known = {"add": lambda p, q: p + q, "sub": lambda p, q: p - q, "mul": lambda p, q: p * q, "div": lambda p, q: F.when(q == 0, 0.0).otherwise(p / q)}
    return F.zip_with(a, b, lambda p, q: known[op](F.coalesce(p, F.lit(0.0)), F.coalesce(q, F.lit(0.0))))


def weighted_geomean(df: DataFrame, group: list[str], value: str = "y") -> DataFrame:
    """Geometric mean of the positive values, by their share of all, less that of the negatives' sizes, by theirs."""
    v, n = F.col(value), F.count(value)

    def part(sign: Column) -> Column:
        return F.coalesce(F.count(F.when(sign, v)) / n * F.exp(F.avg(F.when(sign, F.ln(F.abs(v))))), F.lit(0.0))

    return df.groupBy(*group).agg((part(v > 0) - part(v < 0)).alias("gmean"))


def interpolate_layers(cells: DataFrame, targets: list[int]) -> DataFrame:
    """Layers of the target years from the two sampled years around each, cell by cell, absent cells 0, rounded up,
    negatives 0; years outside the samples use the first or last two. The list of sampled years is one row per layer year."""
    spark = cells.sparkSession
    years = cells.select(F.col("layer").alias("series_id"), F.col("yr").alias("x"), F.lit(0.0).alias("y")).distinct()
    asked = years.select("series_id").distinct().crossJoin(F.broadcast(spark.createDataFrame([(t,) for t in targets], "x int")))
    pairs = bracket_years(years, asked).select(F.col("series_id").alias("layer"), F.col("x").alias("t"), "x0", "x1")
    ends = pairs.select("layer", "t", "x0", "x1", F.explode(F.array("x0", "x1")).alias("yr")).filter("yr is not null")
    near = cells.join(ends, ["layer", "yr"]).groupBy("layer", "t", "x0", "x1", "idx").agg(
        F.coalesce(F.max(F.when(F.col("yr") == F.col("x0"), F.col("value"))), F.lit(0.0)).alias("y0"),
        F.coalesce(F.max(F.when(F.col("yr") == F.col("x1"), F.col("value"))), F.lit(0.0)).alias("y1"),
    )
    c = F.col
    value = F.when(c("x1").isNull(), c("y0")).otherwise(two_point(c("t"), c("x0"), c("y0"), c("x1"), c("y1")))
    return near.select("layer", c("t").alias("yr"), "idx", F.greatest(F.ceil(value), F.lit(0)).cast("double").alias("value"))
