"""Algebra of frames, keyed records and series: unions, fallbacks, reductions, nearest points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def append_frames(a: DataFrame, b: DataFrame, default=None) -> DataFrame:
    """Rows of both by column name; columns that b lacks get the default there, columns that a lacks are null in its rows."""
    filled = b.withColumns({c: F.lit(default).cast(a.schema[c].dataType) for c in a.columns if c not in b.columns})
    return a.unionByName(filled, allowMissingColumns=True)


def concat_records(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Records of either side; a wins, b fills what a lacks."""
    names = [c for c in a.columns if c not in keys]
    left, right = a.alias("a"), b.alias("b")
    return left.join(right, keys, "full").select(*keys, *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in names])


def accumulate_keys(rows: DataFrame, keys: list[str], value: str, drop_nonpositive: bool = False) -> DataFrame:
    """The sum of each key's amounts; sums of zero or less are dropped on demand."""
    out = rows.groupBy(*keys).agg(F.sum(value).alias(value))
    return out.filter(F.col(value) > 0) if drop_nonpositive else out


def unique_values_only(rows: DataFrame, value: str, within: list[str]) -> DataFrame:
    """Rows whose value no other row of the group has; counted before the join, so a common value is one row there."""
    once = rows.groupBy(*within, value).agg(F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    return rows.join(once, [*within, value], "left_semi")


def range_extrema(df: DataFrame, key: str, low: str, high: str) -> DataFrame:
    """The ends, sum of middles and mean of middles of each key's intervals, whichever end stands first."""
    middle = (F.col(low) + F.col(high)) / 2
    return df.groupBy(key).agg(F.min(F.least(low, high)).alias("low"), F.max(F.greatest(low, high)).alias("high"), F.sum(middle).alias("total"), F.avg(middle).alias("mean"))


def series_extrema(series: DataFrame, key: str = "series_id", value: str = "y") -> DataFrame:
    return series.groupBy(key).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


def series_domain(series: DataFrame, key: str = "series_id", x: str = "x") -> DataFrame:
    return series.groupBy(key).agg(F.min(x).alias("first_x"), F.max(x).alias("last_x"))


def filled_domain(series: DataFrame, step: int = 1, key: str = "series_id", x: str = "x") -> DataFrame:
    """Every whole x from a series' first to its last."""
    return series_domain(series, key, x).select(key, F.explode(F.sequence("first_x", "last_x", F.lit(step))).alias(x))


def mean_deviation(a: DataFrame, b: DataFrame) -> DataFrame:
    """By series the mean of a's value over b's value at a's x, clamped to b's domain; where b has no such point or is 0
    there, a's point is left out."""
    at = a.join(series_domain(b), "series_id").withColumn("at", F.least(F.greatest("x", "first_x"), "last_x"))
    other = b.select("series_id", F.col("x").alias("at"), F.col("y").alias("other")).filter("other <> 0")
    return at.join(other, ["series_id", "at"]).groupBy("series_id").agg(F.avg(F.col("y") / F.col("other")).alias("deviation"))


def nearest_signed(series: DataFrame, x: int, positive: bool = True) -> DataFrame:
    """By series the point nearest to x among those of the wanted sign; the larger x wins a tie."""
    wanted = series.filter(F.col("y") > 0 if positive else F.col("y") < 0)
    best = wanted.groupBy("series_id").agg(F.max_by(F.struct("x", "y"), F.struct(-F.abs(F.col("x") - x), F.col("x"))).alias("p"))
    return best.select("series_id", "p.x", "p.y")


def zero_before_first(series: DataFrame, years: list[int], least: float = 1e-4) -> DataFrame:
    """A series that begins below ``least`` is 0 in all asked years before its first."""
    first = series.groupBy("series_id").agg(F.min("x").alias("first_x"), F.min_by("y", "x").alias("y0")).filter(F.col("y0") < least)
    added = first.select("series_id", F.explode(F.array(*map(F.lit, years))).alias("x"), F.lit(0.0).alias("y"), "first_x").filter("x < first_x")
    return series.select("series_id", "x", "y").unionAll(added.select("series_id", "x", "y"))


def layer_fallback(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Layers of primary, and of secondary those of years that primary lacks. Years are few: one row each."""
    return primary.unionByName(secondary.join(primary.select("yr").distinct(), "yr", "left_anti").select(*primary.columns))


def layer_mean(layers: list[DataFrame]) -> DataFrame:
    """Cell by cell the mean of aligned layers; a missing cell counts as 0."""
    both = layers[0].select("yr", "idx", "value")
    for more in layers[1:]:
        both = both.unionAll(more.select("yr", "idx", "value"))
    return both.groupBy("yr", "idx").agg((F.sum("value") / len(layers)).alias("value"))


def greyscale_sum(cells: DataFrame) -> DataFrame:
    """The total of each layer's grey values, as shares of 255."""
    return cells.groupBy("layer", "yr").agg(F.sum(F.col("grey") / 255.0).alias("total"))


def greyscale(cells: DataFrame) -> DataFrame:
    """Grey values 0 to 255: a cell's share of its layer's largest value, rounded half up."""
    top = cells.groupBy("layer", "yr").agg(F.max("value").alias("top"))
    grey = F.when(F.col("top") > 0, F.least(F.floor(F.col("value") / F.col("top") * 255 + 0.5), F.lit(255))).otherwise(0)
    return cells.join(top, ["layer", "yr"]).select("layer", "yr", "idx", grey.cast("int").alias("grey"))


def standardise_total(series: DataFrame, total: float, round_up: bool = False) -> DataFrame:
    """Each point's share of its series' sum, times total, rounded up on demand; 0 where the sum is 0."""
    whole = F.sum("y").over(Window.partitionBy("series_id"))
    share = F.when(whole != 0, F.col("y") / whole * total).otherwise(0.0)
    return series.select("series_id", "x", (F.ceil(share).cast("double") if round_up else share).alias("y"))


def nearest_keyframe(log: DataFrame, date: str) -> DataFrame:
    """By entity the log row closest to a date; of equally close rows the earlier one."""
    gap = F.abs(F.unix_micros(F.col("date").cast("timestamp")) - F.unix_micros(F.lit(date).cast("timestamp")))
    best = log.groupBy("id").agg(F.min_by(F.struct("date", "seq", "k", "v"), F.struct(gap, F.col("date"), F.col("seq"))).alias("p"))
    return best.select("id", "p.*")


def merge_logs(a: DataFrame, b: DataFrame) -> DataFrame:
    """The fields of both logs by entity, date and key; b's value wins, then the later row."""
    both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))
    return both.groupBy("id", "date", "k").agg(F.max_by("v", F.struct("side", "seq")).alias("v"))


def interval(low: Column, high: Column, by: Column, op: str) -> Column:
    """An interval with every end combined with a number, in order again: struct of low and high."""
    done = {"add": lambda c: c + by, "subtract": lambda c: c - by, "multiply": lambda c: c * by, "divide": lambda c: c / by}[op]
    return F.struct(F.least(done(low), done(high)).alias("low"), F.greatest(done(low), done(high)).alias("high"))
