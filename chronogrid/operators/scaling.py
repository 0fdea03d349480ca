"""Scaling grid cells to control totals. Cells: layer, yr, idx, value; zones: idx, zone; control: zone, yr, target.

Sums are made per zone and year before anything is joined; the table of scalars has one row per zone and year and is sent to
all tasks: dealt by so few keys the cells of a whole year would meet in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_ratio(top: Column, bottom: Column, default: float) -> Column:
    """top / bottom, or the default where the quotient is not a number."""
    return F.when((bottom == 0) | top.isNull() | bottom.isNull(), F.lit(default)).otherwise(top / bottom)


def zone_assign(cells: DataFrame, zones: DataFrame) -> DataFrame:
    """cells with their zone; null outside every zone."""
    return cells.join(zones.select("idx", "zone"), "idx", "left")


def zonal_stats(cells: DataFrame, zones: DataFrame) -> DataFrame:
    """Sum and number of cells for each layer, year and zone."""
    return zone_assign(cells, zones).filter("zone is not null").groupBy("layer", "yr", "zone").agg(F.sum("value").alias("total"), F.count("*").alias("n_cells"))


def zone_scalars(cells: DataFrame, zones: DataFrame, control: DataFrame) -> DataFrame:
    """(layer, yr, zone, scalar): target over sum; 1 for an empty zone, null without a target."""
    return (
        zonal_stats(cells, zones)
        .join(control, ["zone", "yr"], "left")
        .select("layer", "yr", "zone", F.when(F.col("target").isNotNull(), safe_ratio(F.col("target"), F.col("total"), 1.0)).alias("scalar"))
    )


def scale_to_zones(cells: DataFrame, zones: DataFrame, control: DataFrame) -> DataFrame:
    """Cells of a zone with a target are scaled to it and rounded up; all others keep their value."""
    scaled = F.ceil(F.col("value") * F.col("scalar")).cast("double")
    return (
        zone_assign(cells, zones)
        .join(F.broadcast(zone_scalars(cells, zones, control)), ["layer", "yr", "zone"], "left")
        .select("layer", "yr", "idx", "zone", F.coalesce(scaled, "value").alias("value"))
    )


def scale_to_zones_exclusive(cells: DataFrame, zones: DataFrame, control: DataFrame) -> DataFrame:
    """As scale_to_zones without rounding; cells outside every zone become 0."""
    scaled = F.col("value") * F.coalesce("scalar", F.lit(1.0))
    return (
        zone_assign(cells, zones)
        .join(F.broadcast(zone_scalars(cells, zones, control)), ["layer", "yr", "zone"], "left")
        .select("layer", "yr", "idx", F.when(F.col("zone").isNull(), 0.0).otherwise(scaled).alias("value"))
    )


def layer_sum(cells: DataFrame) -> DataFrame:
    return cells.groupBy("layer", "yr").agg(F.sum("value").alias("total"))


def scale_to_global(cells: DataFrame, totals: DataFrame) -> DataFrame:
    """Each year's layer scaled to its one total (yr, target) and rounded up; years without a total stay."""
    scalars = layer_sum(cells).join(totals, "yr").select("layer", "yr", safe_ratio(F.col("target"), F.col("total"), 1.0).alias("scalar"))
    return cells.join(F.broadcast(scalars), ["layer", "yr"], "left").select(
        "layer", "yr", "idx", F.coalesce(F.ceil(F.col("value") * F.col("scalar")).cast("double"), "value").alias("value")
    )


def distribute_total(cells: DataFrame, totals: DataFrame) -> DataFrame:
    """Each year's total dealt to the cells by their share of the layer; years without a total are absent."""
    per_unit = layer_sum(cells).join(totals, "yr").select("layer", "yr", safe_ratio(F.col("target"), F.col("total"), 0.0).alias("per_unit"))
    return cells.join(F.broadcast(per_unit), ["layer", "yr"]).select("layer", "yr", "idx", (F.col("value") * F.col("per_unit")).alias("value"))


def standardise_max(cells: DataFrame) -> DataFrame:
    """Values as shares of their layer's greatest value; 0 where that is 0."""
    top = cells.groupBy("layer", "yr").agg(F.max("value").alias("top"))
    return cells.join(F.broadcast(top), ["layer", "yr"]).select("layer", "yr", "idx", safe_ratio(F.col("value"), F.col("top"), 0.0).alias("value"))


def invert_fraction(cells: DataFrame) -> DataFrame:
    """What is left of each value to 1."""
    return cells.withColumn("value", 1 - F.col("value"))


def conservation_check(before: DataFrame, after: DataFrame) -> DataFrame:
    """Sum of every layer and year before and after a step."""
    b, a = layer_sum(before).withColumnRenamed("total", "total_before"), layer_sum(after).withColumnRenamed("total", "total_after")
    return b.join(a, ["layer", "yr"], "full").select("layer", "yr", "total_before", "total_after", (F.col("total_after") - F.col("total_before")).alias("change"))
