"""Scaling under masks: masks limited to years, zones with domains of their own, areas and densities.

Masks: (mask, idx), with the years in the name's end (``…_1990_2000``). Sums are made per zone and year before they are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronogrid.operators.scaling import zone_assign
from chronogrid.shared import materialise


def mask_years(name: Column) -> tuple[Column, Column]:
    """First and last year of a mask, from the end of its name; null where the name has none."""
    years = r"_(-?\d+)_(-?\d+)$"
    return tuple(F.try_to_number(F.nullif(F.regexp_extract(name, years, i), F.lit("")), F.lit("S99999")).cast("int") for i in (1, 2))


def active_masks(masks: DataFrame, years: DataFrame) -> DataFrame:
    """(yr, mask) for every year that a mask's name covers, both ends included. Masks without years are never active."""
    first, last = mask_years(F.col("mask"))
    named = masks.select("mask").distinct().select("mask", first.alias("first"), last.alias("last"))
    return years.select("yr").distinct().join(named, F.col("yr").between(F.col("first"), F.col("last"))).select("yr", "mask")


def masked_cells(mask_cells: DataFrame, years: DataFrame) -> DataFrame:
    """(yr, idx) of the cells under a mask that is active in the year."""
    return active_masks(mask_cells, years).join(mask_cells, "mask").select("yr", "idx").distinct()


def scale_to_zones_domain(cells: DataFrame, zones: DataFrame, control: DataFrame, dims: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Zones are scaled to target x their scalar in the years of their own domain, a missing target being 0, and rounded up;
    in other years a zone's cells are only rounded up. Zeros stay, and so do cells outside every zone.

    dims: (zone, first_year, last_year, scalar). excluded: (yr, idx) of cells that neither count nor change.
    """
    held = zone_assign(cells, zones).join(dims.withColumnRenamed("scalar", "per_target"), "zone", "left")
    if excluded is None:
        held = held.withColumn("free", F.lit(True))
    else:
        held = held.join(excluded.select("yr", "idx", F.lit(False).alias("free")), ["yr", "idx"], "left").withColumn("free", F.coalesce("free", F.lit(True)))
    counted = F.sum(F.when(F.col("free") & (F.col("value") > 0), F.col("value")))
    sums = held.filter("zone is not null").groupBy("layer", "yr", "zone", "first_year", "last_year", "per_target").agg(counted.alias("total"))
    target = F.coalesce("target", F.lit(0.0)) * F.col("per_target")
    scaled = F.col("yr").between(F.col("first_year"), F.col("last_year")) & (F.col("total") > 0)
    scalars = sums.join(control, ["zone", "yr"], "left").select("layer", "yr", "zone", F.when(scaled, target / F.col("total")).otherwise(1.0).alias("scalar"))
    changes = F.col("free") & F.col("scalar").isNotNull() & (F.col("value") != 0)
    return held.join(scalars, ["layer", "yr", "zone"], "left").select(
        "layer", "yr", "idx", F.when(changes, F.ceil(F.col("value") * F.col("scalar")).cast("double")).otherwise(F.col("value")).alias("value")
    )


def scale_excluding_masks(cells: DataFrame, zones: DataFrame, control: DataFrame, dims: DataFrame, mask_cells: DataFrame, readmitted: DataFrame) -> DataFrame:
    """Domain scaling in which cells under an active mask are left out and kept, unless an active second mask readmits them."""
    years = cells.select("yr").distinct()
    out = masked_cells(mask_cells, years).join(masked_cells(readmitted, years), ["yr", "idx"], "left_anti")
    return scale_to_zones_domain(cells, zones, control, dims, out)


def zonal_area(area_cells: DataFrame, masks: DataFrame) -> DataFrame:
    """The area of each mask: of its files the one that covers most. masks: (mask, file, idx)."""
    by_file = masks.join(area_cells, "idx").groupBy("mask", "file").agg(F.sum("area").alias("area"))
    return by_file.groupBy("mask").agg(F.max("area").alias("area"))


def scale_sequential_masks(cells: DataFrame, masks: DataFrame, targets: DataFrame, order: list[str]) -> DataFrame:
    """Masks one after another, each on what the ones before it left: the cells in any of a mask's files are scaled so that
    its largest file has the mask's target, and rounded up. targets: (mask, yr, target); null or 0 leaves the cells.

    The steps follow one another by nature; each is one written table.
    """
    kept = cells.select("layer", "yr", "idx", "value")
    for mask in order:
        own = masks.filter(F.col("mask") == mask)
        sums = kept.join(own, "idx").groupBy("layer", "yr", "file").agg(F.sum("value").alias("total")).groupBy("layer", "yr").agg(F.max("total").alias("total"))
        wanted = targets.filter((F.col("mask") == mask) & (F.col("target") != 0)).select("yr", "target")
        scalars = sums.filter("total > 0").join(wanted, "yr").select("layer", "yr", (F.col("target") / F.col("total")).alias("scalar"))
        inside = own.select("idx").distinct().withColumn("inside", F.lit(True))
        value = F.when(F.col("inside") & F.col("scalar").isNotNull(), F.ceil(F.col("value") * F.col("scalar")).cast("double")).otherwise(F.col("value"))
        kept = materialise(kept.join(inside, "idx", "left").join(scalars, ["layer", "yr"], "left").select("layer", "yr", "idx", value.alias("value")))
    return kept


def density_targets(area_cells: DataFrame, masks: DataFrame, densities: DataFrame, years: DataFrame) -> DataFrame:
    """(mask, yr, target): area times density, for each year of a mask's domain. densities: (mask, density, first_year, last_year)."""
    areas = zonal_area(area_cells, masks).join(densities, "mask")
    return years.select("yr").distinct().join(areas, F.col("yr").between(F.col("first_year"), F.col("last_year"))).select("mask", "yr", (F.col("area") * F.col("density")).alias("target"))


def layer_pair_mean(a: DataFrame, b: DataFrame, domain_a: tuple[int, int], domain_b: tuple[int, int]) -> DataFrame:
    """Cell by cell: the mean (absent cells 0) in years of both domains, a copy in years of one, nothing in others."""
    both = a.select("yr", "idx", F.col("value").alias("va")).join(b.select("yr", "idx", F.col("value").alias("vb")), ["yr", "idx"], "full")
    in_a, in_b = F.col("yr").between(*domain_a), F.col("yr").between(*domain_b)
    mean = (F.coalesce("va", F.lit(0.0)) + F.coalesce("vb", F.lit(0.0))) / 2
    value = F.when(in_a & in_b, mean).when(in_a, F.col("va")).when(in_b, F.col("vb"))
    return both.select("yr", "idx", value.alias("value")).filter("value is not null")


def fill_from_fallback(cells: DataFrame, fallback: DataFrame, flagged: DataFrame) -> DataFrame:
    """Flagged cells (layer, yr, idx) take the fallback's value, 0 where it has none; the rest stay."""
    keys = ["layer", "yr", "idx"]
    flags = flagged.select(*keys).distinct().withColumn("flag", F.lit(True))
    other = fallback.select(*keys, F.col("value").alias("other"))
    value = F.when(F.col("flag"), F.coalesce("other", F.lit(0.0))).otherwise(F.col("value"))
    return cells.select(*keys, "value").join(flags, keys, "left").join(other, keys, "left").select(*keys, value.alias("value"))
