"""Polygons of rings and parts: centroids, and the cells that they cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RING = ["feature_id", "part", "ring"]


def with_parts(vertices: DataFrame) -> DataFrame:
    """vertices (feature_id, part, ring, seq, x, y), where those without part or ring are of one part, or all outer rings.
    Rows with a null coordinate or place are left out."""
    missing = [c for c in ("part", "ring") if c not in vertices.columns]
    held = vertices.withColumns({c: F.lit(0) for c in missing}) if missing else vertices
    return held.select(*RING, "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna()


def ring_edges(vertices: DataFrame) -> DataFrame:
    """(feature_id, part, ring, x1, y1, x2, y2): every ring's vertices in order, with the way back to the first. Rings that
    repeat their first vertex at the end have an edge of no length there. A ring is the largest window."""
    ring = Window.partitionBy(*RING)
    at, first = F.struct("x", "y"), F.first(F.struct("x", "y")).over(ring.orderBy("seq"))
    onward = F.coalesce(F.lead(at).over(ring.orderBy("seq")), first)
    return with_parts(vertices).select(*RING, F.col("x").alias("x1"), F.col("y").alias("y1"), onward["x"].alias("x2"), onward["y"].alias("y2"))


def part_centroids(vertices: DataFrame) -> DataFrame:
    """(feature_id, part, x, y): the centroid of each part's outer ring by its area; its first vertex where the area is 0."""
    outer = with_parts(vertices).filter("ring = 0")
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    # about its first vertex, so that small rings far from the origin lose no digits
    first = outer.groupBy("feature_id", "part").agg(F.min_by(F.struct("x", "y"), "seq").alias("p"))
    edges = ring_edges(outer).join(first, ["feature_id", "part"])
    edges = edges.select("feature_id", "part", "p", *[(F.col(f"{n}{i}") - F.col(f"p.{n}")).alias(f"{n}{i}") for n in "xy" for i in (1, 2)])
    sums = edges.groupBy("feature_id", "part").agg(
        F.first("p").alias("p"), F.sum(cross).alias("a"), F.sum((F.col("x1") + F.col("x2")) * cross).alias("sx"), F.sum((F.col("y1") + F.col("y2")) * cross).alias("sy")
    )
    flat = F.col("a") == 0
    return sums.select("feature_id", "part", *[F.when(flat, F.col(f"p.{n}")).otherwise(F.col(f"p.{n}") + F.col(f"s{n}") / (3 * F.col("a"))).alias(n) for n in "xy"])


def polygon_centroid(vertices: DataFrame) -> DataFrame:
    """(feature_id, x, y): the mean of the centroids of a feature's parts, each that of its outer ring; holes don't count."""
    return part_centroids(vertices).groupBy("feature_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def polygon_cells(vertices: DataFrame, width: int, height: int) -> DataFrame:
    """(feature_id, r, c): the cells whose centre lies in one of a feature's rings, each ring alone, by even-odd crossings of each
    row's centre line; holes are filled, since their rings are rings like others. A part that holds no centre has the cell of its
    centroid. y runs north, rows south. Crossings are ranked within (ring, row), so no group is larger than one row of one ring.
    """
    edges = ring_edges(vertices).filter("y1 <> y2")
    low, high = F.ceil(F.least("y1", "y2") - 0.5), F.ceil(F.greatest("y1", "y2") - 0.5) - 1
    low, high = F.greatest(low, F.lit(0)).cast("int"), F.least(high, F.lit(height - 1)).cast("int")
    rows = edges.withColumn("lo", low).withColumn("hi", high).filter("lo <= hi").withColumn("y", F.explode(F.sequence("lo", "hi")))
    x = F.col("x1") + (F.col("y") + 0.5 - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    line = Window.partitionBy(*RING, "y").orderBy("x")
    spans = rows.select(*RING, "y", x.alias("x")).select(*RING, "y", "x", F.row_number().over(line).alias("n"), F.lead("x").over(line).alias("until")).filter("n % 2 = 1")
    first, last = F.greatest(F.ceil(F.col("x") - 0.5), F.lit(0)).cast("int"), F.least(F.ceil(F.col("until") - 0.5) - 1, F.lit(width - 1)).cast("int")
    spans = spans.withColumn("a", first).withColumn("b", last).filter("a <= b")
    filled = spans.select("feature_id", "y", F.explode(F.sequence("a", "b")).alias("c"))
    centres = part_centroids(vertices).join(spans.select("feature_id", "part").distinct(), ["feature_id", "part"], "left_anti")
    inside = (F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height)
    points = centres.filter(inside).select("feature_id", F.floor("y").cast("int").alias("y"), F.floor("x").cast("int").alias("c"))
    return filled.unionAll(points).select("feature_id", (F.lit(height - 1) - F.col("y")).alias("r"), "c").distinct()


def rasterise_polygons(vertices: DataFrame, width: int, height: int) -> DataFrame:
    """(r, c, feature_id): the cells of polygon_cells; of several features the greatest id wins."""
    return polygon_cells(vertices, width, height).groupBy("r", "c").agg(F.max("feature_id").alias("feature_id"))
