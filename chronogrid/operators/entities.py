"""Entities over time and space: keyframe logs (id, date, k, v, seq), validity intervals, city coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def resolve_forward(log: DataFrame, asof: Column | str) -> DataFrame:
    """State of every entity at a date: for each key the last value at or before it; seq breaks ties."""
    asof = F.lit(asof).cast("timestamp_ntz") if isinstance(asof, str) else asof
    last = F.max_by("v", F.struct("date", "seq"))
    return log.filter(F.col("date") <= asof).groupBy("id", "k").agg(last.alias("v"), F.max("date").alias("date"))


def asof_keyframe(log: DataFrame, asof: str) -> DataFrame:
    """The latest keyframe of every entity at or before a date."""
    kept = log.filter(F.col("date") <= F.lit(asof).cast("timestamp_ntz"))
    return kept.groupBy("id").agg(F.max(F.struct("date", "seq", "k", "v")).alias("f")).select("id", "f.date", "f.seq", "f.k", "f.v")


def negative_diff(log: DataFrame) -> DataFrame:
    """For every change of a key the value that it replaced (null: the key was new)."""
    w = Window.partitionBy("id", "k").orderBy("date", "seq")
    was = F.lag("v").over(w)
    return log.withColumn("was", was).filter(~F.col("was").eqNullSafe(F.col("v"))).select("id", "date", "seq", "k", "was")


def active_intervals(features: DataFrame, years: list[int]) -> DataFrame:
    """Features whose validity, both ends included, covers each year."""
    spark = features.sparkSession
    asked = F.broadcast(spark.createDataFrame([(y,) for y in years], "yr int"))
    return features.join(asked, F.col("yr").between(F.col("from_year"), F.col("to_year"))).select("yr", "feature_id")


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def radius_join(a: DataFrame, b: DataFrame, km: float = 5.0) -> DataFrame:
    """Pairs of cities (city_id, lat, lng) under km apart: an equi join on a cube of space, then the exact distance.

    Points go on the unit sphere; cubes are a little wider than the chord of km, so partners lie in the same or a next
    cube, whatever the latitude or the date line. b is sent to the cubes around it.
    """
    side = F.lit(1.001 * km / EARTH_KM)

    def cube(df: DataFrame, tag: str) -> DataFrame:
        lat, lng = F.radians("lat"), F.radians("lng")
        axes = (F.cos(lat) * F.cos(lng), F.cos(lat) * F.sin(lng), F.sin(lat))
        return df.select(F.col("city_id").alias(f"{tag}_id"), F.col("lat").alias(f"{tag}_lat"), F.col("lng").alias(f"{tag}_lng"), *[F.floor(v / side).alias(n) for v, n in zip(axes, "xyz", strict=True)])

    left, right = cube(a, "a"), cube(b, "b")
    for n in "xyz":
        right = right.withColumn(n, F.explode(F.array(*[F.col(n) + d for d in (-1, 0, 1)])))
    distance = haversine_km(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng"))
    return left.join(right, ["x", "y", "z"]).withColumn("km", distance).filter(F.col("km") < km).select("a_id", "b_id", "km")


def duplicate_coords(places: DataFrame, digits: int) -> DataFrame:
    """Places that share their rounded coordinates lose them."""
    spot = [F.round(n, digits).alias(f"{n}_spot") for n in ("lat", "lng")]
    held = places.select("city_id", "lat", "lng", *spot)
    many = held.groupBy("lat_spot", "lng_spot").agg(F.count("*").alias("n")).filter("n > 1")
    alone = F.col("n").isNull()
    return held.join(many, ["lat_spot", "lng_spot"], "left").select("city_id", *[F.when(alone, F.col(n)).alias(n) for n in ("lat", "lng")])
