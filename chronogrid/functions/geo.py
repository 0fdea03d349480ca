"""Places on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed value: mean radius of the earth in metres
EARTH_M = 6_371_008.8


def translate_point(lng: Column, lat: Column, east: Column, north: Column) -> tuple[Column, Column]:
    """The point so many metres east along its parallel, then north along the meridian; longitudes stay within -180 to 180."""
    moved = lng + F.degrees(east / (EARTH_M * F.cos(F.radians(lat))))
    return F.pmod(moved + 540, F.lit(360.0)) - 180, lat + F.degrees(north / EARTH_M)
