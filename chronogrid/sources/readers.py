"""Files in and out: images and text grids as cells, tables and JSON as series, features and entities.

Everything goes by Spark's own readers and writers, so paths may lie in any store that Spark knows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronogrid.operators.layers import NODATA, to_channels
from chronogrid.operators.tables import grouped_lists, nested_series

CELLS = "layer string, yr int, r int, c int, idx long, value double"


def layer_and_year(path: Column) -> tuple[Column, Column]:
    """Layer and year of ``layer_1900.png``, ``layer_-500.png``, ``layer1900AD_number.png`` or ``layer500BC_number.png``."""
    name = F.regexp_extract(path, r"([^/\\]+)\.[A-Za-z0-9]+$", 1)
    era = r"^(.*?)_?(\d+)(AD|BC)(?:_number)?$"
    plain = r"^(.*)_(-?\d+)$"
    dated = F.rlike(name, F.lit(era))
    year = F.regexp_extract(name, era, 2).try_cast("int") * F.when(F.regexp_extract(name, era, 3) == "BC", -1).otherwise(1)
    return F.when(dated, F.regexp_extract(name, era, 1)).otherwise(F.regexp_extract(name, plain, 1)), F.when(dated, year).otherwise(F.regexp_extract(name, plain, 2).try_cast("int"))


def read_raster_images(spark: SparkSession, path: str, encoding: str = "uint32") -> DataFrame:
    """Cells of images: uint32 reads r, g, b, a as one number, greatest byte first; grey reads r / 255. Cells of 0 are absent.
    Images that cannot be read are left out. One image is one row until its cells are taken apart."""
    layer, year = layer_and_year(F.col("image.origin"))
    held = spark.read.format("image").option("dropInvalid", True).load(path).select(layer.alias("layer"), year.alias("yr"), "image.width", "image.nChannels", "image.data")

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, yr, width, n, data in pdf.itertuples(index=False):
                x = np.frombuffer(data, dtype=np.uint8).reshape(-1, n).astype(np.int64)
                b, g, r = (x[:, i] if n >= 3 else x[:, 0] for i in range(3))
                a = x[:, 3] if n == 4 else np.full(len(x), 255)
                value = (((r * 256 + g) * 256 + b) * 256 + a) if encoding == "uint32" else r / 255
                if encoding == "uint32" and n < 4:
                    value = np.where(r | g | b, value, 0)
                at = np.flatnonzero(value)
                yield pd.DataFrame({"layer": name, "yr": yr, "r": at // width, "c": at % width, "idx": at, "value": value[at].astype(float)})

    return held.mapInPandas(take, CELLS)


def read_ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """(layer, r, c, v) of text grids; values equal to the header's NODATA value are absent. The layer is the file's name, or that
    of its folder ``layer=name``."""
    files = spark.read.text(path, wholetext=True)
    return parse_ascii_grids(files.select("value", F.concat("layer", F.lit(".asc")).alias("file") if "layer" in files.columns else F.input_file_name().alias("file")))


def parse_ascii_grids(files: DataFrame) -> DataFrame:
    """read_ascii_grid of texts (file, value)."""
    text = files.select("value", F.regexp_extract("file", r"([^/\\]+)\.[A-Za-z0-9]+$", 1).alias("layer"))
    head = r"(?i)^\s*(?:ncols|nrows|xllcorner|yllcorner|xllcenter|yllcenter|cellsize|nodata_value)\s+\S+\s*$"
    nodata = F.coalesce(F.regexp_extract("value", r"(?im)^\s*nodata_value\s+(\S+)", 1).try_cast("double"), F.lit(NODATA))
    body = F.filter(F.split("value", r"\r?\n"), lambda x: ~F.rlike(x, F.lit(head)) & (F.trim(x) != ""))
    rows = text.select("layer", nodata.alias("nodata"), F.posexplode(body).alias("r", "line"))
    cells = rows.select("layer", "r", "nodata", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("c", "v"))
    return cells.select("layer", "r", "c", F.col("v").try_cast("double").alias("v"), "nodata").filter("v is not null and v <> nodata").drop("nodata")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A table with a header, every column a text, and row_no in file order."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"').withColumn("row_no", F.monotonically_increasing_id())


def read_csv_grouped(spark: SparkSession, path: str) -> DataFrame:
    """(key, name, values): for each value of the first column the others' values, in row order."""
    table = read_csv(spark, path)
    return grouped_lists(table, table.columns[0], "row_no")


def read_nested_series_json(spark: SparkSession, path: str, scalar: float = 1.0) -> DataFrame:
    """(zone, yr, target) of files ``{zone: {"population": {year: number}}}``."""
    return nested_series(spark.read.text(path, wholetext=True), "value", scalar)


GEOMETRY = "struct<type:string,coordinates:string>"
FEATURE = f"struct<properties:map<string,string>,geometry:{GEOMETRY}>"


def read_features_geojson(spark: SparkSession, path: str, lines: bool = False, id_property: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Features (feature_id, properties, kind) and vertices (feature_id, part, ring, seq, x, y) of a folder of polygon files:
    collections, or with lines a feature a line, as write_features_geojson leaves them. feature_id is file name and place, so that
    it does not depend on how files are read; or the named property, which lines need. Lines that are no JSON are left out."""
    if lines and not id_property:
        raise ValueError("a file of lines has no fixed places: name the property that holds a feature's id")
    if lines:
        found = spark.read.text(path).select(F.from_json("value", FEATURE).alias("f")).filter("f.geometry is not null").withColumn("place", F.lit(None).cast("string"))
    else:
        text = spark.read.text(path, wholetext=True).select("value", F.regexp_extract(F.input_file_name(), r"([^/\\]+)$", 1).alias("file"))
        parsed = F.from_json("value", f"struct<features:array<{FEATURE}>>")
        found = text.select("file", F.posexplode(parsed["features"]).alias("n", "f")).select("f", F.concat_ws("#", "file", "n").alias("place"))
    held = found.select((F.col("f.properties")[id_property] if id_property else F.col("place")).alias("feature_id"), "f.properties", "f.geometry")
    points = "array<array<array<array<double>>>>"
    shapes = F.when(F.col("geometry.type") == "Polygon", F.array(F.from_json("geometry.coordinates", "array<array<array<double>>>"))).when(F.col("geometry.type") == "MultiPolygon", F.from_json("geometry.coordinates", points))
    parts = held.select("feature_id", F.posexplode(shapes).alias("part", "rings"))
    rings = parts.select("feature_id", "part", F.posexplode("rings").alias("ring", "points"))
    vertices = rings.select("feature_id", "part", "ring", F.posexplode("points").alias("seq", "p"))
    return held.select("feature_id", "properties", F.col("geometry.type").alias("kind")), vertices.select("feature_id", "part", "ring", "seq", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))


def feature_lines(features: DataFrame, vertices: DataFrame) -> DataFrame:
    """A GeoJSON feature a row (value) of features and their vertices, as multi-polygons."""
    order = lambda c, keep: F.transform(F.array_sort(F.collect_list(c)), lambda x: x[keep])
    rings = vertices.groupBy("feature_id", "part", "ring").agg(order(F.struct("seq", F.array("x", "y").alias("p")), "p").alias("points"))
    parts = rings.groupBy("feature_id", "part").agg(order(F.struct("ring", "points"), "points").alias("rings"))
    shapes = parts.groupBy("feature_id").agg(order(F.struct("part", "rings"), "rings").alias("coordinates"))
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), "coordinates")
    held = features.join(shapes, "feature_id")
    return held.select(F.to_json(F.struct(F.lit("Feature").alias("type"), "properties", geometry.alias("geometry"))).alias("value"))


def write_features_geojson(features: DataFrame, vertices: DataFrame, path: str) -> None:
    """One feature a line."""
    feature_lines(features, vertices).write.text(path)


def read_entity_save(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities (id, class_name, value) and keyframes (id, ts, slot, k, v) of save files ``{id: {class_name, history, value}}``,
    where history is a JSON text of ``{"keyframes": {ts: {"value": [slot, slot, ...]}}}``. A slot that is null is one row with a
    null key."""
    outer = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,struct<class_name:string,history:string,value:string>>")).alias("id", "o"))
    frames = F.from_json("o.history", "struct<keyframes:map<string,struct<value:array<string>>>>")
    slots = outer.select("id", F.explode(frames["keyframes"]).alias("ts", "f")).select("id", F.col("ts").cast("long").alias("ts"), F.posexplode("f.value").alias("slot", "text"))
    keys = slots.select("id", "ts", "slot", F.explode_outer(F.from_json("text", "map<string,string>")).alias("k", "v"))
    return outer.select("id", "o.class_name", "o.value"), keys


def write_cells(cells: DataFrame, path: str) -> None:
    """Cells with their four bytes, a folder for each layer and year."""
    cells.select("*", *to_channels(F.col("value"))).write.partitionBy("layer", "yr").parquet(path)


def write_json_snapshot(df: DataFrame, path: str) -> None:
    df.write.json(path)
