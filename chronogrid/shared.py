"""Shared folders and small helpers that every operator may use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a new one where that is unset (local tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    held = getattr(shared_dir, "_own", None)
    if held is None:
        held = shared_dir._own = tempfile.mkdtemp(prefix="spark-chronogrid-")
    return held


def new_folder(spark: SparkSession) -> str:
    """A new folder in the shared folder; it goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    store, place = _stored(spark, path)
    store.mkdirs(place)
    store.deleteOnExit(place)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors.

    The files go when the driver's JVM ends, or by release().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    store, place = _stored(spark, path)
    store.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a table that materialise() gave; neither it nor what is made of it can be read afterwards."""
    path = getattr(df, "_written_to", None)
    if path:
        store, place = _stored(df.sparkSession, path)
        store.delete(place, True)


def _stored(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place
