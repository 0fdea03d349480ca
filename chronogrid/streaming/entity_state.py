"""Entity logs as streams: log lines, first sightings, merged states, day folders."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

RECORD = "type string, date long, data map<string,string>"


def read_parquet_log(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 16) -> DataFrame:
    """A folder of Parquet log files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def parse_log_lines(lines: DataFrame, line: str = "value", keep: list[str] | None = None) -> DataFrame:
    """(columns to keep, id, type, date, data) of ``<id> {json}`` lines; the date is in milliseconds there. Lines without an id, a brace or a
    readable record are left out. Works on tables and streams."""
    text = F.trim(line)
    at = F.instr(text, "{")
    record = F.from_json(text.substr(at, F.length(text)), RECORD)
    kept = keep or []
    held = lines.filter(at > 2).select(*kept, F.trim(text.substr(F.lit(1), at - 1)).alias("id"), record.alias("o"))
    return held.filter("o.date is not null and id <> ''").select(*kept, "id", "o.type", F.timestamp_millis("o.date").cast("timestamp_ntz").alias("date"), "o.data")


def read_entity_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """A folder of log files, one record a line, as a table or as a stream of the files that arrive."""
    return parse_log_lines((spark.readStream if stream else spark.read).text(path))


def read_newest_first(spark: SparkSession, path: str) -> DataFrame:
    """(file, back, id, type, date, data): the log as it is read on start, the file of the latest name first and each file from its
    last record. back is a record's place from the end of its file, where records stand in the order of their lines."""
    lines = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/\\]+)$", 1).alias("file"), F.split("value", "\\r?\\n").alias("lines"))
    told = lines.select("file", F.posexplode(F.reverse("lines")).alias("back", "value"))
    held = parse_log_lines(told, keep=["file", "back"])
    return held.orderBy(F.desc("file"), "back")


def log_line(id_: Column, kind: Column, date: Column, data: Column) -> Column:
    return F.concat(id_.cast("string"), F.lit(" "), F.to_json(F.struct(kind.alias("type"), F.unix_millis(date.cast("timestamp")).alias("date"), data.alias("data"))))


def append_entity_log(records: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """A stream of (id, type, date, data) appended as lines under a folder for each calendar day; the checkpoint makes up for
    lost attempts."""
    lines = records.select(log_line(*map(F.col, ("id", "type", "date", "data"))).alias("value"), F.date_format("date", "yyyy.MM.dd").alias("day"))
    return lines.writeStream.format("text").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def first_sightings(stream: DataFrame, keys: list[str], time_col: str = "date", late: str = "7 days") -> DataFrame:
    """Each key's first row to arrive; keys unseen for longer than the watermark are forgotten."""
    return stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark(keys)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class MergedState(StatefulProcessor):
    """An entity's keys in a map, each with the (date, sequence) and the value of its latest row."""

    def __init__(self, expire_after_ms: int | None) -> None:
        self.expire_after_ms = expire_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "k string", "us long, seq long, v string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[str, tuple] = {}
        for pdf in rows:
            for row in zip(pdf["k"], pdf["us"], pdf["seq"], pdf["v"], strict=True):
                k, at = row[0], (int(row[1]), int(row[2]))
                if k not in new or new[k][0] <= at:
                    new[k] = (at, None if pd.isna(row[3]) else row[3])
        # the store is read once, and only keys that change are written: each call is a way to the store and back
        held = {k: tuple(old) for (k,), old in self.held.iterator()}
        for k, ((us, seq), v) in new.items():
            old = held.get(k)
            if old is None or (old[0], old[1]) <= (us, seq):
                held[k] = (us, seq, v)
                self.held.updateValue((k,), held[k])
        if self.expire_after_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.expire_after_ms)
        yield self.told(key, held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield from ()

    def told(self, key, held: dict[str, tuple]) -> pd.DataFrame:
        now, last = {}, None
        for k, (us, _, v) in held.items():
            last = us if last is None else max(last, us)
            if v is not None:
                now[k] = v
        return pd.DataFrame({"id": [key[0]], "us": [last], "state": [json.dumps(dict(sorted(now.items())))]})

    def close(self) -> None:
        pass


def entity_state_stream(stream: DataFrame, expire_after_ms: int | None = None) -> DataFrame:
    """(id, date, state as JSON) of every entity that a batch touches: each key's value of the latest date; date is the latest of all.

    Rows (id, date, seq, k, v) count by their date and, where dates are equal, by seq, not by when they come, so late ones do
    not undo newer ones; without a column seq the last to come of equal dates counts. A null v takes a key away; rows with a null
    date or key are left out. Dates are held as microseconds, so any date that a timestamp can hold will do. Every key has
    its own entry in the state store. An entity without rows for ``expire_after_ms`` of processing time is forgotten; without that
    it is held for good. Timers keep a query with expiry running, so it can't have the trigger availableNow. The state store must be RocksDB's, which is set here if the session names none.
    """
    spark = stream.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKS:
        spark.conf.set(PROVIDER, ROCKS)
    seq = F.coalesce(F.col("seq").cast("long"), F.lit(0)) if "seq" in stream.columns else F.lit(0).cast("long")
    rows = stream.select("id", F.unix_micros(F.col("date").cast("timestamp")).alias("us"), seq.alias("seq"), "k", "v").filter("us is not null and k is not null and id is not null")
    out = f"id {stream.schema['id'].dataType.simpleString()}, us long, state string"
    merged = rows.groupBy("id").transformWithStateInPandas(MergedState(expire_after_ms), out, "Update", "None" if expire_after_ms is None else "ProcessingTime")
    return merged.select("id", F.timestamp_micros("us").cast("timestamp_ntz").alias("date"), "state")
