"""Queries by way of files and streams: what a writer leaves in the shared folder is read back by the reader of its format."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronogrid.plans.jobs import SAMPLED, text_grids
from chronogrid.plans.state import LOG
from chronogrid.shared import new_folder
from chronogrid.sources import readers
from chronogrid.sources.views import derive, oracle, view
from chronogrid.streaming import entity_state

#: Features, entities and such that share a file.
PER_FILE = 1000
ENTITIES = "SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_type END AS kind, CAST(p_size AS DOUBLE) / 4 AS zoom FROM {part}"
FRAMES = "SELECT o_custkey AS id, CAST(o_orderdate AS DATE) AS date, COALESCE(max(o_orderstatus), 'none') AS status, COALESCE(max(o_orderpriority), 'none') AS priority FROM {orders} GROUP BY o_custkey, CAST(o_orderdate AS DATE)"
RECORDS = "SELECT CAST(user_id AS VARCHAR(12)) AS id, event_type AS type, ts AS date, CAST(event_id AS VARCHAR(12)) AS n FROM {events}"


def _on(sql):
    return lambda s, d: derive(s, d, sql)


def _features(s, d):
    properties = F.create_map(F.lit("id"), F.col("feature_id").cast("string"), F.lit("from"), F.col("from_year").cast("string"))
    return view(s, d, "features").select("feature_id", properties.alias("properties")), view(s, d, "shape_vertices")


def read_ascii_grid(s, d):
    """Layers as text grids, a folder each."""
    path = f"{new_folder(s)}/grids"
    text_grids(s, d).select("value", F.regexp_replace("file", r"\.asc$", "").alias("layer")).write.partitionBy("layer").text(path)
    return readers.read_ascii_grid(s, path)


def write_features_geojson(s, d):
    """The vertices of features written a line each."""
    path = f"{new_folder(s)}/features"
    readers.write_features_geojson(*_features(s, d), path)
    _, vertices = readers.read_features_geojson(s, path, lines=True, id_property="id")
    return vertices.withColumn("feature_id", F.col("feature_id").cast("long"))


def read_features_geojson(s, d):
    """Features of collections, with the size of their shapes."""
    path = f"{new_folder(s)}/collections"
    lines = readers.feature_lines(*_features(s, d))
    batch = F.floor(F.get_json_object("value", "$.properties.id").cast("long") / PER_FILE)
    held = lines.groupBy(batch.alias("batch")).agg(F.array_join(F.collect_list("value"), ",\n").alias("body"))
    held.select("batch", F.concat(F.lit('{"type": "FeatureCollection", "features": ['), "body", F.lit("]}")).alias("value")).write.partitionBy("batch").text(path)
    features, vertices = readers.read_features_geojson(s, path, id_property="id")
    sizes = vertices.groupBy("feature_id").agg(F.countDistinct("part", "ring").alias("n_rings"), F.count("*").alias("n_points"))
    told = features.select("feature_id", "kind", F.col("properties")["from"].cast("int").alias("from_year"))
    return told.join(sizes, "feature_id").withColumn("feature_id", F.col("feature_id").cast("long"))


def read_entity_save(s, d):
    """Save files of entities whose keyframes have three slots, the second one null."""
    path = f"{new_folder(s)}/saves"
    slots = F.array(F.create_map(F.lit("status"), "status"), F.lit(None).cast("map<string,string>"), F.create_map(F.lit("variables.priority"), "priority"))
    ts = (F.unix_date("date").cast("long") * 86_400_000).cast("string")
    frames = F.map_from_entries(F.collect_list(F.struct(ts.alias("ts"), F.struct(slots.alias("value")).alias("f"))))
    history = _on(FRAMES)(s, d).groupBy("id").agg(F.to_json(F.struct(frames.alias("keyframes"))).alias("history"))
    entity = F.struct(F.lit("polygon").alias("class_name"), "history", F.lit("{}").alias("value"))
    files = history.groupBy(F.floor(F.col("id") / PER_FILE).alias("batch")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"), entity.alias("o"))))).alias("value"))
    files.write.partitionBy("batch").text(path)
    entities, keys = readers.read_entity_save(s, path)
    return keys.join(entities.select("id", "class_name"), "id")


def append_entity_log(s, d):
    """Records streamed into a log of a folder a day, and the log's records."""
    folder = new_folder(s)
    records = _on(RECORDS)(s, d)
    records.repartition(8).write.parquet(f"{folder}/records")
    stream = entity_state.read_parquet_log(s, f"{folder}/records", records.schema, 4).select("id", "type", "date", F.create_map(F.lit("n"), "n").alias("data"))
    entity_state.append_entity_log(stream, f"{folder}/log", f"{folder}/offsets").awaitTermination()
    lines = s.read.text(f"{folder}/log")
    lines = lines.withColumn("day", F.col("day").cast("string") if "day" in lines.columns else F.lit(None).cast("string"))  # an empty log has no days
    return entity_state.parse_log_lines(lines, keep=["day"]).select("id", "type", "date", F.element_at("data", "n").alias("n"), "day")


def entity_state_stream(s, d):
    """Every entity's state after the last of several batches, a row for each key."""
    folder = new_folder(s)
    rows = _on(LOG)(s, d)
    rows.repartition(8).write.parquet(f"{folder}/log")
    states = entity_state.entity_state_stream(entity_state.read_parquet_log(s, f"{folder}/log", rows.schema, 4))

    def keep(batch, number):
        # a batch that is done again after a failure replaces itself
        batch.write.mode("overwrite").parquet(f"{folder}/states/batch={number}")

    states.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    held = s.read.schema("id long, date timestamp_ntz, state string, batch long").parquet(f"{folder}/states")
    last = held.groupBy("id").agg(F.max_by(F.struct("date", "state"), "batch").alias("o"))
    return last.select("id", "o.date", F.explode(F.from_json("o.state", "map<string,string>")).alias("k", "v"))


def write_json_snapshot(s, d):
    path = f"{new_folder(s)}/snapshot"
    entities = _on(ENTITIES)(s, d)
    readers.write_json_snapshot(entities, path)
    return s.read.schema(entities.schema).json(path)


QUERIES = {f.__name__: f for f in (read_ascii_grid, write_features_geojson, read_features_geojson, read_entity_save, append_entity_log, entity_state_stream, write_json_snapshot)}

ORACLES = {
    k: oracle(sql)
    for k, sql in {
        "read_ascii_grid": f"SELECT 'popc_' || CAST(yr AS VARCHAR) AS layer, r, c, value AS v FROM {{cells}} WHERE yr IN {SAMPLED}",
        "write_features_geojson": "SELECT feature_id, CAST(dense_rank() OVER (PARTITION BY feature_id ORDER BY part) - 1 AS INT) AS part, CAST(dense_rank() OVER (PARTITION BY feature_id, part ORDER BY ring) - 1 AS INT) AS ring, CAST(seq AS INT) AS seq, x, y FROM {shape_vertices}",
        "read_features_geojson": "SELECT f.feature_id, 'MultiPolygon' AS kind, f.from_year, v.n_rings, v.n_points FROM {features} f JOIN (SELECT feature_id, count(DISTINCT part * 10 + ring) AS n_rings, count(*) AS n_points FROM {shape_vertices} GROUP BY feature_id) v ON v.feature_id = f.feature_id",
        "read_entity_save": f"SELECT 'c' || CAST(id AS VARCHAR) AS id, epoch_ms(CAST(date AS TIMESTAMP)) AS ts, CAST(t.slot AS INT) AS slot, t.k, CASE t.slot WHEN 0 THEN status WHEN 2 THEN priority END AS v, 'polygon' AS class_name FROM ({FRAMES}) CROSS JOIN (VALUES (0, 'status'), (1, NULL), (2, 'variables.priority')) AS t(slot, k)",
        "append_entity_log": f"SELECT id, type, date_trunc('milliseconds', date) AS date, n, strftime(date, '%Y.%m.%d') AS day FROM ({RECORDS})",
        "entity_state_stream": f"WITH l AS ({LOG}) SELECT s.id, m.date, s.k, s.v FROM (SELECT id, k, v, row_number() OVER (PARTITION BY id, k ORDER BY date DESC, seq DESC) AS n FROM l WHERE k IS NOT NULL) s JOIN (SELECT id, max(date) AS date FROM l WHERE k IS NOT NULL GROUP BY id) m ON m.id = s.id WHERE s.n = 1 AND s.v IS NOT NULL",
        "write_json_snapshot": ENTITIES,
    }.items()
}
