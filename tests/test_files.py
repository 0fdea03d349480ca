"""Readers, writers and streams over files made here, and shapes that have no SQL form."""

from __future__ import annotations

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from chronogrid.operators import curves, layers, tables, text
from chronogrid.sources import readers
from chronogrid.streaming import entity_state


def png(rows):
    """An RGBA image of rows of (r, g, b, a)."""
    raw = b"".join(b"\0" + bytes(v for p in row for v in p) for row in rows)

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images_to_cells(spark, tmp_path):
    (tmp_path / "popc_1900.png").write_bytes(png([[(0, 0, 1, 2), (0, 0, 0, 0)], [(255, 255, 255, 255), (0, 0, 0, 7)]]))
    (tmp_path / "landuse500BC_number.png").write_bytes(png([[(51, 0, 0, 255), (0, 0, 0, 0)]]))
    got = {(r["layer"], r["yr"], r["r"], r["c"]): r["value"] for r in readers.read_raster_images(spark, str(tmp_path)).collect()}
    assert got == {("popc", 1900, 0, 0): 258.0, ("popc", 1900, 1, 0): 2.0**32 - 1, ("popc", 1900, 1, 1): 7.0, ("landuse", -500, 0, 0): (51 << 24) + 255}
    grey = readers.read_raster_images(spark, str(tmp_path), "grey").filter("layer = 'landuse'").collect()
    assert [(r["idx"], r["value"]) for r in grey] == [(0, 0.2)]


def test_text_grids(spark, tmp_path):
    (tmp_path / "area.asc").write_text("ncols 3\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 1\nNODATA_value -1\n 1.5 -1 0\n2 3e1 x\n")
    got = sorted((r["layer"], r["r"], r["c"], r["v"]) for r in readers.read_ascii_grid(spark, str(tmp_path)).collect())
    assert got == [("area", 0, 0, 1.5), ("area", 0, 2, 0.0), ("area", 1, 0, 2.0), ("area", 1, 1, 30.0)]


def test_tables_and_series(spark, tmp_path):
    (tmp_path / "t.csv").write_text('Entity,Year,Note\nA,1,"x, y"\nB,2,\nA,3,z\n')
    got = {(r["Entity"], r["name"]): r["values"] for r in readers.read_csv_grouped(spark, str(tmp_path / "t.csv")).collect()}
    assert got == {("A", "Year"): ["1", "3"], ("B", "Year"): ["2"], ("A", "Note"): ["x, y", "z"], ("B", "Note"): []}
    (tmp_path / "z.json").write_text(json.dumps({"north": {"population": {"1900": 1.5, "-50": "2", "bad": 1, "1910": None}}, "empty": {}}))
    got = {(r["zone"], r["yr"]): r["target"] for r in readers.read_nested_series_json(spark, str(tmp_path / "z.json"), 10).collect()}
    assert got == {("north", 1900): 15.0, ("north", -50): 20.0}


def test_features_round_trip(spark, tmp_path):
    ring = [[0, 0], [4, 0], [4, 3], [0, 0]]
    shapes = [{"type": "Feature", "properties": {"FromYear": 1}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"type": "Feature", "properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring, ring]]}}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/f.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": shapes}))
    features, vertices = readers.read_features_geojson(spark, str(tmp_path / "in"))
    assert features.count() == 2 and vertices.count() == 16
    readers.write_features_geojson(features, vertices, str(tmp_path / "out"))
    back = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(len(x["geometry"]["coordinates"]) for x in back) == [1, 2] and {x["properties"].get("FromYear") for x in back} == {"1", None}


def test_saves_and_snapshots(spark, tmp_path):
    history = json.dumps({"keyframes": {"100": {"value": [None, {"colour": "red"}, {"name": "a"}]}, "-5": {"value": [{"x": 1}]}}})
    (tmp_path / "s.json").write_text(json.dumps({"e1": {"class_name": "polygon", "history": history, "value": "{}"}}))
    entities, frames = readers.read_entity_save(spark, str(tmp_path / "s.json"))
    assert [tuple(r) for r in entities.collect()] == [("e1", "polygon", "{}")]
    assert sorted(map(str, ((r["ts"], r["slot"], r["k"], r["v"]) for r in frames.collect()))) == sorted(map(str, [(100, 0, None, None), (100, 1, "colour", "red"), (100, 2, "name", "a"), (-5, 0, "x", "1")]))
    readers.write_json_snapshot(frames, str(tmp_path / "snap"))
    assert spark.read.json(str(tmp_path / "snap")).count() == 4


def test_cells_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1900, 5, 70_000.4), ("b", -20, 6, 5e9), ("b", -20, 7, -3.0)], "layer string, yr int, idx long, value double")
    readers.write_cells(df, str(tmp_path / "cells"))
    back = spark.read.parquet(str(tmp_path / "cells")).select("idx", layers.from_channels(*map(F.col, "rgba")).alias("v"), "layer", "yr")
    assert sorted(tuple(r) for r in back.collect()) == [(5, 70_000.0, "a", 1900), (6, 2.0**32 - 1, "b", -20), (7, 0.0, "b", -20)]


def test_log_streams(spark, tmp_path):
    day = 86_400_000
    log = tmp_path / "in"
    log.mkdir()
    (log / "a.txt").write_text(f'e1 {{"type":"move","date":{day},"data":{{"x":"1"}}}}\nbroken\ne2 {{"type":"move","date":{3 * day},"data":{{"x":"2","y":null}}}}\n{{"date":1}}\ne3 {{bad\n')
    rows = entity_state.read_entity_log(spark, str(log))
    assert sorted((r["id"], r["data"]["x"]) for r in rows.collect()) == [("e1", "1"), ("e2", "2")]
    stream = entity_state.read_entity_log(spark, str(log), stream=True)
    query = entity_state.append_entity_log(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert {p.name for p in (tmp_path / "out").glob("day=*")} == {"day=1970.01.02", "day=1970.01.04"}
    back = entity_state.parse_log_lines(spark.read.text(str(tmp_path / "out")))
    assert sorted((r["id"], r["date"]) for r in back.collect()) == sorted((r["id"], r["date"]) for r in rows.collect())


def test_states_merge_by_date_not_arrival(spark, tmp_path):
    import datetime as dt

    schema = "id long, date timestamp_ntz, k string, v string"
    at = lambda d: dt.datetime(2024, 1, d)
    src = tmp_path / "src"
    batches = [[(1, at(5), "a", "new"), (1, at(1), "b", "x"), (2, at(2), "a", "z")], [(1, at(3), "a", "late"), (1, at(6), "b", None)]]
    results = []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        states = entity_state.entity_state_stream(entity_state.read_parquet_log(spark, str(src), schema))

        def keep(df, _):
            results.extend(df.collect())

        states.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination(120)
    last = {r["id"]: json.loads(r["state"]) for r in results}
    assert last == {1: {"a": "new"}, 2: {"a": "z"}}


def test_first_sightings_stream(spark, tmp_path):
    import datetime as dt

    rows = [("e1", dt.datetime(2024, 1, 1)), ("e1", dt.datetime(2024, 1, 2)), ("e2", dt.datetime(2024, 1, 1))]
    spark.createDataFrame(rows, "event_id string, date timestamp").write.parquet(str(tmp_path / "src"))
    stream = entity_state.first_sightings(entity_state.read_parquet_log(spark, str(tmp_path / "src"), "event_id string, date timestamp"), ["event_id"])
    stream.writeStream.format("memory").queryName("sightings").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r["event_id"] for r in spark.table("sightings").collect()) == ["e1", "e2"]


def test_spline_agrees_with_a_dense_solution():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (2, 3, 4, 9):
        x = np.cumsum(rng.integers(1, 9, n)).astype(float)
        y = rng.normal(size=n)
        h = np.diff(x)
        a, b = np.eye(n), np.zeros(n)
        for i in range(1, n - 1):
            a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
            b[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
        m = np.linalg.solve(a, b)
        at = np.linspace(x[0], x[-1], 40)
        k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
        p, q = (x[k + 1] - at) / h[k], (at - x[k]) / h[k]
        want = p * y[k] + q * y[k + 1] + ((p**3 - p) * m[k] + (q**3 - q) * m[k + 1]) * h[k] ** 2 / 6
        assert np.allclose(curves.natural_spline(x, y, at), want)


def test_spline_stays_between_samples(spark):
    series = spark.createDataFrame([("a", 0, 1.0), ("a", 10, 100.0), ("a", 20, 2.0), ("b", 5, 7.0), ("c", 0, 0.0), ("c", 4, 0.0)], "series_id string, x int, y double")
    asked = spark.createDataFrame([(s, x) for s in "abc" for x in (-5, 3, 10, 15, 30)], "series_id string, x int")
    got = {(r["series_id"], r["x"]): r["y"] for r in curves.spline_interpolate(series, asked).collect()}
    assert set(got) == {("a", 0), ("a", 3), ("a", 10), ("a", 15), ("a", 20), ("b", 5), ("c", 0), ("c", 3), ("c", 4)}
    assert 1 < got["a", 3] < 100 and 2 < got["a", 15] < 100 and got["b", 5] == 7 and got["c", 3] == 0


def test_markdown_chunks_keep_lists_and_budget():
    body = "an intro line\n- one\n- two\n- three\n" + "x" * 50 + "\nend"
    chunks = text.markdown_chunks(body, 30)
    assert "\n".join(chunks) == body and "- one\n- two\n- three" in chunks[1] and "x" * 50 in chunks
    assert text.markdown_chunks("\n\n", 30) == [] and text.markdown_chunks("", 30) == []


def test_unknown_names_in_equations_are_errors(spark):
    df = spark.createDataFrame([(1, 2.0)], "row_idx int, a double")
    with pytest.raises(ValueError):
        tables.operate_frames(df, df, {"x": "a$missing + 1"})
    with pytest.raises(ValueError, match="other is not known"):
        curves.series_map(df.withColumnRenamed("a", "y"), "other + 1").collect()


def test_lines_of_features_need_an_id(spark, tmp_path):
    with pytest.raises(ValueError, match="name the property"):
        readers.read_features_geojson(spark, str(tmp_path), lines=True)
    ring = [[0, 0], [4, 0], [4, 3], [0, 0]]
    shape = {"type": "Feature", "properties": {"name": "a", "n": 1}, "geometry": {"type": "Polygon", "coordinates": [ring]}}
    (tmp_path / "f.txt").write_text("\n".join([json.dumps(shape), "no json", json.dumps({**shape, "properties": {}}), ""]))
    features, vertices = readers.read_features_geojson(spark, str(tmp_path), lines=True, id_property="name")
    assert sorted(str(r["feature_id"]) for r in features.collect()) == ["None", "a"]
    assert vertices.filter("feature_id = 'a'").count() == 4
