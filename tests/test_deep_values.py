"""Nested values, checked equations, states of entities, ways and fused series, beyond what the registered queries hold."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from chronogrid.functions.expressions import checked
from chronogrid.operators import curves, matrix, nested, pages, series, tables
from chronogrid.streaming import entity_state

DEEP = {"a": {"b": {"c": {"d": {"e": 1, "x.y": "2"}}}}, "n": [1, {"f": 2}], "t": True, "z": None, "s": "text", "e": 4.5}


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(1, json.dumps(DEEP)), (2, None), (3, ""), (4, "[1, 2]"), (5, "{broken"), (6, "{}"), (7, ' {"e": "6", "quote\'d": {"k": 1}}')]
    return spark.createDataFrame(rows, "id int, json string")


def test_paths_of_deep_objects(texts):
    got = {(r["id"], r["path"]): r["depth"] for r in nested.json_paths(texts, "json", "id").collect()}
    want = {"a": 1, "a.b": 2, "a.b.c": 3, "a.b.c.d": 4, "a.b.c.d.e": 5, "a.b.c.d.x.y": 5, "n": 1, "t": 1, "z": 1, "s": 1, "e": 1}
    assert got == {(1, p): d for p, d in want.items()} | {(7, "e"): 1, (7, "quote'd"): 1, (7, "quote'd.k"): 2}
    objects = {(r["id"], r["path"]) for r in nested.json_paths(texts, "json", "id", objects_only=True, exclude=["d"]).collect()}
    assert objects == {(1, "a"), (1, "a.b"), (1, "a.b.c"), (7, "quote'd")}
    kinds = {tuple(r["path"]): r["kind"] for r in nested.walk(texts.filter("id = 1"), "json", "id").collect()}
    assert {kinds[k,] for k in "ntzse"} == {"array", "boolean", "null", "string", "number"}
    assert {r["id"]: r["depth"] for r in nested.json_depth(texts, "json", "id").collect()} == {1: 5, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, 7: 2}


def test_values_and_sums_of_deep_objects(texts):
    at = lambda path: [r[0] for r in texts.orderBy("id").select(nested.value_at(F.col("json"), path)).collect()]
    assert at("a.b.c.d.e")[0] == "1" and at("n")[0] == '[1,{"f":2}]' and at("a.b.q") == [None] * 7 and at("quote'd.k")[6] == "1"
    assert {r["leaf"]: r["total"] for r in nested.flatten_sum(texts, "json").collect()} == {"e": 11.5, "x.y": 2.0, "k": 1.0}
    assert nested.flatten_sum(texts.limit(0), "json").count() == 0


def test_typed_values_of_five_levels(spark):
    kind = "id int, v array<map<string,array<map<string,array<int>>>>>"
    rows = [(1, [{"a": [{"b": [1, None, 0]}, None]}, None]), (2, None), (3, []), (4, [{"a": None, "c": [{"d": [7]}]}])]
    df = spark.createDataFrame(rows, kind)
    assert {r["id"]: r["n"] for r in nested.cardinality(df, "v", ["id"]).collect()} == {1: 3, 2: 0, 3: 0, 4: 1}
    assert {r["id"]: (r["low"], r["high"], r["total"], r["mean"]) for r in nested.nested_extrema(df, ["id"], "v").collect()} == {1: (0, 1, 1, 0.5), 4: (7, 7, 7, 7)}
    kept = {r["id"]: r["v"] for r in nested.clean(df, "v").collect()}
    assert kept[1] == [{"a": [{"b": [1, 0]}]}] and kept[4] == [{"c": [{"d": [7]}]}] and kept[2] is None
    assert {r["id"]: r["v"] for r in nested.clean(df, "v", True).collect()}[1] == [{"a": [{"b": [1]}]}]
    words = spark.createDataFrame([(1, [[["pan", "cup"], None], [["an"]]]), (2, [[["cup"]]])], "id int, w array<array<array<string>>>")
    assert {r["id"]: r["w"] for r in nested.filter_substring(words, "w", "an").collect()} == {1: ["pan", "an"]}
    pair = spark.createDataFrame([(1, ((2, [3]), 4))], "id int, s struct<p:struct<a:int,b:array<int>>,c:int>")
    assert nested.cardinality(pair, "s", ["id"]).first()["n"] == 3


@pytest.mark.parametrize("equation", [
    "reflect('java.lang.System','getProperty','user.home')", "java_method(n)", "n; n", "`n`", "other + 1", "(SELECT 1)", "n + 'x'", "n[0]", "x -> n", "n.m", "abs (n", "n)", "", "exp", "1abs(n)", "raise_error(n)", "n -- 1 /* x */", "date '2000-01-01'", "current_user()",
])
def test_only_arithmetic_is_let_through(spark, equation):
    with pytest.raises(ValueError):
        checked(equation, {"n"})
    df = spark.createDataFrame([(1, 2, 3.0)], "series_id int, x int, y double")
    with pytest.raises(ValueError):
        curves.series_map(df, equation)
    with pytest.raises(ValueError):
        series.series_zip(df, df, expression=equation.replace("n", "i") or "y")


def test_equations_give_what_they_say(spark):
    df = spark.createDataFrame([("s", 1, 4.0), ("s", 2, -1.0), ("s", 3, None)], "series_id string, x int, y double")
    out = curves.series_map(df, "CASE WHEN n >= 0 THEN Sqrt(n) * 2e0 ELSE -n / 4 END + (1 - .5) % 2")
    assert [r["y"] for r in out.orderBy("x").collect()] == [4.5, 0.75, None]
    frame = spark.createDataFrame([(0, 3.0), (1, 5.0)], "row_idx int, v double")
    done = tables.operate_frames(frame, frame.filter("row_idx = 0"), {"w": "greatest(a$v, b$v) - if(b$v = 0, 1, 0)"})
    assert {r["row_idx"]: r["w"] for r in done.collect()} == {0: 3.0, 1: 4.0}


def test_way_of_many_nodes(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(40)] + [(0, 40, 99.0), (7, 90, 1.0)], "src int, dst int, cost double")
    way = matrix.shortest_path(edges, 0, 40).orderBy("step").collect()
    assert [(r["step"], r["node"], r["cost"]) for r in way] == [(i, i, float(i)) for i in range(41)]
    assert [tuple(r) for r in matrix.shortest_path(edges, 5, 5).collect()] == [(0, 5, 0.0)]
    assert matrix.shortest_path(edges, 0, 1000).count() == 0


def test_several_neighbours_are_worked_in_one_after_another(spark):
    truth = spark.createDataFrame([("a", 1.0, 1.0), ("b", 40.0, 40.0), ("c", 1.0, 1.001)], "city_id string, lat double, lng double")
    near = spark.createDataFrame([(3, 1.0, 1.0), (1, 1.001, 1.0), (2, 1.0, 1.002)], "city_id int, lat double, lng double")
    gt = spark.createDataFrame([("a", 0, 90.0), ("a", 10, 50.0), ("a", 30, 70.0), ("b", 5, 1.4), ("a", 40, None)], "series_id string, x int, y double")
    rr = spark.createDataFrame([(1, 0, 40.0), (1, 20, 60.0), (2, 5, 3.0), (2, 25, 80.0), (2, 50, 10.0), (3, 15, 20.0)], "series_id int, x int, y double")
    got = {(r["series_id"], r["x"]): r["y"] for r in curves.fuse_city_series(truth, gt, near, rr).collect()}
    want = {}
    for city in "ac":
        fused = gt.filter((F.col("series_id") == city) & F.col("y").isNotNull())
        for b in (1, 2, 3):
            own = rr.filter(F.col("series_id") == b).withColumn("series_id", F.lit(city))
            at = series.linear_interpolate(own, fused).select("series_id", "x", F.col("y").alias("other"))
            mean = F.when((F.col("y") > F.col("other")) & (F.col("other") != 0), (F.col("y") + F.col("other")) / 2).otherwise(F.col("y"))
            met = fused.join(at, ["series_id", "x"], "left").select("series_id", "x", mean.alias("y"))
            new = curves.interpolate_gt(met, own).select("series_id", "x", F.floor(F.col("y") + 0.5).cast("double").alias("y")).collect()
            fused = spark.createDataFrame(new, "series_id string, x int, y double")
        want |= {(r["series_id"], r["x"]): r["y"] for r in fused.collect()}
    assert got == want | {("b", 5): 1.4} and len([k for k in got if k[0] == "a"]) > 4


def test_tables_in_tables(spark):
    html = "<table><tr><td>one</td><td>out <table><tr><th>in <b>bold</b> &lt;</th><td><a href='/x'>link</a><td>last</table> side</td></tr><tr><td>next<td>end</table><td>lost</td><table><tr><td><br>x</td></tr></table>"
    rows = pages.html_table_cells(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id int, html string")).collect()
    got = {(r["table"], r["r"], r["c"]): (r["text"], r["linked"], r["html"]) for r in rows}
    inner = "<table><tr><th>in <b>bold</b> &lt;</th><td><a href='/x'>link</a><td>last</table>"
    assert got == {
        (0, 0, 0): ("one", False, "one"), (0, 0, 1): got[0, 0, 1],
        (1, 0, 0): ("in bold <", False, "in <b>bold</b> &lt;"), (1, 0, 1): ("link", True, "<a href='/x'>link</a>"), (1, 0, 2): ("last", False, "last"),
        (0, 1, 0): ("next", False, "next"), (0, 1, 1): ("end", False, "end"), (2, 0, 0): ("x", False, "<br>x"),
    }
    text, linked, held = got[0, 0, 1]
    assert text.split() == "out in bold <linklast side".split() and linked and held == f"out {inner} side"


LOG = "id string, date timestamp, seq long, k string, v string"


def states(spark, tmp_path, batches, **options):
    """The state of every entity after batches of (id, date text, seq, k, v), each a run of its own from one checkpoint."""
    src, out = tmp_path / "src", {}
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "id string, d string, seq long, k string, v string")
        df.select("id", F.col("d").cast("timestamp").alias("date"), "seq", "k", "v").coalesce(1).write.mode("append").parquet(str(src))
        stream = entity_state.entity_state_stream(entity_state.read_parquet_log(spark, str(src), LOG), **options)
        seen = []
        held = stream.select("id", F.unix_micros(F.col("date").cast("timestamp")).alias("us"), "state")
        query = held.writeStream.foreachBatch(lambda df, _, seen=seen: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "check")).outputMode("update").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        out |= {r["id"]: (r["us"], json.loads(r["state"])) for r in seen}
    return out


def test_states_of_old_dates_ties_and_restarts(spark, tmp_path):
    batches = [
        [("a", "-10000-03-01 00:00:00", 1, "name", "camp"), ("a", "1500-01-01 00:00:00", 3, "name", "town"), ("b", "2000-01-01 00:00:00", 5, "k", "second"), ("b", "2000-01-01 00:00:00", 4, "k", "first"), (None, "2000-01-01 00:00:00", 1, "k", "lost"), ("c", None, 1, "k", "lost")],
        [("a", "-9000-01-01 00:00:00", 9, "name", "late"), ("a", "-9000-01-01 00:00:00", 9, "ruler", "none"), ("b", "2000-01-01 00:00:00", 3, "k", "zeroth"), ("b", "2001-01-01 00:00:00", 1, "k", None)],
    ]
    got = states(spark, tmp_path, batches)
    assert {k: v for k, (_, v) in got.items()} == {"a": {"name": "town", "ruler": "none"}, "b": {}}
    assert got["a"][0] == spark.sql("SELECT unix_micros(timestamp '1500-01-01 00:00:00')").first()[0]


def test_states_are_forgotten(spark, tmp_path):
    """The timer of an entity runs out while the query waits for more."""
    src, seen = tmp_path / "src", []
    add = lambda k: spark.createDataFrame([("a", 1, k, "v")], "id string, seq long, k string, v string").withColumn("date", F.current_timestamp()).select("id", "date", "seq", "k", "v").coalesce(1).write.mode("append").parquet(str(src))
    add("first")
    stream = entity_state.entity_state_stream(entity_state.read_parquet_log(spark, str(src), LOG), expire_after_ms=1)
    query = stream.select("state").writeStream.foreachBatch(lambda df, _: seen.extend(r["state"] for r in df.collect())).option("checkpointLocation", str(tmp_path / "check")).outputMode("update").trigger(processingTime="1 second").start()
    try:
        for n, k in ((1, "second"), (2, None)):
            end = time.time() + 60
            while len(seen) < n and time.time() < end:
                time.sleep(0.5)
            # a batch without rows lets the timers run out
            while k and time.time() < end and (query.lastProgress or {"batchId": 0})["batchId"] < 1:
                time.sleep(0.5)
            if k:
                add(k)
    finally:
        query.stop()
    assert [json.loads(x) for x in seen] == [{"first": "v"}, {"second": "v"}]


def test_newest_files_first(spark, tmp_path):
    for day, ids in (("2001.01.01", "ab"), ("2001.01.02", "cd")):
        (tmp_path / day).write_text("\n".join(f'{i} {{"type":"t","date":{n},"data":{{}}}}' for n, i in enumerate(ids)) + "\nbroken\n")
    assert [r["id"] for r in entity_state.read_newest_first(spark, str(tmp_path)).collect()] == ["d", "c", "b", "a"]


def test_images_by_their_ending(spark):
    from chronogrid.functions.strings import is_image

    told = {"https://x/a.png": True, "http://x.svg": True, "https://.png": False, "https://x/a.PNG": False, "ftp://x/a.png": False, "x/a.png": False, "https://x/a.png?y": False, "https://x/png": False, "https://": False, "": False}
    df = spark.createDataFrame([(k,) for k in told], "t string").select("t", is_image(F.col("t")).alias("is"))
    assert {r["t"]: r["is"] for r in df.collect()} == told
