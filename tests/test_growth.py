"""What lets a query grow with its tables: work dealt to many tasks, few rows sent, small batches held."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from chronogrid.operators import raster, regions
from chronogrid.sources.views import view

SF = "/root/testdata/sf0.001"


def test_the_grid_is_made_by_many_tasks(spark):
    for name in ("field_cells", "field_values", "field_zones"):
        parts = view(spark, SF, name).groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(parts) > 4 and max(p["count"] for p in parts) < sum(p["count"] for p in parts) / 3, name


def test_the_grid_has_as_many_parts_as_the_session(spark):
    n = 16 * spark.sparkContext.defaultParallelism
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        parts = view(spark, SF, "field_cells").groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert n / 4 < len(parts) <= n and max(p["p"] for p in parts) < n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)


@pytest.mark.parametrize("block", [2, 3, 256])
def test_sums_around_cells_over_the_borders_of_blocks(spark, block):
    rng = random.Random(5)
    rows = [("a", 1, rng.randrange(-9, 9), rng.randrange(12), rng.choice([None, 1.0, 2.0, 5.0])) for _ in range(150)]
    cells = spark.createDataFrame(rows, "layer string, yr int, r int, c int, value double")
    got = sorted((r["r"], r["c"], r["value"], r["around"]) for r in raster._around(cells, block=block).filter("value is not null").collect())
    want = []
    for r, c in sorted({(x[2], x[3]) for x in rows}):
        own = [x[4] for x in rows if x[2:4] == (r, c) and x[4] is not None]
        near = [x[4] or 0.0 for x in rows if max(abs(x[2] - r), abs(x[3] - c)) == 1]
        if own:
            want.append((r, c, max(own), float(sum(near))))
    assert got == want
    assert raster._around(cells, each=True, block=block).count() == len(rows)


def test_outliers_are_told_in_the_pass_that_sums(spark):
    cells = view(spark, SF, "field_values")
    plan = raster.replace_outliers(cells, cells, 10, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1  # the fallback's alone


def test_cells_are_dealt_to_parts_that_the_engine_does_not_join(spark):
    cells = view(spark, SF, "field_cells")
    for df in (regions.nearest_seed_fill(cells, [-1], []), regions.interior_pole(cells, largest=False)):
        plan = df._jdf.queryExecution()
        joins = [line for line in plan.optimizedPlan().toString().split("\n") if "Join" in line]
        # those that the view itself makes, and the one row of bounds
        assert all("Join Cross" in line or "Join Inner" in line and "rightHint" in line for line in joins), joins
        dealt = [line for line in plan.executedPlan().toString().split("\n") if "Exchange hashpartitioning(r#" in line or "Exchange hashpartitioning(c#" in line]
        assert len([line for line in dealt if "REPARTITION_BY_NUM" in line]) > 1
        # what else is dealt are the distinct numbers that the grid is crossed from
        assert not [line for line in dealt if "ENSURE_REQUIREMENTS" in line and "(r#" in line and ", c#" in line], dealt


def test_filled_cells_carry_their_seed_and_repeated_cells_stay(spark):
    cells = spark.createDataFrame([(0, 0, 5), (0, 4, 7), (0, 4, 7), (0, 2, -1), (0, 3, -1), (0, 3, -1), (9, 9, -2), (3, 3, None)], "r int, c int, zone int")
    got = sorted((r["r"], r["c"], r["zone"] or 0) for r in regions.nearest_seed_fill(cells, [-1], [-2]).collect())
    assert got == [(0, 0, 5), (0, 2, 5), (0, 3, 7), (0, 3, 7), (0, 4, 7), (0, 4, 7), (3, 3, 0), (9, 9, -2)]
    alone = regions.nearest_seed_fill(cells.filter("zone < 0"), [-1], [-2]).collect()
    assert sorted(map(tuple, alone)) == [(0, 2, -1), (0, 3, -1), (0, 3, -1), (9, 9, -2)]


def test_scalars_do_not_deal_cells_by_year(spark):
    from chronogrid.operators import scaling

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cells = spark.createDataFrame([("a", 1, 7, 2.0)], "layer string, yr int, idx long, value double")
        zones, control = spark.createDataFrame([(7, 1)], "idx long, zone int"), spark.createDataFrame([(1, 1, 9.0)], "zone int, yr int, target double")
        totals = control.select("yr", "target")
        for df in (scaling.scale_to_global(cells, totals), scaling.scale_to_zones(cells, zones, control), scaling.distribute_total(cells, totals), scaling.standardise_max(cells)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert not [line for line in plan.split("\n") if "SortMergeJoin" in line and "[layer#" in line]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cities_are_folded_many_at_a_time(spark, monkeypatch):
    from chronogrid.operators import curves

    cities = spark.createDataFrame([(i, float(i // 2), 0.0) for i in range(40)], "city_id long, lat double, lng double")
    gt = spark.createDataFrame([(i, x, 10.0 * x + i) for i in range(0, 40, 3) for x in (0, 10)], "series_id long, x int, y double")
    rr = spark.createDataFrame([(i, x, 5.0 * x + 1) for i in range(0, 40, 2) for x in (0, 5, 20)], "series_id long, x int, y double")
    out = curves.fuse_city_series(cities, gt, cities.unionAll(cities), rr)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "CoGroup" not in plan
    # a city without points of its own has its neighbour's, one without neighbours its own; a pair that repeats counts once
    got = {}
    for r in out.collect():
        got.setdefault(r["series_id"], []).append((r["x"], r["y"]))
    assert sorted(got) == list(range(40)) and sorted(got[1]) == [(0, 1.0), (5, 26.0), (20, 101.0)]
    assert all(len(v) == len({x for x, _ in v}) for v in got.values())
    alone = curves.fuse_city_series(cities, gt, cities.limit(0), rr)
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, gt.collect()))


def test_cities_of_one_place_and_series_are_folded_once(spark, monkeypatch):
    import numpy as np
    import pandas as pd

    from chronogrid.operators import curves

    cities = spark.createDataFrame([(i, float(i // 30), 0.0) for i in range(90)] + [(59, 0.0, 0.0)], "city_id long, lat double, lng double")
    gt = spark.createDataFrame([(i, x, 90.0 + i % 3 * x) for i in range(50) for x in (0, 10)], "series_id long, x int, y double")
    rr = spark.createDataFrame([(i, x, 5.0 * x + 1 + i % 2) for i in range(90) for x in (0, 5, 20)], "series_id long, x int, y double")
    got = {}
    for r in curves.fuse_city_series(cities, gt, cities, rr).collect():
        got.setdefault(r["series_id"], []).append((r["x"], r["y"]))
    # each city on its own, over the neighbours in their order
    series = lambda rows: tuple(np.array(v) for v in zip(*[(x, y) for x, y in sorted(rows)], strict=True)) or (np.zeros(0, int), np.zeros(0))
    at = lambda i: {i // 30, 0} if i == 59 else {i // 30}
    for i in range(90):
        x, y = series([(x, 90.0 + i % 3 * x) for x in (0, 10) if i < 50])
        for b in range(90):
            if at(i) & at(b):
                there = curves._on_segment(*series([(t, 5.0 * t + 1 + b % 2) for t in (0, 5, 20)]), x) if len(x) else y
                x, y = curves._carried(x, np.where((y > there) & (there != 0), (y + there) / 2, y), *series([(t, 5.0 * t + 1 + b % 2) for t in (0, 5, 20)]))
                y = np.floor(y + 0.5)
        assert sorted(got[i]) == list(zip(x.tolist(), y.tolist(), strict=True)), i

    def told(batches):
        for pdf in batches:
            yield pd.DataFrame({"k": pdf["k"], "x": 0, "y": np.random.default_rng().random(len(pdf))})

    monkeypatch.setattr(curves, "_folded", told)
    rows = curves.fuse_city_series(cities, gt, cities, rr).collect()
    # three kinds of series at each of two places, none at the second and at the third, whose neighbours are as the second's, and the city
    # that stands at both
    assert len(rows) == 90 and len({r["y"] for r in rows}) == 8


def test_a_series_that_changes_nothing_is_not_worked_in_again(monkeypatch):
    import numpy as np

    from chronogrid.operators import curves

    calls, whole = [], curves._carried
    monkeypatch.setattr(curves, "_carried", lambda *a: calls.append(1) or whole(*a))
    x, y, others = np.array([0, 10]), np.array([90.0, 40.0]), [(np.array([0, 5, 20]), np.array([1.0, 26.0, 101.0]))] * 500
    out = curves._fold(x, y, others)
    assert len(calls) < 40
    monkeypatch.setattr(curves, "_same", lambda a, b: False)
    assert all(map(np.array_equal, out, curves._fold(x, y, others)))


def test_cells_of_a_page_are_given_as_they_are_closed():
    from chronogrid.operators import pages

    inner = "<table><tr><td>in &amp; <a href='x'>side</a></table>"
    html = "<p>start<table id='tbl'>" + "".join(f"<tr><td>{i}<td><b>b&eacute;{i}</b><!-- x -->" for i in range(300)) + f"<tr><td>{inner}<td>last</table><table><tr><td>open"
    want = sorted((t, r, c, "".join(x), link, "".join(h)) for t, r, c, x, link, h in pages.Reader(html).cells)
    for piece in (7, 64, 1 << 20):
        given = list(pages.table_cells(html, piece))
        assert sorted((t, r, c, "".join(x), link, "".join(h)) for g in given for t, r, c, x, link, h in g) == want
        assert piece > 64 or max(map(len, given)) < 30


def test_the_state_store_is_read_once_for_an_entity():
    import pandas as pd

    from chronogrid.streaming.entity_state import MergedState

    class Held(dict):
        calls = 0

        def iterator(self):
            self.calls += 1
            return iter(list(self.items()))

        def getValue(self, key):
            self.calls += 1
            return self.get(key)

        def updateValue(self, key, value):
            self.calls += 1
            self[key] = value

    state = MergedState(None)
    state.held = Held({("a",): (5, 1, "old"), ("b",): (9, 1, "kept")})
    rows = pd.DataFrame({"k": ["a", "b", "c"], "us": [6, 8, 7], "seq": [1, 1, 1], "v": ["new", "late", None]})
    told = next(iter(state.handleInputRows(("x",), iter([rows]), None)))
    assert told["state"][0] == '{"a": "new", "b": "kept"}' and told["us"][0] == 9
    assert state.held.calls == 3 and state.held[("c",)] == (7, 1, None)
