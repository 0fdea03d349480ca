"""Polygons of rings and parts, nearest seeds, parts, rings and interior points against brute force."""

from __future__ import annotations

import json
import random
from collections import defaultdict

import pytest

from chronogrid.operators import polygons, regions
from chronogrid.sources import readers

SQUARE, HOLE = [[0, 0], [6, 0], [6, 6], [0, 6], [0, 0]], [[2, 2], [4, 2], [4, 4], [2, 4], [2, 2]]


def shifted(ring, dx, dy):
    return [[x + dx, y + dy] for x, y in ring]


@pytest.fixture(scope="module")
def shapes(spark, tmp_path_factory):
    """Polygons with a hole, with parts, with a part too small for a cell, and nothing but a speck, as files."""
    small = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    held = {
        "Hole": ("Polygon", [SQUARE, HOLE]),
        "Parts": ("MultiPolygon", [[shifted(small, 9, 8)], [shifted(small, 12, 11)]]),
        "Speck": ("MultiPolygon", [[shifted(small, 1, 14)], [[[17.6, 3.6], [17.7, 3.6], [17.7, 3.7], [17.6, 3.6]]]]),
        "Line": ("Polygon", [[[15, 15], [15, 15], [15, 15]]]),
    }
    folder = tmp_path_factory.mktemp("shapes")
    for name, (kind, coordinates) in held.items():
        feature = {"type": "Feature", "properties": {"name": name}, "geometry": {"type": kind, "coordinates": coordinates}}
        (folder / f"{name}.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature]}))
    return readers.read_features_geojson(spark, str(folder))[1]


def test_rings_and_parts_from_files(shapes):
    cells = defaultdict(set)
    for r in polygons.polygon_cells(shapes, 20, 18).collect():
        cells[r["feature_id"].split(".")[0]].add((17 - r["r"], r["c"]))
    assert len(cells["Hole"]) == 36  # each ring is filled
    assert cells["Parts"] == {(y, x) for y in (8, 9) for x in (9, 10)} | {(y, x) for y in (11, 12) for x in (12, 13)}
    assert cells["Speck"] == {(y, x) for y in (14, 15) for x in (1, 2)} | {(3, 17)} and cells["Line"] == {(15, 15)}
    centres = {r["feature_id"].split(".")[0]: (round(r["x"], 6), round(r["y"], 6)) for r in polygons.polygon_centroid(shapes).collect()}
    assert centres["Hole"] == (3, 3) and centres["Parts"] == (11.5, 10.5) and centres["Line"] == (15, 15)


def test_vertices_without_parts_are_one_ring(spark):
    rows = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(SQUARE[:-1])] + [(1, 9, None, 2.0)], "feature_id int, seq int, x double, y double")
    assert polygons.rasterise_polygons(rows, 10, 10).count() == 36
    assert polygons.polygon_centroid(rows).first()["x"] == 3
    assert polygons.rasterise_polygons(rows.limit(0), 10, 10).count() == polygons.polygon_centroid(rows.limit(0)).count() == 0


def within(ring, x, y):
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y1 <= y) != (y2 <= y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            hit = not hit
    return hit


def test_uneven_rings_match_a_test_of_every_centre(spark):
    rng = random.Random(4)
    rings = {(f, p, k): [(rng.uniform(-3, 28), rng.uniform(-3, 22)) for _ in range(rng.randrange(3, 9))] for f in range(4) for p in range(2) for k in range(2)}
    rows = [(*key, i, x, y) for key, ring in rings.items() for i, (x, y) in enumerate(ring)]
    got = polygons.rasterise_polygons(spark.createDataFrame(rows, "feature_id int, part int, ring int, seq int, x double, y double"), 25, 20)
    want = {}
    for (f, _, _), ring in rings.items():
        for y in range(20):
            for x in range(25):
                if within(ring, x + 0.5, y + 0.5):
                    want[19 - y, x] = max(f, want.get((19 - y, x), f))
    assert {(r["r"], r["c"]): r["feature_id"] for r in got.collect()} == want


def grid(spark, rows):
    return spark.createDataFrame(rows, "r int, c int, zone int")


@pytest.mark.parametrize("share", [0.01, 0.2, 0.7])
def test_nearest_seeds_match_all_pairs(spark, share):
    rng = random.Random(11)
    cells = [(r - 5, c - 9, rng.random() < share) for r in range(40) for c in range(30)]
    seeds = [(r, c) for r, c, is_seed in cells if is_seed]
    asked = [(r, c) for r, c, is_seed in cells if not is_seed][::3] + [(60, 4), (2, -30)]
    got = regions.nearest_seeds(spark.createDataFrame(asked, "r int, c int"), spark.createDataFrame(seeds + seeds[:3], "r int, c int")).collect()
    want = {(r, c): min(((r - a) ** 2 + (c - b) ** 2, a, b) for a, b in seeds) for r, c in asked}
    assert {(x["r"], x["c"]): (x["d2"], x["sr"], x["sc"]) for x in got} == want and len(got) == len(want)


def test_nearest_seeds_by_key_and_without_seeds(spark):
    asked = spark.createDataFrame([("a", 0, 0), ("b", 0, 0), ("c", 1, 1)], "k string, r int, c int")
    seeds = spark.createDataFrame([("a", 3, 4), ("b", 0, 2), ("b", 0, -2)], "k string, r int, c int")
    assert {(x["k"], x["sr"], x["sc"], x["d2"]) for x in regions.nearest_seeds(asked, seeds, ["k"]).collect()} == {("a", 3, 4, 25), ("b", 0, -2, 4)}
    assert regions.nearest_seeds(asked, seeds.limit(0), ["k"]).count() == 0
    cells = grid(spark, [(0, 0, -1), (0, 1, -1)])
    assert {tuple(x) for x in regions.nearest_seed_fill(cells, [-1], []).collect()} == {(0, 0, -1), (0, 1, -1)}


def brute_parts(rows):
    zone, part = {(r, c): z for r, c, z in rows}, {}
    for start in sorted(zone):
        open_ = [] if start in part else [start]
        while open_:
            r, c = at = open_.pop()
            part[at] = (start[0] << 32) + start[1]
            open_ += [n for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)) if zone.get(n) == zone[at] and n not in part]
    return part


def speckled(seed, height=24, width=30, classes=3):
    rng = random.Random(seed)
    return [(r, c, rng.choice([0] * 5 + list(range(classes)))) for r in range(height) for c in range(width) if rng.random() < 0.95]


def test_parts_match_a_flood_and_the_largest_gives_the_pole(spark):
    rows = speckled(2)
    part = brute_parts(rows)
    assert {(x["r"], x["c"]): x["part"] for x in regions.cell_parts(grid(spark, rows)).collect()} == part
    zone, sizes = {(r, c): z for r, c, z in rows}, defaultdict(int)
    for at, p in part.items():
        sizes[zone[at], p] += 1
    for z, r, c, d2 in (tuple(x) for x in regions.interior_pole(grid(spark, rows)).collect()):
        largest = min((-n, p) for (k, p), n in sizes.items() if k == z)[1]
        border = [(a, b) for (a, b), k in zone.items() if k == z and any(zone.get(n) != z for n in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)))]
        far = {at: min((at[0] - a) ** 2 + (at[1] - b) ** 2 for a, b in border) for at, p in part.items() if p == largest and zone[at] == z}
        assert (r, c, d2) == min((a, b, d) for (a, b), d in far.items() if d == max(far.values()))


def test_classes_that_share_cells(spark):
    rows = [(r, c, 1) for r in range(5) for c in range(5)] + [(r, c, 2) for r in range(2, 9) for c in range(2, 9)] + [(20, 20, 1)]
    got = {(x["zone"], x["r"], x["c"], x["d2"]) for x in regions.interior_pole(grid(spark, rows), overlapping=True).collect()}
    assert got == {(1, 2, 2, 4), (2, 5, 5, 9)}


def test_rings_nest_and_hold_every_side(spark):
    frame = [(r, c, 1) for r in range(9) for c in range(9) if not (2 <= r <= 6 and 2 <= c <= 6)]
    island = [(4, 4, 1)]
    corners = [(12, 0, 2), (13, 1, 2)]
    cells = grid(spark, frame + island + corners)
    rows = regions.region_rings(cells).collect()
    rings = defaultdict(dict)
    for x in rows:
        rings[x["zone"], x["part"], x["ring"]][x["seq"]] = (x["x"], x["y"])
    assert {k: len(v) - 1 for k, v in rings.items()} == {(1, 0, 0): 36, (1, 0, 1): 20, (1, 1, 0): 4, (2, 0, 0): 4, (2, 1, 0): 4}
    walked = set()
    for (zone, _, ring), points in rings.items():
        way = [points[i] for i in range(len(points))]
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(way, way[1:], strict=False))
        assert way[0] == way[-1] and way[0] == min(way[:-1], key=lambda p: (p[1], p[0])) and (area > 0) == (ring == 0)
        walked |= {(zone, *a, *b) for a, b in zip(way, way[1:], strict=False)}
    assert walked == {tuple(x) for x in regions.directed_edges(cells).collect()}
    assert regions.region_rings(cells.limit(0)).count() == 0


def test_a_long_ring_is_put_in_order(spark):
    spiral = {(0, c) for c in range(60)} | {(r, 59) for r in range(60)} | {(59, c) for c in range(2, 60)} | {(r, 2) for r in range(2, 60)} | {(2, c) for c in range(2, 58)}
    rows = regions.region_rings(grid(spark, [(r, c, 7) for r, c in spiral])).orderBy("seq").collect()
    assert {x["ring"] for x in rows} == {0} and all(abs(a["x"] - b["x"]) + abs(a["y"] - b["y"]) == 1 for a, b in zip(rows, rows[1:], strict=False))
