"""Junctions, crossings, chains and the export against plain loops on small scenes."""

from __future__ import annotations

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import export as E
from waymark.operators import junctions as J
from waymark.operators import network as N
from waymark.operators import raster as R
from waymark.plans.queries import queries

COORDS = "array<struct<x:double,y:double,z:double>>"


def _unit(angle):
    return math.cos(angle), math.sin(angle)


def _plain_kind(directions):
    """The rule as loops: ways by a running sum, then the most opposed way of each."""
    left, found = list(range(len(directions))), []
    while left:
        i = left.pop(0)
        x, y = directions[i]
        for j in list(left):
            if x * directions[j][0] + y * directions[j][1] > 0.94:
                x, y = x + directions[j][0], y + directions[j][1]
                left.remove(j)
        n = math.hypot(x, y)
        found.append((x / n, y / n) if n else (x, y))
    if len(found) < 3:
        return "None", 0
    if len(found) == 3:
        return "Switch", 1
    through, paired = [], set()
    for a in range(len(found)):
        best, other = 0.0, None
        for b in range(a + 1, len(found)):
            dot = found[a][0] * found[b][0] + found[a][1] * found[b][1]
            if a not in paired and b not in paired and dot < best:
                best, other = dot, b
        if other is not None and best < -0.85:
            paired |= {a, other}
            through.append(found[a])
    if len(through) > 1 and math.degrees(math.acos(min(1, abs(through[0][0] * through[1][0] + through[0][1] * through[1][1])))) > 30:
        return "Diamond", 0
    return ("DoubleSwitch" if len(found) == 4 else "Switch"), len(found) - 2


def test_junction_kinds_equal_a_plain_loop():
    rng = random.Random(4)
    for _ in range(20_000):
        directions = [_unit(rng.uniform(0, 2 * math.pi)) for _ in range(rng.randint(2, 7))]
        assert N.junction_class(directions) == _plain_kind(directions)


def test_junction_query_equals_a_plain_loop(spark):
    sf = "/root/testdata/sf0.001"
    rows = {}
    from waymark.sources.adapters import relation

    for r in relation(spark, sf, "roads").orderBy("id").collect():
        dx, dy = r.x2 - r.x1, r.y2 - r.y1
        rows.setdefault(r.id % 200, []).append((dx / math.hypot(dx, dy), dy / math.hypot(dx, dy)))
    got = {r.node: (r.kind, r.n_switches) for r in queries()["junction_kinds"](spark, sf).collect()}
    assert got == {n: _plain_kind(d) for n, d in rows.items()}


def test_gap_fill_query_equals_a_plain_loop(spark):
    sf = "/root/testdata/sf0.001"
    from waymark.sources.adapters import relation

    grids = {}
    for r in relation(spark, sf, "cells").where("tile_id < 40").collect():
        grids.setdefault(r.tile_id, [None] * 64)[r.idx] = r.elevation
    for g in grids.values():
        for _ in range(10):
            for k in range(64):
                if g[k] is None:
                    near = [g[j] for j, ok in ((k - 8, k >= 8), (k + 8, k < 56), (k - 1, k % 8), (k + 1, k % 8 < 7)) if ok and g[j] is not None]
                    if near:
                        g[k] = sum(near) / len(near)
    for r in queries()["gap_fill"](spark, sf).where("tile_id < 40").collect():
        assert r.elevation == pytest.approx(grids[r.tile_id][r.idx])


def test_loops_alone_have_no_chain():
    loop = [(0.0, 0.0, 0.0), (50.0, 50.0, 0.0), (1.0, 1.0, 0.0)]
    assert N.longest_chain([(1, loop)]) == loop
    assert N.longest_chain([(1, loop), (2, [(90.0, 0.0, 0.0), (99.0, 40.0, 0.0), (91.0, 1.0, 0.0)])]) == []


def test_components_that_do_not_settle_are_an_error(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.root for r in N.forest_components(path).collect()} == {0}
    with pytest.raises(RuntimeError):
        N.forest_components(path, most_rounds=1)


def _line(i, name, points, medium=" "):
    return i, name, medium, [(float(x), float(y), 0.0) for x, y in points]


def test_track_junctions_of_a_scene(spark):
    lines = [
        _line(1, "A", [(0, 0), (100, 0)]),
        _line(2, "A", [(100, 0), (200, 0)]),
        _line(3, "B", [(100, 4), (140, 60), (160, 100)]),  # a switch within 10 m
        _line(4, "A", [(200, 0), (300, 0)]),
        _line(5, "C", [(200, 0), (200, 90)], "U"),  # a tunnel passes under
        _line(6, "A", [(300, 0), (400, 0)]),
        _line(7, "D", [(300, 0), (300, 80)]),
        _line(8, "D", [(300, 0), (300, -80)]),  # two ways through
        _line(9, "A", [(0.3, 0), (100, 0)]),  # repeats 1
    ]
    points = [("A", float(k) / 100, 5.0 + k / 100, " ", float(k), 0.0, k) for k in range(0, 401, 20)] + [(n, 0.0, 1.0, " ", 900.0, 900.0, 0) for n in "BCD"]
    got = J.track_junctions(spark.createDataFrame(lines, f"seg_id long, name string, medium string, coords {COORDS}"), spark.createDataFrame(points, "line_id string, km double, elevation double, medium string, x double, y double, event_id long")).collect()
    of_a = sorted((r.km, r.kind, r.n_switches, r.description) for r in got if r.line_id == "A")
    assert of_a == [(1.0, "Switch", 1, "B"), (2.0, "Overpass", 0, "C"), (3.0, "Diamond", 0, "D")]
    # The others meet the same nodes; their profiles are far off, yet found.
    assert {(r.line_id, r.kind) for r in got if r.line_id != "A"} == {("B", "Switch"), ("C", "Underpass"), ("D", "Diamond")}


def test_direction_walks_fifty_metres(spark):
    rows = spark.createDataFrame([(1, [(0.0, 0.0, 0.0), (30.0, 0.0, 0.0), (30.0, 30.0, 0.0), (30.0, 90.0, 0.0)], 0.0, 0.0), (2, [(9.0, 90.0, 0.0), (0.0, 10.0, 0.0), (0.0, 0.0, 0.0)], 0.0, 0.0), (3, [(0.0, 0.0, 0.0), (3.0, 4.0, 0.0)], 0.0, 0.0)], f"id long, coords {COORDS}, x double, y double")
    got = {r.id: r.d for r in rows.select("id", J.direction("coords", F.col("x"), F.col("y")).alias("d")).collect()}
    assert (got[1].dx, got[1].dy) == pytest.approx((math.sqrt(0.5), math.sqrt(0.5)))
    assert (got[2].dx, got[2].dy) == pytest.approx((9 / math.hypot(9, 90), 90 / math.hypot(9, 90)))
    assert (got[3].dx, got[3].dy) == pytest.approx((0.6, 0.8))


def test_rail_crossings_by_roads(spark):
    points = [("A", float(k) / 10, 10.0, "U" if 40 <= k < 60 else " ", k * 100.0, 0.0, k) for k in range(100)]
    frame = spark.createDataFrame(points, "line_id string, km double, elevation double, medium string, x double, y double, event_id long")
    road = lambda i, x, z, kat="E", n=6: (i, kat, n, x, -50.0, z, x, 50.0, z)
    roads = [road(1, 1010.0, 12.0), road(2, 1110.0, 12.0), road(3, 1160.0, 12.0), road(4, 3010.0, 30.0), road(5, 5010.0, 10.0), road(6, 7010.0, 1.0, "R", 7), road(7, 8010.0, 10.0, "P", 1)]
    got = J.road_crossings(frame, spark.createDataFrame(roads, "id long, kategori string, nummer int, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double"), 300.0).collect()
    # Three of one road within 200 m are one, at the middle; private roads don't count.
    assert sorted((r.description, round(r.km, 3), r.kind, r.n_hits) for r in got) == [("E6", 1.11, "Level", 3), ("E6", 3.01, "RoadOverpass", 1), ("E6", 5.01, "RoadOverpass", 1), ("Rv7", 7.01, "RoadUnderpass", 1)]
    every = J.all_junctions(spark.createDataFrame([], f"seg_id long, name string, medium string, coords {COORDS}"), frame, spark.createDataFrame(roads, "id long, kategori string, nummer int, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double"), 300.0).collect()
    assert [r.kind for r in every] == ["RoadLevel", "RoadOverpass", "RoadOverpass", "RoadUnderpass"]


def test_export_of_a_scene(spark, tmp_path):
    tracks = spark.createDataFrame([(0, "A", 0, " ", 1, [80, 0], [(100.0, 100.0, 5.0), (700.0, 200.0, 6.0)]), (1, "", 1, "U", 0, [0, 0], [(650.0, 210.0, 5.0), (700.0, 300.0, 6.0)])], f"track_id long, line string, type int, medium string, electrified int, speeds array<int>, coords {COORDS}")
    roads = spark.createDataFrame([(3, "E", 6, [(0.0, 0.0, 1.0), (300.0, 300.0, 2.0)])], f"road_id long, kategori string, nummer long, coords {COORDS}")
    stations = spark.createDataFrame([('Stop "1"', 120.0, 100.0, 5.0, "S", "A")], "name string, x double, y double, z double, type string, line string")
    connections = spark.createDataFrame([(1, 0, 650.0, 210.0, 5.0)], "trackA long, trackB long, x double, y double, z double")
    rasters = spark.createDataFrame([(1, -4000.0, 4000.0, 100.0, 80, 80, [7.0] * 6400)], "tile_id long, x0 double, y0 double, step double, width int, height int, cells array<double>")
    levels = [(0, 8.0, 0.0, 200.0), (1, 16.0, 200.0, 1000.0)]
    done = E.export(tracks, roads, stations, connections, rasters, 1000.0, levels, 64, 1500.0, 1000.0)
    tiles = {(r.lod, r.col, r.row) for r in done.tiles.collect()}
    assert (0, 0, 0) in tiles and (0, 1, 0) in tiles
    assert {(r.lod, r.col, r.row): r.n for r in done.tracks.collect()} == {(0, 0, 0): 1, (0, 1, 0): 2}
    meta = {(r.lod, r.col, r.row): json.loads(r.meta) for r in done.meta.collect()}
    assert set(meta) == tiles
    assert meta[0, 0, 0]["stations"][0]["name"] == 'Stop "1"' and meta[0, 0, 0]["trackSegments"] == 1 and meta[0, 0, 0]["roadSegments"] == 1
    assert meta[0, 1, 0]["connections"] == [{"trackA": 1, "trackB": 0, "x": 650.0, "y": 210.0, "z": 5.0}] and meta[0, 1, 0]["stations"] == []
    whole = json.loads(done.manifest.first().manifest)
    assert whole["stats"]["totalTiles"] == len(tiles) and whole["stats"]["n_main"] == 1 and whole["stats"]["n_siding"] == 1
    assert [v["count"] for v in whole["lodLevels"]] == [sum(t[0] == k for t in tiles) for k in (0, 1)]
    terrain = done.terrain.collect()
    assert {(r.lod, r.col, r.row) for r in terrain} == tiles and all(len(r.block) == 4 * 64 * 64 for r in terrain)
    from waymark.sources import formats

    written = formats.write_files(done.tracks, str(tmp_path), "tracks.bin").collect()
    assert all((tmp_path / r.path).stat().st_size == r.n_bytes for r in written) and len(written) == 2
    listed = [json.loads(r.tile) for r in E.manifest_tiles(done.tiles).collect()]
    assert len(listed) == len(tiles) and listed[0]["path"] == f"tiles/{listed[0]['lod']}/{listed[0]['col']}_{listed[0]['row']}/"


def test_speeds_along_tracks(spark):
    tracks = spark.createDataFrame([(1, [(k * 100.0, 0.0, 0.0) for k in range(6)])], f"track_id long, coords {COORDS}")
    limits = spark.createDataFrame([(1, 0.0, 10.0, 80), (2, 500.0, 29.0, 80), (3, 300.0, 31.0, 60)], "id long, x double, y double, speed int")
    assert E.speeds_along(tracks, limits).first().speeds == [80] * 6


def test_pixels_outside_a_raster_are_null(spark):
    frame = spark.createDataFrame([(1, 2, 2, [1.0, 2.0, 3.0, None])], "tile_id long, width int, height int, cells array<double>")
    got = frame.select(*[R.pixel_lookup(frame, F.lit(c), F.lit(r)).alias(f"p{c}{r}") for c, r in ((0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (0, -1))]).first()
    assert tuple(got) == (1.0, 2.0, 3.0, None, None, None)
