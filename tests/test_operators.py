"""Properties, exact cases and round trips of operators that SQL can't express, and of edges."""

from __future__ import annotations

import math
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from waymark.operators import network as N
from waymark.operators import profile as P
from waymark.operators import rails
from waymark.operators import raster as R
from waymark.operators import spatial as X
from waymark.operators import tiles as T
from waymark.sources import formats

SCHEMA = "line_id long, event_id long, km double, elevation double, medium string, speed int"


def _profile(spark, points):
    return spark.createDataFrame([(1, i, float(k), None if e is None else float(e), m, 0) for i, (k, e, m) in enumerate(points)], SCHEMA)


def _coastal():
    out = []
    for i in range(101):
        km = i * 0.1
        d = (km - 3.0) / 0.5
        d = 2 - d if d > 1 else d
        out.append((km, 1.5 - 3.0 * d if 3.0 <= km <= 4.0 else 5.0, " "))
    return out


def _tunnel():
    return [(i * 0.1, -5.0 if 2.0 <= i * 0.1 <= 3.0 else 10.0, "U" if 2.0 <= i * 0.1 <= 3.0 else " ") for i in range(51)]


def _dip():
    out = []
    for i in range(161):
        t = abs(i * 0.05 - 4) / 1.5
        out.append((i * 0.05, 2.1 + 17.9 * t * t if t < 1 else 20.0, " "))
    return out


def _processed(spark, points):
    return P.clamp(P.smooth(P.clean(_profile(spark, points)))).orderBy("km").collect()


@pytest.mark.parametrize("points", [_coastal(), _dip()])
def test_surface_ends_at_or_over_the_floor(spark, points):
    rows = _processed(spark, points)
    assert len(rows) == len(points)
    assert all(r.elevation is None or r.elevation >= 2.6 - 1e-9 for r in rows)


def test_tunnels_keep_their_elevations(spark):
    rows = _processed(spark, _tunnel())
    assert all(r.elevation == -5.0 for r in rows if r.medium == "U")


def test_implausible_points_become_no_data(spark):
    rows = P.clean(_profile(spark, list(zip(range(5), [-1.0, 0.5, 1.9, 3.0, 10.0], " " * 5)))).orderBy("km").collect()
    assert [r.elevation for r in rows] == [None, None, None, 3.6, 10.6]


def test_exactly_two_metres_stay(spark):
    rows = P.clean(_profile(spark, [(0, 2.0, " "), (1, 1.999, " ")])).orderBy("km").collect()
    assert [r.elevation for r in rows] == [2.6, None]


def test_failed_samples_go_but_not_in_tunnels(spark):
    rows = P.drop_failed(_profile(spark, [(0, None, " "), (1, None, "U"), (2, 5, " ")])).collect()
    assert sorted(r.km for r in rows) == [1.0, 2.0]


def test_short_lines_are_not_smoothed(spark):
    rows = P.smooth(_profile(spark, [(0, 5, " "), (1, 500, " ")])).orderBy("km").collect()
    assert [r.elevation for r in rows] == [5.0, 500.0]


def test_empty_profile(spark):
    none = _profile(spark, [])
    assert P.smooth(P.clean(none)).count() == 0 and P.line_stats(none).count() == 0 and P.fill_tunnels(none).count() == 0


def test_same_with_one_and_many_partitions(spark):
    rows = P.smooth(P.clean(_profile(spark, _dip())))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    one = {r.km: r.elevation for r in rows.collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    many = {r.km: r.elevation for r in P.smooth(P.clean(_profile(spark, _dip()))).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == many


def test_first_of_ranges_against_loop(spark):
    rng = random.Random(5)
    rows = [(1, i, round(rng.uniform(0, 1), 3), round(rng.uniform(1, 1.01), 3)) for i in range(200)]
    kept = []
    for r in sorted(rows, key=lambda r: (r[2], r[3], r[1])):
        if not any(abs(r[2] - k[2]) < 0.001 and abs(r[3] - k[3]) < 0.001 for k in kept):
            kept.append(r)
    got = P.first_of_ranges(spark.createDataFrame(rows, "line_id long, seg long, start double, end double")).collect()
    assert sorted(map(tuple, got)) == sorted(kept)


def test_gap_fill_in_raster_order(spark):
    cells = [1.0] + [None] * 15
    frame = spark.createDataFrame([(1, 4, 4, cells), (2, 4, 4, cells[::-1]), (3, 4, 4, [None] * 16)], "tile_id long, width int, height int, cells array<double>")
    got = {r.tile_id: r.cells for r in R.fill_gaps(frame, passes=1).collect()}
    assert got[1] == [1.0] * 16
    assert [i for i, v in enumerate(got[2]) if v is not None] == [11, 14, 15]
    assert got[3] == [None] * 16


def test_sampling_falls_through_to_the_next_raster(spark):
    rasters = spark.createDataFrame([(1, 0.0, 4.0, 1.0, 4, 4, [None] * 16), (2, 0.0, 4.0, 1.0, 4, 4, [7.0] * 16)], "tile_id long, x0 double, y0 double, step double, width int, height int, cells array<double>")
    points = spark.createDataFrame([(1, 1.5, 2.5), (2, 9.0, 9.0)], "id long, x double, y double")
    assert {r.id: r.elevation for r in R.sample_first(points, rasters, 10.0).collect()} == {1: 7.0, 2: None}


def test_repeated_lines(spark):
    line = lambda i, x, n="a": (i, n, " ", [(x, 0.0, 0.0), (x + 10, 0.0, 0.0)])
    frame = spark.createDataFrame([line(1, 0.0), line(2, 0.5), line(3, 0.5, "b"), line(4, 5.0)], "seg_id long, name string, medium string, coords array<struct<x:double,y:double,z:double>>")
    assert sorted(r.seg_id for r in N.drop_repeated_lines(frame).collect()) == [1, 3, 4]


def test_longest_chain_of_a_branched_road():
    seg = [(1, [(0, 0, 0), (100, 0, 0)]), (2, [(200, 0, 1), (100, 1, 1)]), (3, [(100, 0, 2), (100, 30, 2)]), (4, [(900, 900, 0), (910, 900, 0)])]
    chain = N.longest_chain(seg)
    assert sorted((chain[0][:2], chain[-1][:2])) == [(0, 0), (200, 0)]
    assert len(chain) == 3


def test_empty_chain():
    assert N.longest_chain([]) == []


def test_junction_kinds():
    unit = lambda *degrees: [(math.cos(math.radians(d)), math.sin(math.radians(d))) for d in degrees]
    assert N.junction_class(unit(0, 180)) == ("None", 0)
    assert N.junction_class(unit(0, 180, 150)) == ("Switch", 1)
    assert N.junction_class(unit(0, 180, 60, 240)) == ("Diamond", 0)
    assert N.junction_class(unit(0, 180, 22, 158)) == ("DoubleSwitch", 2)
    assert len(N.ways(unit(0, 10, 50))) == 1  # the running sum is not normalised


def test_components_of_a_path_and_a_loop(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(50)] + [(100, 101, 2.0), (101, 102, 2.0), (102, 100, 2.0)], "a long, b long, w double")
    assert {(r.root, r.length) for r in N.component_lengths(edges).collect()} == {(0, 50.0), (100, 6.0)}


def test_blocks_round_trip():
    assert formats.read_terrain(formats.terrain_block([1.5, None, -3.0])) == [1.5, None, -3.0]
    assert formats.cover_block([0, 81]) == b"\x00\x51"
    block = formats.tracks_block([{"id": 7, "type": 0, "medium": "U", "electrified": 1, "xyz": [(1, 2, 3), (4, 5, 6)], "speeds": [80, 0]}])
    assert struct.unpack_from("<IIBBBBI", block) == (1, 7, 0, 0x55, 1, 0, 2)
    assert struct.unpack_from("<6f2H", block, 16) == (1, 2, 3, 4, 5, 6, 80, 0) and len(block) == 16 + 24 + 4
    assert struct.unpack_from("<IB3xIIfff", formats.roads_block([{"kategori": "E", "nummer": 6, "xyz": [(1, 2, 3)]}])) == (1, 0x45, 6, 1, 1, 2, 3)
    assert struct.unpack_from("<IBB2xffIff", formats.buildings_block([{"kind": 1, "roof": 2, "base": 3.0, "height": 6.0, "xy": [(1, 2)]}])) == (1, 1, 2, 3, 6, 1, 1, 2)
    assert struct.unpack_from("<IffIff", formats.platforms_block([{"base": 3.0, "height": 0.5, "xy": [(1, 2)]}])) == (1, 3, 0.5, 1, 1, 2)


def test_zip_listing(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.txt", "hello")
    assert [(r.entry, r.size) for r in formats.zip_entries(spark, str(tmp_path)).collect()] == [("x.txt", 5)]


def test_typed_layers(spark):
    rows = [("1", "multipolygon", None, "A", '"building"=>"yes","building:levels"=>"3x"'), ("2", "multipolygon", None, None, '"railway"=>"platform"'), ("3", "line", "rail", "", '"gauge"=>"1435","service"=>"yard"'), ("4", "line", "platform_edge", None, ""), ("5", "point", None, None, '"railway"=>"switch"'), ("6", "line", "other", None, None), ("7", "point", None, None, None)]
    got = {r.osm_id: r for r in formats.typed_layers(spark.createDataFrame(rows, "osm_id string, kind string, railway string, name string, tags string")).collect()}
    assert {k: r.layer for k, r in got.items()} == {"1": "buildings", "2": "railway_platforms", "3": "railway_tracks", "4": "railway_platforms", "5": "railway_points"}
    assert got["1"].levels == 3 and got["3"].gauge == 1435 and got["3"].service == "yard" and got["3"].name is None


def test_box_distance_without_boxes(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double")
    boxes = spark.createDataFrame([], "id long, min_x double, min_y double, max_x double, max_y double")
    assert X.box_distance(points, boxes, 10.0).first().distance == 1e18


def test_lod_tiles_against_loop(spark):
    boxes = [(1, 100.0, 100.0, 900.0, 300.0), (2, 3000.0, 2000.0, 3300.0, 2050.0)]
    levels = [(0, 1.0, 0.0, 200.0), (1, 2.0, 200.0, 1000.0)]
    reach, index, pixels = 1500.0, 1000.0, 256
    frame = spark.createDataFrame(boxes, "id long, min_x double, min_y double, max_x double, max_y double")
    got = {(r.lod, r.col, r.row) for r in T.lod_tiles(frame, levels, pixels, reach, index).collect()}
    want, covered = set(), set()

    def distance(x, y):
        cx, cy = math.floor(x / index), math.floor(y / index)
        near = [b for b in boxes if math.floor(b[1] / index) <= cx + 3 and math.floor(b[3] / index) >= cx - 3 and math.floor(b[2] / index) <= cy + 3 and math.floor(b[4] / index) >= cy - 3]
        return min((math.hypot(max(b[1] - x, x - b[3], 0), max(b[2] - y, y - b[4], 0)) for b in near), default=1e18)

    for lod, res, low, high in levels:
        e, f = res * pixels, int(res)
        own = set()
        for c in range(math.floor((100 - reach) / e), math.ceil((3300 + reach) / e)):
            for r in range(math.floor((100 - reach) / e), math.ceil((2050 + reach) / e)):
                d = min(distance((c + dx) * e, (r + dy) * e) for dx, dy in ((0.5, 0.5), (0, 0), (1, 0), (0, 1), (1, 1)))
                cells = {(c * f + i, r * f + j) for i in range(f) for j in range(f)}
                if low <= d < high and not cells <= covered:
                    own.add((lod, c, r))
        for _, c, r in own:
            covered |= {(c * f + i, r * f + j) for i in range(f) for j in range(f)}
        want |= own
    assert got == want


def test_burn_takes_the_last_polygon_and_drops_wide_codes(spark):
    ring = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    polygons = spark.createDataFrame([(1, 30, ring(0.0, 10.0)), (2, 80, ring(5.0, 10.0)), (3, 999, ring(8.0, 9.0))], "ord int, artype int, ring array<struct<x:double,y:double>>")
    pixels = spark.createDataFrame([(1, 2.5, 2.5), (2, 6.5, 6.5), (3, 8.5, 8.5), (4, 20.5, 1.5)], "id long, x double, y double")
    assert {r.id: r.artype for r in R.burn(pixels, polygons, 4.0).collect()} == {1: 30, 2: 80, 3: 0, 4: 0}


def _edge_line(spark):
    """A line of rail_profile at 0.1 GB that ends on a pixel edge: its length times 13 by 13 is less than its length."""
    coords = "array<struct<x:double,y:double,z:double>>"
    return spark.createDataFrame([(1539, 6, 657.0, 658.5, " ", [(23.0, 3099.0, 1.5), (630.0, 2810.0, 1.5)])], f"seg_id long, line_id long, start double, end double, medium string, coords {coords}")


def test_densify_ends_on_the_last_vertex(spark):
    samples = sorted(X.densify(_edge_line(spark), 50.0).collect(), key=lambda r: r.sample)
    assert len(samples) == 14
    assert (samples[0].x, samples[0].y) == (23.0, 3099.0)
    assert (samples[-1].x, samples[-1].y) == (630.0, 2810.0)


def test_line_stats_of_a_line_that_ends_on_a_pixel_edge(spark):
    # The pixel east of x = 630 has no data, so the last sample has none and is dropped, as in the SQL.
    cells = [None if k % 8 == 3 else 100.0 + k for k in range(64)]
    raster = "tile_id long, x0 double, y0 double, step double, width int, height int, cells array<double>"
    rasters = spark.createDataFrame([(1, 490.0, 3010.0, 70.0, 8, 8, cells), (2, 0.0, 3100.0, 70.0, 8, 8, [50.0] * 64)], raster)
    dense = rails.samples(_edge_line(spark)).withColumn("id", F.struct("seg_id", "sample"))
    found = dense.join(R.sample_first(dense.select("id", "x", "y"), rasters, 560.0), "id")
    stats = P.line_stats(P.clean(found)).first()
    assert stats.length_km == pytest.approx(1.5 * 12 / 13)


def test_max_elevation_of_a_line_that_ends_on_a_pixel_edge(spark):
    # The last sample is where there are no data, so the 1000 m that end there are not reached.
    cells = [1000.0 if k % 8 == 2 else None if k % 8 > 2 else 100.0 for k in range(64)]
    rasters = spark.createDataFrame([(1, 490.0, 3010.0, 70.0, 8, 8, cells), (2, 0.0, 3100.0, 70.0, 8, 8, [50.0] * 64)], "tile_id long, x0 double, y0 double, step double, width int, height int, cells array<double>")
    dense = rails.samples(_edge_line(spark)).withColumn("id", F.struct("seg_id", "sample"))
    found = dense.join(R.sample_first(dense.select("id", "x", "y"), rasters, 560.0), "id")
    assert P.line_stats(P.drop_failed(found)).first().max_elevation < 600


def test_copies_of_a_line_meet_the_others_as_one(spark, monkeypatch):
    # 600 lines at three places 0.8 m apart, and lines that can't repeat: no name, an end that is nowhere.
    at = lambda x: [(x, 0.0), (x + 10, 0.0)]
    rows = [(i, "a", " ", at(0.8 * (i % 3))) for i in range(600)] + [(600, None, " ", at(0.0)), (601, None, " ", at(0.0)), (602, "a", " ", [(math.nan, 0.0), (1.0, 0.0)]), (603, "a", " ", [(math.nan, 0.0), (1.0, 0.0)])]
    lines = spark.createDataFrame(rows, "seg_id long, name string, medium string, coords array<struct<x:double,y:double>>")
    counts, write = [], N.materialize
    monkeypatch.setattr(N, "materialize", lambda df: counts.append((t := write(df)).count()) or t)
    assert sorted(r.seg_id for r in N.drop_repeated_lines(lines).collect()) == [0, 2, 600, 601, 602, 603]
    assert counts[0] == 2


def test_box_distance_equals_every_box_in_reach(spark):
    rng = random.Random(3)
    boxes = [(x, y, x + rng.choice([0.0, 3.0, 40.0]), y + rng.choice([0.0, 5.0, 30.0])) for x, y in ((float(rng.randrange(-40, 200)), float(rng.randrange(-40, 200))) for _ in range(60))]
    points = [(i, rng.uniform(-150, 350), rng.uniform(-150, 350)) for i in range(300)] + [(300, None, 1.0), (301, 20.0, 40.0)]
    found = X.box_distance(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(boxes, "min_x double, min_y double, max_x double, max_y double"), 20.0, 2)
    at = lambda v: math.floor(v / 20)

    def plain(x, y):
        near = [(a, b, c, d) for a, b, c, d in boxes if x is not None and at(a) - 2 <= at(x) <= at(c) + 2 and at(b) - 2 <= at(y) <= at(d) + 2]
        return min((math.hypot(max(a - x, x - c, 0), max(b - y, y - d, 0)) for a, b, c, d in near), default=1e18)

    got = {r.id: r.distance for r in found.collect()}
    assert len(got) == 302 and got == pytest.approx({i: plain(x, y) for i, x, y in points})
    assert {0.0, 1e18} < set(got.values())


def test_points_in_a_cell_that_a_box_covers_ask_no_box(spark):
    boxes = spark.createDataFrame([(0.0, 0.0, 100.0, 45.0)] * 50, "min_x double, min_y double, max_x double, max_y double")
    assert sorted(map(tuple, X.covered_cells(boxes, 20.0).collect())) == [(cx, cy) for cx in range(5) for cy in range(2)]


def test_burn_equals_every_polygon_in_turn(spark):
    rng = random.Random(5)
    rings = []
    for k in range(60):
        x, y, r = rng.uniform(0, 100), rng.uniform(0, 100), rng.choice([3.0, 15.0, 60.0])
        turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.choice([3, 4, 7])))
        rings.append((k, k % 90 + 1, [(x + r * math.cos(t), y + r * math.sin(t)) for t in turns]))
    pixels = [(i, rng.uniform(-20, 120), rng.uniform(-20, 120)) for i in range(400)]

    def held(x, y, ring):
        pairs = zip(ring, ring[1:] + ring[:1], strict=True)
        return sum((ay > y) != (by > y) and x < ax + (bx - ax) * (y - ay) / (by - ay) for (ax, ay), (bx, by) in pairs) % 2 == 1

    polygons = spark.createDataFrame(rings, "ord long, artype int, ring array<struct<x:double,y:double>>")
    found = R.burn(spark.createDataFrame(pixels, "id long, x double, y double"), polygons, 24.0)
    expected = {i: next((a for _, a, ring in reversed(rings) if held(x, y, ring)), 0) for i, x, y in pixels}
    assert {r.id: r.artype for r in found.collect()} == expected


def test_polygons_under_one_that_fills_a_cell_are_left_out(spark):
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    rings = [(k, 1, square(-5.0, 25.0)) for k in range(30)] + [(30, 2, square(2.0, 8.0))]
    polygons = spark.createDataFrame(rings, "ord long, artype int, ring array<struct<x:double,y:double>>")
    kept = {(r.cx, r.cy): r.n for r in R.uppermost(polygons, 10.0).groupBy("cx", "cy").agg(F.count("*").alias("n")).collect()}
    assert kept[0, 0] == 2 and kept[1, 1] == 1 and kept[-1, 0] == 30


def test_a_tile_of_many_roads_is_made_in_parts(spark):
    roads = [(0, 0, i, "ERFK"[i % 4], i % 9, [(float(i), k + 0.5, None if k == 2 else 3.0) for k in range(2 + i % 3)]) for i in range(50)]
    rows = spark.createDataFrame(roads[::-1], "col long, row long, seg_id long, kategori string, nummer int, coords array<struct<x:double,y:double,z:double>>")
    block = formats.road_tiles(rows).first()
    plain = formats.roads_block([{"kategori": k, "nummer": n, "xyz": [(x, y, math.nan if z is None else z) for x, y, z in c]} for *_, k, n, c in roads])
    assert block.n_roads == 50 and bytes(block.block) == plain
    parts = sorted(formats.road_parts(formats.road_pieces(rows, "col", "row", "seg_id"), most=200, together=16).collect(), key=lambda r: r.first_id)
    assert max(len(r.part) for r in parts) <= 200 and sum(r.n_roads for r in parts) == 50
    assert struct.pack("<I", 50) + b"".join(bytes(r.part) for r in parts) == plain


def test_roads_are_chained_many_in_a_call(spark):
    rng = random.Random(8)
    rows = [("E" if n % 2 else "K", n, s, [(100.0 * s, float(n), 1.0), (100.0 * s + 100, float(n), 2.0)][:: 1 if s % 2 else -1]) for n in range(300) for s in range(1 + n % 4)]
    rng.shuffle(rows)
    lines = spark.createDataFrame(rows, "kategori string, nummer int, seg_id long, coords array<struct<x:double,y:double,z:double>>")
    frame = N.chains(lines)
    plan = frame._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    found = {}
    for r in sorted(frame.collect(), key=lambda r: r.pos):
        found.setdefault(r.nummer, []).append((r.x, r.y, r.z))
    assert found == {n: N.longest_chain([(s, c) for _, m, s, c in rows if m == n]) for n in range(300)}


def test_grade_limit_and_km_keep_every_bit_far_along_a_line(spark):
    # A gap of 428,571 km, as keys shifted by a million give: what grades lose to rounding comes back 4e8 times over it.
    def by_rule(rows, forward):
        out = []
        for km, e in rows if forward else rows[::-1]:
            out.append((km, e if not out else min(e, out[-1][1] + 25.0 * abs(km - out[-1][0]))))
        return out if forward else out[::-1]

    rows = [(at + 1.5 * (k / 13), 100.0 + (k * 37 + at) % 41 / 7) for at in (0.0, 428571.0, 2142855.0, 2142858.0) for k in range(14)]
    points = spark.createDataFrame([(1, n, km, e, " ") for n, (km, e) in enumerate(rows)], "line_id long, event_id long, km double, elevation double, medium string")
    for forward in (True, False):
        found = [r.elevation for r in P.limit_grade(points, 0.025, forward).orderBy("event_id").collect()]
        assert max(abs(a - b) for a, (_, b) in zip(found, by_rule(rows, forward), strict=True)) < 1e-12


def test_samples_of_one_piece_lie_at_their_very_shares(spark):
    coords = "array<struct<x:double,y:double,z:double>>"
    ends = [(k, 0.0, 0.0, 7.0 + 300 * (k % 3), 11.0 + 293 * (k % 4)) for k in range(1, 12)]
    segments = spark.createDataFrame([(k, 1, 0.0, 1.5, " ", [(x1, y1, 0.0), (x2, y2, 0.0)]) for k, x1, y1, x2, y2 in ends], f"seg_id long, line_id long, start double, end double, medium string, coords {coords}")
    found = rails.samples(segments).collect()
    last = {s: max(r.sample for r in found if r.seg_id == s) for s in {r.seg_id for r in found}}
    to = {k: (x2, y2) for k, _, _, x2, y2 in ends}
    for r in found:
        share = r.sample / last[r.seg_id]
        assert (r.km, r.x, r.y) == (share * 1.5, share * to[r.seg_id][0], share * to[r.seg_id][1])


def test_parallel_segments_divide_by_nothing_however_the_join_is_run(spark):
    # Uncompiled, shared parts of a condition are worked out before what guards them.
    segments = spark.createDataFrame([(k, 0.0, 1.0 * k, 10.0, 1.0 * k) for k in range(4)] + [(9, 5.0, -1.0, 5.0, 9.0)], "id long, x1 double, y1 double, x2 double, y2 double")
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    try:
        found = X.crossings(segments, segments, 300.0).collect()
    finally:
        spark.conf.unset("spark.sql.codegen.wholeStage")
    assert sorted((r.left_id, r.right_id) for r in found) == sorted([(k, 9) for k in range(4)] + [(9, k) for k in range(4)])


def test_cluster_rows_gives_what_ties_with_the_middle_hit(spark):
    hits = [("a", 0.1, 1.0, "T"), ("a", 0.2, 2.0, "U"), ("a", 0.2, 2.0, "L"), ("a", 0.2, 2.0, " "), ("a", 0.3, 1.0, "B"), ("b", 0.1, 5.0, "L")]
    rows = spark.createDataFrame(hits, "line_id string, km double, x double, medium string")
    found = {r.line_id: (r.km, r.x, sorted(r.ties), r.place, r.n_hits) for r in P.cluster_rows(rows, ["line_id"], 0.5, tied="medium").collect()}
    assert found == {"a": (0.2, 2.0, [" ", "L", "U"], 1, 5), "b": (0.1, 5.0, ["L"], 0, 1)}
