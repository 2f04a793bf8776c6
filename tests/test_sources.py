"""Binary readers on files made here, the projection's round trip, and feature rules."""

from __future__ import annotations

import math
import sqlite3
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from waymark.operators import features, geodesy
from waymark.sources import binary, catalog, formats


def _tiff(values, w, h):
    pixels = struct.pack(f"<{w * h}f", *values)
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 32), (259, 3, 1, 1), (273, 4, 1, 8), (278, 4, 1, h), (279, 4, 1, len(pixels)), (339, 3, 1, 3)]
    extra_at = 8 + len(pixels) + 2 + 12 * (len(tags) + 3) + 4
    scale, tie, none = struct.pack("<3d", 10, 10, 0), struct.pack("<6d", 0, 0, 0, 500, 7000, 0), b"-9999\x00"
    more = [(33550, 12, 3, extra_at), (33922, 12, 6, extra_at + 24), (42113, 2, 6, extra_at + 72)]
    return b"II*\x00" + struct.pack("<I", 8 + len(pixels)) + pixels + struct.pack("<H", len(tags) + 3) + b"".join(struct.pack("<HHII", *t) for t in tags + more) + b"\x00" * 4 + scale + tie + none


def test_tiff_in_nested_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "inner.zip", "w") as z:
        z.writestr("a.tif", _tiff([1.5, -9999.0, 3.0, 4.0, 5.0, 6.0], 3, 2))
    with zipfile.ZipFile(tmp_path / "outer.zip", "w") as z:
        z.write(tmp_path / "inner.zip", "inner.zip")
    (tmp_path / "inner.zip").unlink()
    row = binary.rasters(spark, str(tmp_path)).first()
    assert (row.x0, row.y0, row.step, row.width, row.height, row.cells) == (500.0, 7000.0, 10.0, 3, 2, [1.5, None, 3.0, 4.0, 5.0, 6.0])


def test_geopackage(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "x.gpkg")
    con.execute('create table "roads" (name text, nummer int)')
    con.execute("insert into roads values ('a', 6), (null, 7)")
    con.commit()
    con.close()
    assert sorted(map(tuple, binary.geopackage(spark, str(tmp_path), "roads", "name string, nummer long").collect()), key=str) == [("a", 6), (None, 7)]


def _varint(v):
    out = b""
    while v > 127:
        out += bytes([v & 127 | 128])
        v >>= 7
    return out + bytes([v])


def _msg(*fields):
    return b"".join(_varint(k << 3) + _varint(v) if isinstance(v, int) else _varint(k << 3 | 2) + _varint(len(v)) + v for k, v in fields)


def _zig(*values):
    return b"".join(_varint(v * 2 if v >= 0 else -v * 2 - 1) for v in values)


def test_osm_pbf(spark, tmp_path):
    texts = _msg(*[(1, s) for s in (b"", b"railway", b"switch", b"rail")])
    dense = _msg((1, _zig(10, 5)), (8, _zig(599000000, 100)), (9, _zig(107000000, -200)), (10, bytes([1, 2, 0, 0])))
    way = _msg((1, 77), (2, bytes([1])), (3, bytes([3])), (8, _zig(10, 5)))
    block = _msg((1, texts), (2, _msg((2, dense))), (2, _msg((3, way))))
    packed = zlib.compress(block)
    blob = _msg((2, len(block)), (3, packed))
    header = _msg((1, b"OSMData"), (3, len(blob)))
    (tmp_path / "x.pbf").write_bytes(struct.pack(">I", len(header)) + header + blob)
    rows = {(r.kind, r.id): r for r in binary.osm(spark, str(tmp_path)).collect()}
    assert rows["node", 10].tags == {"railway": "switch"} and rows["node", 15].tags == {}
    assert rows["node", 15].lat == pytest.approx(59.90001) and rows["node", 15].lon == pytest.approx(10.69998)
    assert rows["way", 77].refs == [10, 15] and rows["way", 77].tags == {"railway": "rail"}


def _pbf(path, elements, texts):
    """A PBF file of nodes (id, lon, lat, tags), ways (id, refs, tags) and relations (id, members, tags), in 1e-7 degrees."""
    words = [b"", *texts]
    number = {w: k for k, w in enumerate(words)}
    keys = lambda t: bytes(number[k] for k in t)
    values = lambda t: bytes(number[v] for v in t.values())
    nodes = [_msg((1, _zig_one(i)), (2, keys(t)), (3, values(t)), (8, _zig_one(lat)), (9, _zig_one(lon))) for i, lon, lat, t in elements["nodes"]]
    steps = lambda ids: _zig(*[b - a for a, b in zip([0, *ids[:-1]], ids, strict=True)])
    ways = [_msg((1, i), (2, keys(t)), (3, values(t)), (8, steps(refs))) for i, refs, t in elements["ways"]]
    relations = [_msg((1, i), (2, keys(t)), (3, values(t)), (8, bytes(number[r] for _, r in m)), (9, steps([ref for ref, _ in m])), (10, bytes(1 for _ in m))) for i, m, t in elements["relations"]]
    block = _msg((1, _msg(*[(1, w) for w in words])), (2, _msg(*[(1, n) for n in nodes])), (2, _msg(*[(3, w) for w in ways])), (2, _msg(*[(4, r) for r in relations])))
    blob = _msg((2, len(block)), (3, zlib.compress(block)))
    header = _msg((1, b"OSMData"), (3, len(blob)))
    path.write_bytes(struct.pack(">I", len(header)) + header + blob)


def _zig_one(v):
    return v * 2 if v >= 0 else -v * 2 - 1


def test_osm_geometry_layers_and_clipping(spark, tmp_path):
    elements = {
        "nodes": [(k, 100_000_000 + 1000 * x, 600_000_000 + 1000 * y, t) for k, x, y, t in [(1, 0, 0, {}), (2, 10, 0, {}), (3, 10, 10, {}), (4, 0, 10, {}), (5, 500, 500, {b"railway": b"switch"}), (6, 20, 0, {}), (7, 900, 900, {})]],
        "ways": [(11, [1, 2, 3, 4, 1], {b"building": b"house"}), (12, [2, 6], {b"railway": b"rail"}), (13, [1, 2, 3], {}), (14, [3, 4, 1], {}), (15, [5, 7], {b"railway": b"platform"})],
        "relations": [(21, [(13, b"outer"), (14, b"outer")], {b"type": b"multipolygon", b"building": b"yes"})],
    }
    _pbf(tmp_path / "x.pbf", elements, [b"railway", b"switch", b"building", b"house", b"rail", b"platform", b"type", b"multipolygon", b"yes", b"outer"])
    found = binary.osm(spark, str(tmp_path))
    features = {(r.kind, r.osm_id): r for r in binary.osm_features(found).collect()}
    assert set(features) == {("point", 5), ("multipolygon", 11), ("line", 12), ("line", 15), ("multipolygon", 21)}
    ring = [(round((p.x - 10) * 10000), round((p.y - 60) * 10000)) for p in features["multipolygon", 21].coords]
    assert ring == [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    layers = {n: d.collect() for n, d in formats.osm_layers(binary.osm_features(found)).items()}
    assert {n: sorted(r.osm_id for r in rows) for n, rows in layers.items()} == {"buildings": [11, 21], "railway_tracks": [12], "railway_points": [5], "railway_platforms": [15]}
    kept = {(r.kind, r.id) for r in catalog.clipped(found, 9.999, 59.999, 10.0015, 60.01).collect()}
    assert kept == {("node", 1), ("node", 2), ("node", 3), ("node", 4), ("node", 6), ("way", 11), ("way", 12), ("way", 13), ("way", 14), ("relation", 21)}


def test_raster_index_reads_headers_of_named_archives(spark, tmp_path):
    tif = _tiff([1.0] * 6, 3, 2)
    with zipfile.ZipFile(tmp_path / "in.bin", "w") as z:
        z.writestr("600_2_10m_z33.tif", tif)
    inner = (tmp_path / "in.bin").read_bytes()
    (tmp_path / "in.bin").unlink()
    with zipfile.ZipFile(tmp_path / "outer.zip", "w") as z:
        z.writestr("Basisdata_600-2_Celle_1_DTM10UTM33_TIFF.zip", inner)
        z.writestr("Other.zip", inner)
        z.writestr("a/Banenettverk_x_GML.zip", b"")
        z.writestr("a/b/c/d/e/Banenettverk_deep_GML.zip", b"")
        z.writestr("NVDB-VegnettPluss_x.zip", b"")
    rows = catalog.raster_index(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and (rows[0].width, rows[0].height, rows[0].gt) == (3, 2, [500.0, 10.0, 0.0, 7000.0, 0.0, -10.0])
    assert (rows[0].min_x, rows[0].min_y, rows[0].max_x, rows[0].max_y) == (500.0, 6980.0, 530.0, 7000.0)
    assert rows[0].lat_min < rows[0].lat_max and rows[0].inner_path.endswith("TIFF.zip/600_2_10m_z33.tif")
    found = {r.kind: r.entry for r in catalog.inner_archives(spark, str(tmp_path)).collect()}
    assert found == {"railway": "a/Banenettverk_x_GML.zip", "roads": "NVDB-VegnettPluss_x.zip"}


def test_bounds_of_another_zone_come_from_four_corners(spark):
    frame = spark.createDataFrame([(1, 10, 10, [600000.0, 100.0, 0.0, 6600000.0, 0.0, -100.0], 25832)], "place int, width int, height int, gt array<double>, epsg int")
    r = catalog.with_bounds(frame).first()
    assert r.max_x - r.min_x > 1000 and r.max_y - r.min_y > 1000
    assert 10.7 < r.lon_min < r.lon_max < 10.8 and r.max_x < 300000


def test_roads_layer_is_made_once(spark, tmp_path):
    rows = [("E", 6, "1#2", [(0.0, 0.0), (1.0, 1.0)]), ("X", 7, None, [(0.0, 0.0), (1.0, 1.0)]), (None, None, None, [(0.0, 0.0), (1.0, 1.0)]), ("K", 8, None, [(0.0, 0.0)])]
    made = []

    def make():
        made.append(1)
        return spark.createDataFrame(rows, "vegkategori string, vegnummer int, feltoversikt string, coords array<struct<x:double,y:double>>")

    for _ in range(2):
        got = sorted((r.kategori, r.nummer, r.feltoversikt) for r in catalog.cached_roads(spark, f"{tmp_path}/roads", make).collect())
        assert got == [("E", 6, "1#2"), ("F", 0, "")]
    assert len(made) == 1
    a, b = spark.range(1), spark.range(2)
    assert catalog.layer_of_choice({"x": a, "Veglenke": b}) is b and catalog.layer_of_choice({"x": a}) is a
    extract = lambda: spark.createDataFrame([("rail",)], "railway string")
    assert catalog.cached_extract(spark, str(tmp_path), (10.123, 59.9, 10.78, 60.0), extract).count() == 1
    assert (tmp_path / "_osm_10.12_59.90_10.78_60.00").is_dir()


def test_buffer_of_a_polyline(spark):
    area = lambda ring: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2
    straight = geodesy.buffer_ring([(0.0, 0.0), (10.0, 0.0), (20.0, 0.0)], 1.5)
    assert area(straight) == pytest.approx(60 + math.pi * 1.5**2, rel=0.01)
    bent = geodesy.buffer_ring([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)], 1.5)
    # Two arms, less the square they share, with a quarter circle outside the turn and two half ones.
    assert area(bent) == pytest.approx(60 + 1.25 * math.pi * 1.5**2 - 1.5**2, rel=0.01)
    frame = spark.createDataFrame([(1, [(0.0, 0.0), (10.0, 0.0)]), (2, [(1.0, 1.0), (1.0, 1.0)])], "id long, coords array<struct<x:double,y:double>>")
    assert [r.id for r in geodesy.buffered(frame).collect()] == [1]


def test_projection(spark):
    places = [(15.0, 0.0), (10.75, 59.91), (25.0, 71.0), (5.3, 60.4), (15.0, 45.0)]
    frame = spark.createDataFrame(places, "lon double, lat double")
    x, y = geodesy.to_utm(F.col("lon"), F.col("lat"))
    rows = frame.withColumn("x", x).withColumn("y", y)
    lon, lat = geodesy.from_utm(F.col("x"), F.col("y"))
    for r in rows.withColumn("lon2", lon).withColumn("lat2", lat).collect():
        assert r.lon2 == pytest.approx(r.lon, abs=1e-8) and r.lat2 == pytest.approx(r.lat, abs=1e-8)
    got = {(r.lon, r.lat): (r.x, r.y) for r in rows.collect()}
    assert got[15.0, 0.0] == pytest.approx((500000, 0), abs=1e-6)
    assert got[15.0, 45.0] == pytest.approx((500000, 4982950.4), abs=0.1)


def test_stadium(spark):
    ring = spark.range(1).select(geodesy.stadium(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(0.0), 1.5).alias("r")).first().r
    area = abs(sum(a.x * b.y - b.x * a.y for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2
    assert len(ring) == 34 and area == pytest.approx(30 + math.pi * 1.5**2, rel=0.01)


def test_feature_rules(spark):
    coords = "array<struct<x:double,y:double,z:double>>"
    line = lambda i, pts: (i, [(float(x), float(y), float(z)) for x, y, z in pts])
    lines = spark.createDataFrame([line(1, [(0, 0, 1), (9, 0, 2), (20, 0, 9)]), line(2, [(0, 0, 1), (3, 0, 9)]), line(3, [(0, 0, 1), (90, 0, 1)])], f"seg_id long, coords {coords}")
    got = features.sidings(lines).collect()
    assert [(r.seg_id, [p.z for p in r.coords]) for r in got] == [(1, [2.6, 9.6])]
    main = spark.createDataFrame([line(7, [(k * 10, 30, 0) for k in range(26)])], f"seg_id long, coords {coords}")
    snaps = {(r.seg_id, r.at_end): (r.main_id, r.d2) for r in features.snap_connections(lines.where("seg_id = 3"), main).collect()}
    assert snaps == {(3, 0): (7, 900.0), (3, 1): (7, 1000.0)}
    rings = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]), (2, [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)])], "id long, c array<struct<x:double,y:double>>").select("id", features.ring("c").alias("ring"))
    assert {r.id: r.ring and len(r.ring) for r in rings.collect()} == {1: 3, 2: None}
    flat = spark.createDataFrame([(1, 0.0, 10.0, 5.0, 3, 3, [4.0] * 9)], "tile_id long, x0 double, y0 double, step double, width int, height int, cells array<double>")
    assert [(r.id, r.base) for r in features.base_elevation(rings.where("ring is not null"), flat, 10.0).collect()] == [(1, 4.0)]
