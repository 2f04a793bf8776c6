"""Readers of binary geodata that Spark has none for: baseline TIFF rasters, GeoPackage tables and OSM PBF blobs.

Files come through Spark's binaryFile reader, so any store that Spark reads
will do; each is decoded in the task that reads it.
"""

from __future__ import annotations

import os
import sqlite3
import struct
import tempfile
import zipfile
import zlib
from collections.abc import Iterator
from io import BytesIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# TIFF tags and the sizes of its field types.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_AT, ROWS, STRIP_SIZE, FORMAT, SCALE, TIE, NO_DATA = 256, 257, 258, 259, 273, 278, 279, 339, 33550, 33922, 42113
TILE_W, TILE_H, TILE_AT, TILE_SIZE = 322, 323, 324, 325
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}
RASTER = "path string, x0 double, y0 double, step double, width int, height int, cells array<float>"


def decode_tiff(data: bytes) -> tuple[float, float, float, np.ndarray]:
    """x0, y0, step and the first band of a striped or tiled, plain or deflated TIFF; no data is NaN."""
    end = "<" if data[:2] == b"II" else ">"
    at = struct.unpack_from(end + "I", data, 4)[0]
    tags = {}
    for k in range(struct.unpack_from(end + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(end + "HHI", data, at + 2 + 12 * k)
        size = struct.calcsize(FIELD.get(kind, "B")) * n
        where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(end + "I", data, at + 10 + 12 * k)[0]
        tags[tag] = data[where : where + n] if kind == 2 else struct.unpack_from(f"{end}{n}{FIELD.get(kind, 'B')}", data, where)
    w, h = tags[WIDTH][0], tags[HEIGHT][0]
    letter = {1: "u", 2: "i", 3: "f"}[tags.get(FORMAT, (1,))[0]]
    dtype = np.dtype(f"{end}{letter}{tags[BITS][0] // 8}")
    packing = tags.get(COMPRESSION, (1,))[0]
    if packing not in (1, 8, 32946):
        raise ValueError(f"TIFF compression {packing} is not supported")
    open_ = (lambda b: b) if packing == 1 else zlib.decompress
    out = np.empty((h, w), dtype=float)
    if TILE_AT in tags:
        tw, th = tags[TILE_W][0], tags[TILE_H][0]
        across = -(-w // tw)
        for k, (a, n) in enumerate(zip(tags[TILE_AT], tags[TILE_SIZE], strict=True)):
            r, c = k // across * th, k % across * tw
            block = np.frombuffer(open_(data[a : a + n]), dtype=dtype).reshape(th, tw)
            out[r : r + th, c : c + tw] = block[: h - r, : w - c]
    else:
        rows = tags.get(ROWS, (h,))[0]
        for k, (a, n) in enumerate(zip(tags[STRIP_AT], tags[STRIP_SIZE], strict=True)):
            block = np.frombuffer(open_(data[a : a + n]), dtype=dtype)
            out[k * rows : (k + 1) * rows] = block.reshape(-1, w)[: h - k * rows]
    if NO_DATA in tags:
        out[out == float(tags[NO_DATA].strip(b"\x00 ").decode())] = np.nan
    step, tie = tags.get(SCALE, (1.0,))[0], tags.get(TIE, (0,) * 6)
    return tie[3] - tie[0] * step, tie[4] + tie[1] * step, step, out


def rasters(spark: SparkSession, path: str) -> DataFrame:
    """A row per TIFF under ``path``, also of those inside zip archives, nested ones included."""

    def found(name: str, data: bytes) -> Iterator[tuple[str, bytes]]:
        if data[:4] == b"PK\x03\x04":
            with zipfile.ZipFile(BytesIO(data)) as z:
                for e in z.namelist():
                    if e.lower().endswith((".tif", ".tiff", ".zip")):
                        yield from found(f"{name}/{e}", z.read(e))
        elif data[:2] in (b"II", b"MM"):
            yield name, data

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                for inner, data in found(name.as_py(), content.as_py()):
                    x0, y0, step, cells = decode_tiff(data)
                    flat = cells.ravel().astype(np.float32)
                    # One raster a batch, as an Arrow list of floats; no data is null, by a mask.
                    values = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat, mask=np.isnan(flat)))
                    columns = [pa.array([inner]), *[pa.array([v], pa.float64()) for v in (x0, y0, step)], pa.array([cells.shape[1]], pa.int32()), pa.array([cells.shape[0]], pa.int32()), values]
                    yield pa.RecordBatch.from_arrays(columns, ["path", "x0", "y0", "step", "width", "height", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(decoded, RASTER)


def geopackage(spark: SparkSession, path: str, layer: str, schema: str) -> DataFrame:
    """One layer's columns from the GeoPackages under ``path``; geometry columns are their blobs."""
    names = [c.split()[0] for c in schema.split(",")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                # A task's own scratch file, read and gone within the task.
                with tempfile.NamedTemporaryFile(suffix=".gpkg", delete=False) as f:
                    f.write(content)
                try:
                    con = sqlite3.connect(f.name)
                    quoted = ", ".join('"' + n.replace('"', '""') + '"' for n in names)
                    layer_name = layer.replace('"', '""')
                    yield pd.DataFrame(con.execute(f'select {quoted} from "{layer_name}"').fetchall(), columns=names)
                    con.close()
                finally:
                    os.unlink(f.name)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, schema)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protobuf message: number and value."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        else:
            size = 8 if key & 7 == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


def _packed(data: bytes, signed: bool = False) -> list[int]:
    out, value, shift = [], 0, 0
    for byte in data:
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            out.append((value >> 1) ^ -(value & 1) if signed else value)
            value = shift = 0
    return out


def _sums(deltas: list[int]) -> list[int]:
    return np.cumsum(np.array(deltas, dtype=np.int64)).tolist()


def osm_elements(data: bytes) -> Iterator[tuple]:
    """(kind, id, lon, lat, refs, roles, tags) of the nodes, ways and relations of an OSM PBF file."""
    at = 0
    while at < len(data):
        size = struct.unpack_from(">I", data, at)[0]
        header = dict(_fields(data[at + 4 : at + 4 + size]))
        at += 4 + size
        blob = dict(_fields(data[at : at + header[3]]))
        at += header[3]
        if header[1] != b"OSMData":
            continue
        block = list(_fields(blob[1] if 1 in blob else zlib.decompress(blob[3])))
        one = dict(block)
        text = [v.decode() for k, v in _fields(one[1]) if k == 1]
        step, lat0, lon0 = one.get(17, 100), one.get(19, 0), one.get(20, 0)
        place = lambda v, base: 1e-9 * (base + step * v)  # noqa: B023, E731
        for group in (v for k, v in block if k == 2):
            for kind, body in _fields(group):
                f = dict(_fields(body))
                if kind == 2:
                    ids, lats, lons = (_sums(_packed(f.get(k, b""), True)) for k in (1, 8, 9))
                    pairs, runs = _packed(f.get(10, b"")), []
                    bag: dict[str, str] = {}
                    k = 0
                    while k < len(pairs):
                        if pairs[k] == 0:
                            runs.append(bag)
                            bag, k = {}, k + 1
                        else:
                            bag[text[pairs[k]]] = text[pairs[k + 1]]
                            k += 2
                    runs += [{}] * (len(ids) - len(runs))
                    for i, la, lo, t in zip(ids, lats, lons, runs, strict=True):
                        yield "node", i, place(lo, lon0), place(la, lat0), [], [], t
                elif kind in (1, 3, 4):
                    t = {text[a]: text[b] for a, b in zip(_packed(f.get(2, b"")), _packed(f.get(3, b"")), strict=True)}
                    if kind == 1:
                        signed = lambda v: (v >> 1) ^ -(v & 1)
                        yield "node", signed(f[1]), place(signed(f[9]), lon0), place(signed(f[8]), lat0), [], [], t
                    elif kind == 3:
                        yield "way", f[1], None, None, _sums(_packed(f.get(8, b""), True)), [], t
                    else:
                        # Only ways make up areas; a member of another type is left out.
                        members = zip(_sums(_packed(f.get(9, b""), True)), _packed(f.get(8, b"")), _packed(f.get(10, b"")), strict=True)
                        refs = [(ref, text[role]) for ref, role, type_ in members if type_ == 1]
                        yield "relation", f[1], None, None, [r for r, _ in refs], [r for _, r in refs], t


def osm(spark: SparkSession, path: str) -> DataFrame:
    """Nodes, ways and relations of the OSM PBF files under ``path``: kind, id, lon, lat, refs, roles, tags.

    A file is read in one task, and its blocks are decoded one after another.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["kind", "id", "lon", "lat", "refs", "roles", "tags"]
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for row in osm_elements(content):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, "kind string, id long, lon double, lat double, refs array<long>, roles array<string>, tags map<string,string>")


def _rings(ways: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Closed rings from ways that share end points, joined in order; what doesn't close is left out."""
    left, out = [list(w) for w in ways if len(w) >= 2], []
    while left:
        ring = left.pop(0)
        while ring[0] != ring[-1]:
            found = next((k for k, w in enumerate(left) if ring[-1] in (w[0], w[-1])), None)
            if found is None:
                break
            way = left.pop(found)
            ring += way[1:] if way[0] == ring[-1] else way[::-1][1:]
        if ring[0] == ring[-1] and len(ring) >= 4:
            out.append(ring)
    return out


def osm_features(elements: DataFrame) -> DataFrame:
    """osm_id, kind (point, line, multipolygon), tags as ``"k"=>"v"`` text, and coords in degrees.

    Tagged nodes are points. Closed ways with a building or area tag and
    multipolygon relations are areas, of which coords is an outer ring, a row
    each; other tagged ways are lines. Nodes that are missing are left out.
    """
    text = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(F.lit('"'), e["key"], F.lit('"=>"'), e["value"], F.lit('"'))), ",")
    tagged = F.size("tags") > 0
    nodes = elements.where("kind = 'node'")
    points = nodes.where(tagged).select(F.col("id").alias("osm_id"), F.lit("point").alias("kind"), text.alias("tags"), F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))).alias("coords"))
    refs = elements.where("kind = 'way'").select("id", F.posexplode("refs").alias("k", "ref"))
    placed = refs.join(nodes.select(F.col("id").alias("ref"), "lon", "lat"), "ref")
    lines = placed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", F.col("lon").alias("x"), F.col("lat").alias("y")))).alias("c"))
    lines = lines.select(F.col("id").alias("way"), F.transform("c", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("coords"))
    ways = elements.where("kind = 'way'").where(tagged).join(lines, F.col("id") == F.col("way"))
    closed = (F.size("refs") >= 4) & (F.element_at("refs", 1) == F.element_at("refs", -1))
    area = closed & (F.col("tags")["building"].isNotNull() | (F.col("tags")["area"] == "yes"))
    kinds = F.when(F.coalesce(area, F.lit(False)), "multipolygon").otherwise("line")
    of_ways = ways.select(F.col("id").alias("osm_id"), kinds.alias("kind"), text.alias("tags"), "coords").where(F.size("coords") >= 2)
    relations = elements.where("kind = 'relation'").where(F.col("tags")["type"] == "multipolygon")
    members = relations.select(F.col("id").alias("osm_id"), text.alias("tags"), F.posexplode(F.arrays_zip("refs", "roles")).alias("k", "m")).where(F.col("m.roles").isin("outer", ""))
    outer = members.select("osm_id", "tags", "k", F.col("m.refs").alias("way")).join(lines, "way")

    def assemble(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        rings = _rings([[(p["x"], p["y"]) for p in c] for c in rows["coords"]])
        made = [[{"x": x, "y": y} for x, y in ring] for ring in rings]
        return pd.DataFrame({"osm_id": [key[0]] * len(made), "kind": ["multipolygon"] * len(made), "tags": [rows["tags"].iloc[0]] * len(made), "coords": made})

    areas = outer.groupBy("osm_id").applyInPandas(assemble, "osm_id long, kind string, tags string, coords array<struct<x:double,y:double>>")
    return points.unionByName(of_ways).unionByName(areas)
