"""Files: archives, tile payloads and vector blocks of the tile format, and tagged features to typed layers."""

from __future__ import annotations

import datetime
import io
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.scalars import RAILWAY_TYPES, leading_float, leading_int, nonzero, not_empty, positive, tag

NO_DATA = -9999.0


def zip_entries(spark: SparkSession, path: str) -> DataFrame:
    """zip, entry, size, compressed and modified of every entry of the archives under ``path``; files are read by Spark."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows += [(name, e.filename, e.file_size, e.compress_size, datetime.datetime(*e.date_time)) for e in z.infolist()]
            yield pd.DataFrame(rows, columns=["zip", "entry", "size", "compressed", "modified"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = files.mapInPandas(listed, "zip string, entry string, size long, compressed long, modified timestamp_ntz")
    return found.withColumn("modified", F.date_format("modified", "yyyy-MM-dd HH:mm"))


def gml_features(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """The features of one layer of a GML file."""
    return spark.read.format("xml").option("rowTag", layer).option("ignoreNamespace", "true").load(path)


def terrain_block(elevations: list[float | None]) -> bytes:
    """Little-endian float32 in row order from the north; no data is -9999."""
    return np.array([NO_DATA if v is None else v for v in elevations], dtype="<f4").tobytes()


def read_terrain(block: bytes) -> list[float | None]:
    return [None if v == NO_DATA else float(v) for v in np.frombuffer(block, dtype="<f4")]


def cover_block(codes: list[int]) -> bytes:
    return np.array(codes, dtype=np.uint8).tobytes()


def _vertices(points: list[tuple]) -> bytes:
    return np.array(points, dtype="<f4").tobytes()


def tracks_block(tracks: list[dict]) -> bytes:
    """Tracks: id, type, medium, electrified, xyz and speeds."""
    out = [struct.pack("<I", len(tracks))]
    for t in tracks:
        out += [struct.pack("<IBBBBI", t["id"], t["type"], ord(t["medium"]), t["electrified"], 0, len(t["xyz"])), _vertices(t["xyz"]), np.array(t["speeds"], dtype="<u2").tobytes()]
    return b"".join(out)


def roads_block(roads: list[dict]) -> bytes:
    out = [struct.pack("<I", len(roads))]
    for r in roads:
        out += [struct.pack("<B3xII", ord(r["kategori"]), r["nummer"], len(r["xyz"])), _vertices(r["xyz"])]
    return b"".join(out)


def buildings_block(buildings: list[dict]) -> bytes:
    out = [struct.pack("<I", len(buildings))]
    for b in buildings:
        out += [struct.pack("<BB2xffI", b["kind"], b["roof"], b["base"], b["height"], len(b["xy"])), _vertices(b["xy"])]
    return b"".join(out)


def platforms_block(platforms: list[dict]) -> bytes:
    out = [struct.pack("<I", len(platforms))]
    for p in platforms:
        out += [struct.pack("<ffI", p["base"], p["height"], len(p["xy"])), _vertices(p["xy"])]
    return b"".join(out)


def road_pieces(roads: DataFrame, *carried: str) -> DataFrame:
    """The ``carried`` columns and ``piece``, a road's bytes in a block, of roads (..., kategori, nummer, coords)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coords = batch["coords"]
            sizes, flat = [n or 0 for n in pc.list_value_length(coords).to_pylist()], coords.flatten()
            raw = np.stack([flat.field(v).to_numpy(zero_copy_only=False) for v in "xyz"], axis=1).astype("<f4").tobytes()
            at, made = 0, []
            for kategori, nummer, n in zip(batch["kategori"].to_pylist(), batch["nummer"].to_pylist(), sizes, strict=True):
                made.append(struct.pack("<B3xII", ord(kategori), nummer, n) + raw[at : at + 12 * n])
                at += 12 * n
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in carried], pa.array(made, pa.binary())], [*carried, "piece"])

    kept = roads.select(*carried)
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return roads.select(*carried, "kategori", "nummer", "coords").mapInArrow(pack, f"{names}, piece binary")


def road_parts(pieces: DataFrame, most: int = 4 << 20, together: int = 1 << 16) -> DataFrame:
    """(col, row, first_id, n_roads, part): a tile's pieces (col, row, seg_id, piece) by seg_id, end to end, in parts.

    A tile's block is the number of its roads and its parts in order of first_id.
    A part closes at ``most`` bytes and holds no more than ``together`` ids, so
    no task needs a whole tile, however many roads it has.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, held, size = None, 0, [], 0
        part = lambda: pa.RecordBatch.from_pylist([{"col": key[0], "row": key[1], "first_id": first, "n_roads": len(held), "part": b"".join(held)}], out)
        for batch in batches:
            for col, row, span, seg, piece in zip(*[batch[c].to_pylist() for c in ("col", "row", "span", "seg_id", "piece")], strict=True):
                if held and (key != (col, row, span) or size + len(piece) > most):
                    yield part()
                    held, size = [], 0
                if not held:
                    key, first = (col, row, span), seg
                held.append(piece)
                size += len(piece)
        if held:
            yield part()

    out = pa.schema([("col", pa.int64()), ("row", pa.int64()), ("first_id", pa.int64()), ("n_roads", pa.int64()), ("part", pa.binary())])
    keys = ["col", "row", "span"]
    dealt = pieces.withColumn("span", F.floor(F.col("seg_id") / together)).select(*keys, "seg_id", "piece").repartition(*keys)
    return dealt.sortWithinPartitions(*keys, "seg_id").mapInArrow(join, "col long, row long, first_id long, n_roads long, part binary")


def road_tiles(rows: DataFrame) -> DataFrame:
    """(col, row, n_roads, block) from rows (col, row, seg_id, kategori, nummer, coords): each tile's roads as one block.

    For tiles whose block fits a task; :func:`road_parts` has no such limit.
    """

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first_id", kind="stable")
        n = int(pdf["n_roads"].sum())
        return pd.DataFrame({"col": [key[0]], "row": [key[1]], "n_roads": [n], "block": [struct.pack("<I", n) + b"".join(pdf["part"])]})

    parts = road_parts(road_pieces(rows, "col", "row", "seg_id"))
    return parts.groupBy("col", "row").applyInPandas(whole, "col long, row long, n_roads long, block binary")


def layer_of(kind: str, railway: str, tags: str):
    """The layer of a tagged feature: by its geometry kind, then the first rule that fits; null for none."""
    building = not_empty(tag(tags, "building")).isNotNull()
    track = F.col(railway).isin(RAILWAY_TYPES)
    platform_line = F.coalesce(F.col(railway).isin("platform", "platform_edge"), F.lit(False))
    platform_tag = tag(tags, "railway").isin("platform", "platform_edge")
    return (
        F.when((F.col(kind) == "multipolygon") & building, "buildings")
        .when((F.col(kind) == "multipolygon") & platform_tag, "railway_platforms")
        .when((F.col(kind) == "line") & track, "railway_tracks")
        .when((F.col(kind) == "line") & platform_line, "railway_platforms")
        .when((F.col(kind) == "point") & (tag(tags, "railway") != ""), "railway_points")
    )


def typed_layers(features: DataFrame) -> DataFrame:
    """Features (osm_id, kind, railway, name, tags) with their layer and typed fields, in one pass; others are dropped."""
    number = lambda key: positive(leading_int(tag("tags", key))).alias(key)
    routed = features.withColumn("layer", layer_of("kind", "railway", "tags")).where("layer is not null")
    levels = positive(leading_int(tag("tags", "building:levels"))).alias("levels")
    return routed.select("layer", "osm_id", not_empty(F.col("name")).alias("name"), levels, *[number(k) for k in ("gauge", "voltage", "maxspeed")], *[not_empty(tag("tags", k)).alias(k) for k in ("service", "usage", "electrified", "ref")])


_VERTEX = "struct<x:float,y:float,z:float>"
#: What each block's rows hold, in the order of the format.
BLOCKS = {
    "terrain": "idx int, elevation float",
    "landcover": "idx int, artype int",
    "tracks": f"track_id long, type int, medium string, electrified int, xyz array<{_VERTEX}>, speeds array<int>",
    "roads": f"kategori string, nummer long, xyz array<{_VERTEX}>",
    "buildings": "kind int, roof int, base float, height float, xy array<struct<x:float,y:float>>",
    "platforms": "base float, height float, xy array<struct<x:float,y:float>>",
}


def _read_vertices(block: bytes, at: int, n: int, width: int) -> tuple[list[tuple], int]:
    flat = np.frombuffer(block, dtype="<f4", count=n * width, offset=at).reshape(n, width)
    return [tuple(float(v) for v in row) for row in flat], at + 4 * n * width


def read_block(kind: str, block: bytes) -> list[tuple]:
    """The rows of one block, as :data:`BLOCKS` names them."""
    if kind == "terrain":
        return list(enumerate(read_terrain(block)))
    if kind == "landcover":
        return list(enumerate(block))
    (count,), at, out = struct.unpack_from("<I", block), 4, []
    for _ in range(count):
        if kind == "tracks":
            track, type_, medium, electrified, _, n = struct.unpack_from("<IBBBBI", block, at)
            xyz, at = _read_vertices(block, at + 12, n, 3)
            out.append((track, type_, chr(medium), electrified, xyz, np.frombuffer(block, dtype="<u2", count=n, offset=at).tolist()))
            at += 2 * n
        elif kind == "roads":
            kategori, nummer, n = struct.unpack_from("<B3xII", block, at)
            xyz, at = _read_vertices(block, at + 12, n, 3)
            out.append((chr(kategori), nummer, xyz))
        elif kind == "buildings":
            sort, roof, base, height, n = struct.unpack_from("<BB2xffI", block, at)
            xy, at = _read_vertices(block, at + 16, n, 2)
            out.append((sort, roof, base, height, xy))
        else:
            base, height, n = struct.unpack_from("<ffI", block, at)
            xy, at = _read_vertices(block, at + 12, n, 2)
            out.append((base, height, xy))
    return out


def unpacked(blocks: DataFrame, kind: str) -> DataFrame:
    """The rows of blocks (lod, col, row, block) of one kind."""
    names = [c.split()[0] for c in BLOCKS[kind].split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lod, col, row, block in zip(batch["lod"], batch["col"], batch["row"], batch["block"], strict=True):
                rows = pd.DataFrame(read_block(kind, bytes(block)), columns=names)
                rows.insert(0, "row", row)
                rows.insert(0, "col", col)
                rows.insert(0, "lod", lod)
                yield rows

    return blocks.select("lod", "col", "row", "block").mapInPandas(read, f"lod int, col long, row long, {BLOCKS[kind]}")


_PACK = {"tracks": tracks_block, "roads": roads_block, "buildings": buildings_block, "platforms": platforms_block}


def packed(rows: DataFrame, kind: str, order: str) -> DataFrame:
    """(lod, col, row, n, block) from a tile's features (lod, col, row, ``order``, ...), one block a tile, in that order."""
    fields = {"tracks": ["id", "type", "medium", "electrified", "xyz", "speeds"], "roads": ["kategori", "nummer", "xyz"], "buildings": ["kind", "roof", "base", "height", "xy"], "platforms": ["base", "height", "xy"]}[kind]

    def vertices(v) -> list[tuple]:
        return [tuple(p.values()) if isinstance(p, dict) else tuple(p) for p in v]

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for r in pdf.sort_values(order)[fields].to_dict("records"):
            found.append({k: vertices(v) if k in ("xyz", "xy") else v for k, v in r.items()})
        return pd.DataFrame({"lod": [key[0]], "col": [key[1]], "row": [key[2]], "n": [len(found)], "block": [_PACK[kind](found)]})

    return rows.groupBy("lod", "col", "row").applyInPandas(pack, "lod int, col long, row long, n long, block binary")


def grids(rows: DataFrame, kind: str) -> DataFrame:
    """(lod, col, row, block) of tiles with ``cells``, terrain or land cover in row order from the north; no data is null."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if kind == "terrain":
                made = [np.where(np.isnan(c := np.array([np.nan if v is None else v for v in cells], dtype=float)), NO_DATA, c).astype("<f4").tobytes() for cells in batch["cells"]]
            else:
                made = [np.array(cells, dtype=np.uint8).tobytes() for cells in batch["cells"]]
            yield pd.DataFrame({"lod": batch["lod"], "col": batch["col"], "row": batch["row"], "block": made})

    return rows.select("lod", "col", "row", "cells").mapInPandas(pack, "lod int, col long, row long, block binary")


def write_files(blocks: DataFrame, folder: str, name: str) -> DataFrame:
    """(path, n_bytes): each tile's block as a file of its own, ``folder``/tiles/lod/col_row/name, written by the tasks.

    Paths are what Python opens on every executor, so a mounted shared folder;
    a file is written beside its place and renamed, so that a task that is run
    again leaves no half of one.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import uuid

        for batch in batches:
            paths, sizes = [], []
            for lod, col, row, block in zip(batch["lod"], batch["col"], batch["row"], batch["block"], strict=True):
                place = f"{folder}/tiles/{lod}/{col}_{row}"
                os.makedirs(place, exist_ok=True)
                staged = f"{place}/.{uuid.uuid4().hex}"
                with open(staged, "wb") as f:
                    f.write(block)
                os.replace(staged, f"{place}/{name}")
                paths.append(f"tiles/{lod}/{col}_{row}/{name}")
                sizes.append(len(block))
            yield pd.DataFrame({"path": paths, "n_bytes": sizes})

    return blocks.select("lod", "col", "row", "block").mapInPandas(write, "path string, n_bytes long")


def osm_layers(features: DataFrame) -> dict[str, DataFrame]:
    """The four typed layers of features (osm_id, kind, tags, coords) with tags as ``"k"=>"v"`` text."""
    f = features.withColumn("railway", tag("tags", "railway")).withColumn("layer", layer_of("kind", "railway", "tags")).where("layer is not null")
    text = lambda key, name=None: not_empty(tag("tags", key)).alias(name or key)
    number = lambda key, name=None: nonzero(leading_int(tag("tags", key))).alias(name or key)
    own = lambda layer, *columns: f.where(F.col("layer") == layer).select("osm_id", *columns, "coords")
    levels = positive(leading_int(tag("tags", "building:levels"))).alias("levels")
    height = positive(leading_float(tag("tags", "height"))).alias("height")
    return {
        "buildings": own("buildings", text("building"), text("name"), levels, height, *[text(k) for k in ("amenity", "shop", "tourism", "historic")], *[text(k, k.replace(":", "_")) for k in ("roof:shape", "roof:colour", "building:colour", "building:material")]),
        "railway_tracks": own("railway_tracks", text("railway"), text("name"), text("service"), text("usage"), number("gauge"), text("electrified"), number("voltage"), text("frequency"), number("maxspeed"), text("railway:track_ref", "track_ref"), text("tunnel"), text("bridge"), number("layer"), text("operator")),
        "railway_points": own("railway_points", text("railway"), *[text(k) for k in ("name", "ref", "operator", "uic_ref")], text("railway:position", "railway_position")),
        "railway_platforms": own("railway_platforms", text("name"), text("ref")),
    }


def write_layers(layers: dict[str, DataFrame], folder: str) -> None:
    """One table per layer under ``folder``."""
    for name, rows in layers.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
