"""The export as one dataflow: tracks, speeds and connections, tiles, terrain, vector blocks, metadata and manifest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.scalars import tile_path
from waymark.operators import profile as P
from waymark.operators import spatial as X
from waymark.operators.features import track_stats
from waymark.operators.raster import fill_gaps, sample_first
from waymark.operators.tiles import LEVELS, PIXELS, lod_tiles, tiles_per_lod
from waymark.sources import formats
from waymark.sources.storage import materialize


@dataclass(frozen=True)
class Export:
    """Tables of an export; blocks are one row a tile."""

    tiles: DataFrame
    terrain: DataFrame
    tracks: DataFrame
    roads: DataFrame
    meta: DataFrame
    manifest: DataFrame


def placed_tiles(tiles: DataFrame, levels: list[tuple] = LEVELS, pixels: int = PIXELS) -> DataFrame:
    """``tiles`` (lod, col, row) with resolution, extent, origin and path."""
    resolution = F.lit(None).cast("double")
    for lod, metres, *_ in levels:
        resolution = F.when(F.col("lod") == lod, F.lit(metres)).otherwise(resolution)
    found = tiles.withColumn("resolution", resolution).withColumn("extent", F.col("resolution") * pixels)
    return found.withColumn("x0", F.col("col") * F.col("extent")).withColumn("y0", F.col("row") * F.col("extent")).withColumn("path", tile_path("lod", "col", "row"))


def in_order(tiles: DataFrame) -> DataFrame:
    """``tiles`` range partitioned and sorted by level, row and column, so that neighbours are sampled together."""
    return tiles.repartitionByRange("lod", "row", "col").sortWithinPartitions("lod", "row", "col")


def heightmaps(tiles: DataFrame, rasters: DataFrame, size: float, pixels: int = PIXELS, passes: int = 10) -> DataFrame:
    """lod, col, row, width, height, cells of each placed tile: sampled at pixel centres, the north row first, gaps filled.

    A pixel is a row of its own only between sampling and gathering, and asks
    only the rasters of its grid cell.
    """
    spread = tiles.select("lod", "col", "row", "x0", "y0", "extent", "resolution", F.explode(F.sequence(F.lit(0), F.lit(pixels - 1))).alias("py"))
    spread = spread.select("*", F.explode(F.sequence(F.lit(0), F.lit(pixels - 1))).alias("px"))
    place = spread.select(F.struct("lod", "col", "row", "py", "px").alias("id"), (F.col("x0") + (F.col("px") + 0.5) * F.col("resolution")).alias("x"), (F.col("y0") + F.col("extent") - (F.col("py") + 0.5) * F.col("resolution")).alias("y"))
    sampled = sample_first(place, rasters, size).select("id.*", "elevation")
    rows = sampled.groupBy("lod", "col", "row").agg(F.array_sort(F.collect_list(F.struct("py", "px", "elevation"))).alias("c"))
    whole = rows.select("lod", "col", "row", F.lit(pixels).alias("width"), F.lit(pixels).alias("height"), F.transform("c", lambda p: p["elevation"].cast("double")).alias("cells"))
    return fill_gaps(whole, passes)


def on_tiles(boxes: DataFrame, tiles: DataFrame, levels: list[tuple] = LEVELS, pixels: int = PIXELS) -> DataFrame:
    """(id, lod, col, row) of the boxes (id, min_x, ...) that strictly overlap one of the tiles, by an equi-join per level."""
    out = None
    for lod, metres, *_ in levels:
        found = X.tile_overlaps(boxes, metres * pixels).withColumn("lod", F.lit(lod))
        out = found if out is None else out.unionByName(found)
    return out.join(tiles.select("lod", "col", "row"), ["lod", "col", "row"], "left_semi").select("id", "lod", "col", "row")


def points_on_tiles(points: DataFrame, tiles: DataFrame, levels: list[tuple] = LEVELS, pixels: int = PIXELS) -> DataFrame:
    """``points`` (x, y, ...) with lod, col and row of each tile that holds them, its lower sides included."""
    out = None
    for lod, metres, *_ in levels:
        found = X.in_tile(points, metres * pixels).withColumn("lod", F.lit(lod))
        out = found if out is None else out.unionByName(found)
    return out.join(tiles.select("lod", "col", "row"), ["lod", "col", "row"], "left_semi")


def boxed(lines: DataFrame, key: str) -> DataFrame:
    return lines.select(F.col(key).alias("id"), *[c.alias(n) for n, c in X.bounds().items()])


def vector_blocks(features: DataFrame, key: str, kind: str, tiles: DataFrame, levels: list[tuple] = LEVELS, pixels: int = PIXELS) -> DataFrame:
    """One block a tile of the features (``key``, coords, and the kind's fields) that overlap it; tiles without any have none."""
    met = on_tiles(boxed(features, key), tiles, levels, pixels)
    vertices = "xyz" if kind in ("tracks", "roads") else "xy"
    whole = features.withColumnRenamed("coords", vertices).withColumnRenamed(key, "feature")
    if vertices == "xy":
        whole = whole.withColumn("xy", F.transform("xy", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    return formats.packed(met.withColumnRenamed("id", "feature").join(whole, "feature").withColumn("id", F.col("feature")), kind, "feature")


def tile_documents(tiles: DataFrame, counts: dict[str, DataFrame], stations: DataFrame, connections: DataFrame, pixels: int = PIXELS) -> DataFrame:
    """(lod, col, row, meta): each tile's JSON of its place, counts of features, stations and connections."""
    out = tiles.select("lod", "col", "row", "x0", "y0", "extent", "resolution")
    key = ["lod", "col", "row"]
    for name, blocks in counts.items():
        out = out.join(blocks.select(*key, F.col("n").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    listed = lambda rows, fields, name: rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    empty = F.array()
    out = out.join(listed(stations, ["name", "x", "y", "z", "type", "line"], "stations"), key, "left").join(listed(connections, ["trackA", "trackB", "x", "y", "z"], "connections"), key, "left")
    plain = [F.col(c) for c in key] + [F.col("x0").alias("originX"), F.col("y0").alias("originY"), F.col("extent"), F.col("resolution"), F.lit(pixels).alias("pixels"), *[F.col(c) for c in counts]]
    lists = [F.coalesce(F.col(c), empty.cast(out.schema[c].dataType)).alias(c) for c in ("stations", "connections")]
    return out.select(*key, F.to_json(F.struct(*plain, *lists)).alias("meta"))


def manifest(tiles: DataFrame, bounds: DataFrame, stats: DataFrame, levels: list[tuple] = LEVELS, pixels: int = PIXELS) -> DataFrame:
    """One row of JSON: system, origin and bounds, levels with their counts, and statistics; the tile list is :func:`manifest_tiles`."""
    per = tiles_per_lod(tiles)
    known = tiles.sparkSession.createDataFrame([(lod, m, m * pixels) for lod, m, *_ in levels], "lod int, resolution double, tileExtent double")
    level = known.join(per, "lod", "left").select("lod", "resolution", "tileExtent", F.lit(pixels).alias("tilePixels"), F.coalesce("n_tiles", F.lit(0)).alias("count"))
    # One row each, so the joins without a key are of single rows.
    one = level.agg(F.array_sort(F.collect_list(F.struct("*"))).alias("lodLevels"), F.sum("count").alias("totalTiles"))
    whole = one.join(F.broadcast(bounds)).join(F.broadcast(stats))
    corner = lambda a, b: F.array(F.col(a), F.col(b))
    numbers = F.struct("totalTiles", *stats.columns).alias("stats")
    return whole.select(F.to_json(F.struct(F.lit("EPSG:25833").alias("crs"), corner("min_x", "min_y").alias("origin"), F.array("min_x", "min_y", "max_x", "max_y").alias("bounds"), "lodLevels", numbers)).alias("manifest"))


def manifest_tiles(tiles: DataFrame) -> DataFrame:
    """A line of JSON per placed tile, for the manifest's list, in order of level, column and row."""
    return tiles.orderBy("lod", "col", "row").select(F.to_json(F.struct("lod", "col", "row", F.col("x0").alias("x"), F.col("y0").alias("y"), "path")).alias("tile"))


def main_tracks(points: DataFrame) -> DataFrame:
    """line, segment, medium and coords of profiled points (line_id, km, x, y, elevation, medium): a track per run of one medium."""
    runs = P._runs(points, "medium", "segment")
    ordered = F.array_sort(F.collect_list(F.struct("km", "x", "y", F.col("elevation").alias("z"))))
    coords = F.transform("c", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.coalesce(p["z"], F.lit(formats.NO_DATA)).alias("z")))
    found = runs.groupBy(F.col("line_id").alias("line"), "segment", "medium").agg(ordered.alias("c")).where(F.size("c") >= 2)
    return found.select("line", "segment", "medium", coords.alias("coords"))


def export(tracks: DataFrame, roads: DataFrame, stations: DataFrame, connections: DataFrame, rasters: DataFrame, raster_size: float, levels: list[tuple] = LEVELS, pixels: int = PIXELS, reach: float = 20_000.0, index: float = 10_000.0) -> Export:
    """All tables of an export from tracks (track_id, line, type, medium, electrified, speeds, coords) and roads (road_id, kategori, nummer, coords)."""
    boxes = boxed(tracks, "track_id")
    tiles = materialize(in_order(placed_tiles(lod_tiles(boxes, levels, pixels, reach, index), levels, pixels)))
    terrain = formats.grids(heightmaps(tiles, rasters, raster_size, pixels), "terrain")
    track_blocks = materialize(vector_blocks(tracks.withColumnRenamed("track_id", "key"), "key", "tracks", tiles, levels, pixels))
    road_blocks = materialize(vector_blocks(roads.withColumnRenamed("road_id", "key"), "key", "roads", tiles, levels, pixels))
    meta = tile_documents(tiles, {"trackSegments": track_blocks, "roadSegments": road_blocks}, points_on_tiles(stations, tiles, levels, pixels), points_on_tiles(connections, tiles, levels, pixels), pixels)
    bounds = boxes.agg((F.min("min_x") - reach).alias("min_x"), (F.min("min_y") - reach).alias("min_y"), (F.max("max_x") + reach).alias("max_x"), (F.max("max_y") + reach).alias("max_y"))
    count = lambda rows, name: rows.agg(F.count("*").alias(name))
    stats = track_stats(tracks).join(F.broadcast(count(stations, "stationCount"))).join(F.broadcast(count(connections, "connectionCount"))).join(F.broadcast(count(roads, "roadSegments")))
    return Export(tiles, terrain, track_blocks, road_blocks, meta, manifest(tiles, bounds, stats, levels, pixels))


def speeds_along(tracks: DataFrame, limits: DataFrame, radius: float = 30.0) -> DataFrame:
    """track_id and speeds: of each vertex that of the nearest limit (id, x, y, speed) within ``radius``, short gaps filled; 0 unknown."""
    vertices = tracks.select("track_id", F.posexplode("coords").alias("k", "p")).select(F.struct("track_id", "k").alias("id"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    near = X.nearest_within(vertices, limits.select("id", "x", "y"), radius).join(limits.select(F.col("id").alias("right_id"), "speed"), "right_id")
    marked = vertices.join(near.select(F.col("left_id").alias("id"), "speed"), "id", "left")
    along = marked.select(F.col("id.track_id").alias("line_id"), F.col("id.k").cast("double").alias("km"), F.coalesce("speed", F.lit(0)).cast("int").alias("speed"))
    filled = P.fill_speed_gaps(along)
    return filled.groupBy(F.col("line_id").alias("track_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("km", "speed"))), lambda p: p["speed"]).alias("speeds"))


def connection_points(snaps: DataFrame, branches: DataFrame) -> DataFrame:
    """trackA, trackB, x, y, z of snapped ends (seg_id, at_end, main_id) of branches (seg_id, coords)."""
    end: Column = F.when(F.col("at_end") == 0, F.element_at("coords", 1)).otherwise(F.element_at("coords", -1))
    return snaps.join(branches.select("seg_id", "coords"), "seg_id").withColumn("p", end).select(F.col("seg_id").alias("trackA"), F.col("main_id").alias("trackB"), "p.x", "p.y", "p.z")
