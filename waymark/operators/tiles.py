"""The multi-resolution tile pyramid: which tiles there are, their metadata and the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.spatial import box_distance, uncovered

# Level, metres a pixel, nearest and farthest distance to the network.
LEVELS = [(0, 10.0, 0.0, 200.0), (1, 20.0, 200.0, 1000.0), (2, 40.0, 1000.0, 5000.0), (3, 80.0, 5000.0, 20000.0)]
PIXELS, REACH_M, INDEX_M = 256, 20_000.0, 10_000.0


def lod_tiles(boxes: DataFrame, levels: list[tuple] = LEVELS, pixels: int = PIXELS, reach: float = REACH_M, index: float = INDEX_M) -> DataFrame:
    """lod, col, row, distance of the tiles about boxes (id, min_x, ...): in each level those whose nearest of
    centre and corners lies in the level's band, less tiles that finer ones cover wholly."""
    span = boxes.agg(F.min("min_x") - reach, F.min("min_y") - reach, F.max("max_x") + reach, F.max("max_y") + reach).toDF("x0", "y0", "x1", "y1")
    base = levels[0][1] * pixels
    out = covered = None
    for lod, resolution, nearest, farthest in levels:
        extent = resolution * pixels
        # Ranges follow from the bounds in the plan; tiles are made in parallel per column.
        grid = span.select(F.explode(F.sequence(F.floor(F.col("x0") / extent), F.ceil(F.col("x1") / extent) - 1)).alias("col"), "y0", "y1")
        grid = grid.select("col", F.explode(F.sequence(F.floor(F.col("y0") / extent), F.ceil(F.col("y1") / extent) - 1)).alias("row"))
        places = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0.5, 0.5), (0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0))])
        points = grid.select("col", "row", F.explode(places).alias("p")).select(F.struct("col", "row", "p").alias("id"), ((F.col("col") + F.col("p.dx")) * extent).alias("x"), ((F.col("row") + F.col("p.dy")) * extent).alias("y"))
        far = box_distance(points, boxes, index).groupBy(F.col("id.col").alias("col"), F.col("id.row").alias("row")).agg(F.min("distance").alias("distance"))
        tiles = far.where((F.col("distance") >= nearest) & (F.col("distance") < farthest))
        factor = int(extent / base)
        if covered is not None:
            tiles = uncovered(tiles, covered, factor)
        cells = lambda v, f=factor: F.explode(F.sequence(F.col(v) * f, F.col(v) * f + f - 1))
        own = tiles.select("col", "row").select(cells("col").alias("col"), "row").select("col", cells("row").alias("row"))
        covered = own if covered is None else covered.unionByName(own)
        tiles = tiles.select(F.lit(lod).alias("lod"), "col", "row", "distance")
        out = tiles if out is None else out.unionByName(tiles)
    return out


def tiles_per_lod(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("lod").agg(F.count("*").alias("n_tiles"))


def tile_meta(points: DataFrame) -> DataFrame:
    """(col, row, meta): JSON of each tile's points (name, x, y), properly escaped."""
    listed = F.array_sort(F.collect_list(F.struct("name", "x", "y")))
    return points.groupBy("col", "row").agg(F.to_json(F.struct(F.count("*").alias("n"), listed.alias("stations"))).alias("meta"))


def manifest(tiles: DataFrame, stats: DataFrame) -> DataFrame:
    """One row of JSON: tiles per level and the network's figures; the tile list itself stays a table."""
    counts = tiles_per_lod(tiles).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("lod").cast("string"), "n_tiles")))).alias("lods"))
    return counts.join(F.broadcast(stats)).select(F.to_json(F.struct("lods", F.struct(*stats.columns).alias("stats"))).alias("manifest"))
