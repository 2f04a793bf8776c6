"""What map and profile windows ask of the data: overlays, lookups, listings and their coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.scalars import junction_name
from waymark.operators.features import inside, touches
from waymark.operators.geodesy import from_utm
from waymark.operators.raster import affine, land_cover_name, pixel_lookup, sample_first

# Half the side of a local map, metres a pixel of it, and metres between its elevation samples.
HALF_M, SCALE_M, SAMPLE_M = 2000.0, 2.0, 10
#: Fixed values of a profile diagram in pixels: left and right margin, top margin, height of the plot.
LEFT_PX, RIGHT_PX, TOP_PX, PLOT_PX = 70, 30, 20, 450


def bounds_of(boxes: DataFrame) -> DataFrame:
    """One row: the bounds of all boxes, zeros without any."""
    pick = {"min_x": F.min, "min_y": F.min, "max_x": F.max, "max_y": F.max}
    return boxes.agg(*[F.coalesce(f(c), F.lit(0.0)).alias(c) for c, f in pick.items()])


def profile_bounds(points: DataFrame, room: float) -> DataFrame:
    """The bounds of each line's points with room about them."""
    return points.groupBy("line_id").agg((F.min("x") - room).alias("min_x"), (F.min("y") - room).alias("min_y"), (F.max("x") + room).alias("max_x"), (F.max("y") + room).alias("max_y"))


def overlay(layers: dict[str, DataFrame], bounds: tuple[float, float, float, float]) -> DataFrame:
    """(layer, id) of what lies in a map's rectangle: features by stored bounds, points (x, y) by place.

    Comparisons of plain columns, so that they reach the scans.
    """
    out = None
    for name, rows in layers.items():
        cond = touches(*bounds) if "min_x" in rows.columns else inside("x", "y", *bounds)
        part = rows.where(cond).select(F.lit(name).alias("layer"), F.col("id").cast("long").alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


def local_map(layers: dict[str, DataFrame], x: float, y: float, half: float = HALF_M) -> DataFrame:
    """The overlay of the local map about a point: without buildings and land cover."""
    kept = {n: d for n, d in layers.items() if n not in ("buildings", "land_cover")}
    return overlay(kept, (x - half, y - half, x + half, y + half))


def crop(spark: SparkSession, x: float, y: float, rasters: DataFrame, size: float, half: float = HALF_M, step: int = SAMPLE_M) -> DataFrame:
    """row, col, elevation of the samples of a local map, at the centres of squares of ``step`` metres, from the north."""
    n = int(2 * half / step)
    grid = spark.range(n * n).select(F.floor(F.col("id") / n).alias("row"), (F.col("id") % n).alias("col"))
    places = grid.select(F.struct("row", "col").alias("id"), (F.lit(x - half) + (F.col("col") + 0.5) * step).alias("x"), (F.lit(y + half) - (F.col("row") + 0.5) * step).alias("y"))
    return sample_first(places, rasters, size).select("id.row", "id.col", "elevation")


def to_pixel(x: Column, y: Column, cx: Column, cy: Column, half: float = HALF_M, scale: float = SCALE_M) -> tuple[Column, Column]:
    """Pixel of a place on the local map about (cx, cy), cut to whole numbers."""
    return ((x - cx + half) / scale).cast("int"), ((cy + half - y) / scale).cast("int")


def to_place(px: Column, py: Column, cx: Column, cy: Column, half: float = HALF_M, scale: float = SCALE_M) -> tuple[Column, Column]:
    return cx - half + px * scale, cy + half - py * scale


def from_centre(x: Column, y: Column, cx: Column, cy: Column) -> Column:
    return F.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))


def diagram_x(km: Column, first: Column, last: Column, width: int) -> Column:
    """Pixel of a km on a profile diagram of ``width`` pixels."""
    span = F.when(last - first <= 0, F.lit(1.0)).otherwise(last - first)
    return (F.lit(LEFT_PX) + ((km - first) / span * (width - LEFT_PX - RIGHT_PX)).cast("int")).cast("int")


def diagram_y(elevation: Column, low: Column, high: Column) -> Column:
    span = F.when(high - low <= 0, F.lit(1.0)).otherwise(high - low)
    return (F.lit(TOP_PX) + ((1.0 - (elevation - low) / span) * PLOT_PX).cast("int")).cast("int")


def diagram_km(px: Column, first: Column, last: Column, width: int) -> Column:
    plot = width - LEFT_PX - RIGHT_PX
    return first if plot <= 0 else first + (px - LEFT_PX) / plot * (last - first)


def diagram_elevation(py: Column, low: Column, high: Column) -> Column:
    return low + (1.0 - (py - TOP_PX) / PLOT_PX) * (high - low)


def pixel_facts(rasters: DataFrame, pixels: DataFrame, zone: int = 33) -> DataFrame:
    """Elevation, place in degrees and land cover of pixels (tile_id, col, row) of rasters (tile_id, width, height, gt, cells, cover)."""
    met = pixels.join(rasters, "tile_id")
    col, row = F.col("col"), F.col("row")
    gx, gy = affine(col, row)
    lon, lat = from_utm(gx, gy, zone)
    code = pixel_lookup(met, col, row, cells="cover")
    found = met.withColumn("artype", code).withColumn("lon", lon).withColumn("lat", lat).withColumn("elevation", pixel_lookup(met, col, row))
    return found.select("tile_id", "col", "row", "elevation", "lon", "lat", "artype", land_cover_name("artype").alias("cover_name"))


def junction_listing(junctions: DataFrame) -> DataFrame:
    """km, elevation, type and description of junctions as their list shows them, in order of km."""
    name = junction_name(F.when(F.col("kind") == "RoadLevel", "Level").otherwise(F.col("kind")))
    switches = F.when(F.col("n_switches") > 0, F.format_string(" (%d)", "n_switches")).otherwise("")
    shown = junctions.select("line_id", "km", F.format_string("%.1f", "km").alias("km_text"), F.format_string("%.0f m", "elevation").alias("elevation_text"), F.concat(name, switches).alias("type"), "description")
    return shown.orderBy("line_id", "km", "type", "description")


def intersection_listing(met: DataFrame) -> DataFrame:
    """The same of a road's crossings."""
    kind = F.when(F.col("kind") == "Level", "Level crossing").otherwise(F.col("kind"))
    what = F.when(F.col("is_railway"), "Railway").otherwise("Road")
    shown = met.select("road", "km", F.format_string("%.1f", "km").alias("km_text"), F.format_string("%.0f m", "elevation").alias("elevation_text"), F.concat(what, F.lit(" — "), kind).alias("type"), F.col("crossing").alias("name"))
    return shown.orderBy("road", "km", "type", "name")


def crossing_counts(met: DataFrame) -> DataFrame:
    """How many railways and roads each profiled road crosses."""
    return met.groupBy("road").agg(F.count_if("is_railway").alias("n_railways"), F.count_if(~F.col("is_railway")).alias("n_roads"), F.count("*").alias("n_all"))


def layer_counts(features: DataFrame) -> DataFrame:
    """Features of each layer, and of all as ``total``."""
    each = features.groupBy("layer").agg(F.count("*").alias("n"))
    return each.unionByName(each.agg(F.lit("total").alias("layer"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))


def archive_totals(entries: DataFrame) -> DataFrame:
    """One row: archives, their entries, and the elevation rasters among these."""
    return entries.agg(F.countDistinct("zip").alias("n_archives"), F.count("*").alias("n_entries"), F.count_if(F.col("inner_path") != "").alias("n_rasters"))
