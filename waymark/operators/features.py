"""Filters and derived geometry of network and map features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from waymark.operators.profile import BED_OFFSET, FLOOR, MIN_PLAUSIBLE
from waymark.operators.raster import sample_first
from waymark.operators.spatial import distances, length, nearest_within
from waymark.sources.storage import materialize

# Categories that a profiled road is held against, snap distance and stride, shortest siding.
AGAINST = {"E": "ERF", "R": "ERF", "F": "ERF", "K": "ERFK"}
SNAP_M, STRIDE, SHORTEST_M = 50.0, 10, 5.0


def operational(status: str = "banestatus") -> Column:
    return F.col(status) == "I"


def of_line(name: str, value: str) -> Column:
    return F.col(name) == F.lit(value)


def siding(service: str = "service", usage: str = "usage") -> Column:
    return F.coalesce(F.col(service).isin("siding", "yard"), F.lit(False)) | F.coalesce(F.col(usage) == "industrial", F.lit(False))


def crossing_roads(category: str, profiled: str) -> Column:
    """The categories that cross a profiled road of one category."""
    return F.col(category).isin(list(AGAINST.get(profiled, "ERFKP")))


def touches(min_x: float, min_y: float, max_x: float, max_y: float) -> Column:
    """A rectangle on stored bounds: plain comparisons, which reach the Parquet scan."""
    return (F.col("min_x") <= max_x) & (F.col("max_x") >= min_x) & (F.col("min_y") <= max_y) & (F.col("max_y") >= min_y)


def of_road(kategori: str, nummer: int) -> Column:
    """One road."""
    return (F.col("kategori") == F.lit(kategori)) & (F.col("nummer") == F.lit(nummer))


def known_categories(category: str = "kategori") -> Column:
    return F.col(category).isin(list("ERFKP"))


def near(bounds: tuple[float, float, float, float], room: float) -> Column:
    """:func:`touches` of a rectangle with room about it."""
    x0, y0, x1, y1 = bounds
    return touches(x0 - room, y0 - room, x1 + room, y1 + room)


def inside(x: str, y: str, min_x: Column | float, min_y: Column | float, max_x: Column | float, max_y: Column | float) -> Column:
    """Whether a point lies in a rectangle, its sides included."""
    return F.col(x).between(min_x, max_x) & F.col(y).between(min_y, max_y)


def line_parts(features: DataFrame) -> DataFrame:
    """Features (..., kind, parts) of lines and multi-lines as a row per part, ``coords``, of two vertices or more; others go.

    Of a line only its first part counts.
    """
    kept = features.where(F.col("kind").isin("LineString", "MultiLineString"))
    parts = F.when(F.col("kind") == "LineString", F.slice("parts", 1, 1)).otherwise(F.col("parts"))
    rest = [c for c in features.columns if c not in ("kind", "parts")]
    return kept.select(*rest, F.posexplode(parts).alias("part", "coords")).where(F.size("coords") >= 2)


def exterior(features: DataFrame) -> DataFrame:
    """Polygons (..., polygons), arrays of rings, as a row per polygon with its outer ring; holes go."""
    rest = [c for c in features.columns if c != "polygons"]
    return features.select(*rest, F.posexplode("polygons").alias("part", "rings")).select(*rest, "part", F.get("rings", 0).alias("ring")).where("ring is not null")


def all_tracks(main: DataFrame, branches: DataFrame) -> DataFrame:
    """Main lines (seg_id, line, medium, coords) and sidings together, with a dense track_id and their type; sidings are 1 or 2."""
    both = main.select("seg_id", "line", "medium", "coords", F.lit(0).alias("type")).unionByName(branches.select("seg_id", "line", "medium", "coords", "type"))
    # Ids without holes, by type and segment, from counts before each: no window over all rows in one task.
    counts = both.groupBy("type", "seg_id").agg(F.count("*").alias("n"))
    return both.join(dense_ids(counts, ["type", "seg_id"], "track_id"), ["type", "seg_id"])


def dense_ids(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """``rows`` with ``out``, 0, 1, 2 ... in the order of unique keys: ranges are numbered each and begin after those before."""
    ranged = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()).withColumn("within", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    sizes = ranged.groupBy("range").agg(F.count("*").alias("size"))
    # As many rows as there are partitions.
    begin = sizes.select("range", (F.sum("size").over(W.orderBy("range")) - F.col("size")).alias("begin"))
    return ranged.join(F.broadcast(begin), "range").withColumn(out, F.col("begin") + F.col("within")).drop("range", "within", "begin")


def track_stats(tracks: DataFrame) -> DataFrame:
    """One row: total_km (cut to whole), n_main and n_siding segments, n_lines of main tracks."""
    measured = tracks.select("line", "type", length().alias("len"))
    main = F.col("type") == 0
    return measured.agg((F.coalesce(F.sum("len"), F.lit(0.0)) / 1000).cast("int").alias("total_km"), F.count_if(main).alias("n_main"), F.count_if(~main).alias("n_siding"), F.countDistinct(F.when(main & (F.col("line") != ""), F.col("line"))).alias("n_lines"))


def ring(coords: str) -> Column:
    """A ring without its repeated last vertex; null if fewer than three are left."""
    closed = F.element_at(coords, 1) == F.element_at(coords, -1)
    opened = F.when((F.size(coords) >= 2) & closed, F.slice(coords, 1, F.greatest(F.size(coords) - 1, F.lit(0)))).otherwise(F.col(coords))
    return F.when(F.size(opened) >= 3, opened)


def base_elevation(rings: DataFrame, rasters: DataFrame, size: float) -> DataFrame:
    """``rings`` (id, ring) with base, the least sampled vertex; rings without any are dropped."""
    vertices = rings.select("id", F.posexplode("ring").alias("k", "p"))
    at = vertices.select(F.struct("id", "k").alias("id"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    sampled = sample_first(at, rasters, size).groupBy(F.col("id.id").alias("id")).agg(F.min("elevation").alias("base"))
    return rings.join(sampled.where("base is not null"), "id")


def siding_elevations(coords: str) -> Column:
    """Vertices with plausible elevation on the track bed, at or over the floor; others are dropped, and lines of under two."""
    kept = F.filter(coords, lambda p: p["z"] >= MIN_PLAUSIBLE)
    raised = F.transform(kept, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.greatest(p["z"] + BED_OFFSET, F.lit(FLOOR)).alias("z")))
    return F.when(F.size(raised) >= 2, raised)


def sidings(lines: DataFrame) -> DataFrame:
    long_enough = lines.where(F.element_at(distances(), -1) >= SHORTEST_M)
    return long_enough.withColumn("coords", siding_elevations("coords")).where("coords is not null")


def snap_connections(branch: DataFrame, main: DataFrame, radius: float = SNAP_M) -> DataFrame:
    """(seg_id, at_end, main_id, d2): each end of a branch to the nearest vertex of a main line; of those the first, the last and every tenth count."""
    vertices = main.select("seg_id", F.size("coords").alias("n"), F.posexplode("coords").alias("k", "p")).where((F.col("k") % STRIDE == 0) | (F.col("k") == F.col("n") - 1))
    targets = vertices.select(F.struct("seg_id", "k").alias("id"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    first, last = F.element_at("coords", 1), F.element_at("coords", -1)
    both = branch.select("seg_id", F.posexplode(F.array(first, last)).alias("e", "p")).select(F.struct("seg_id", "e").alias("id"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    near = nearest_within(both, targets, radius)
    return near.select(F.col("left_id.seg_id").alias("seg_id"), F.col("left_id.e").alias("at_end"), F.col("right_id.seg_id").alias("main_id"), "d2")


def own_medium_separated(own: Column, others: Column) -> Column:
    """Whether any other line's medium passes over or under ours; ``others`` is an array."""
    apart = lambda a, b: (a.isin("U", "T", "L", "B") & (b == " ")) | ((a == " ") & b.isin("U", "T", "L", "B"))
    return F.exists(others, lambda m: apart(own, m))
