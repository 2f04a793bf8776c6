"""Proximity and overlap joins on a uniform grid, and segment intersections.

Spark plans a two-sided range join as a nested loop, so each join here is an
equi-join on cell keys.  Overlaps that meet in several cells are kept in one of
them by the reference-point rule, so no distinct is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVEL_M = 5.0


def cell(x: str | Column, size: float) -> Column:
    return F.floor((F.col(x) if isinstance(x, str) else x) / size)


def _around(rows: DataFrame, size: float, reach: int = 1) -> DataFrame:
    span = lambda v: F.explode(F.sequence(cell(v, size) - reach, cell(v, size) + reach))
    return rows.withColumn("cx", span("x")).withColumn("cy", span("y"))


def within(left: DataFrame, right: DataFrame, radius: float, inclusive: bool = False) -> DataFrame:
    """Pairs (left_id, right_id, d2) of points (id, x, y) nearer than ``radius``; the right side should be the smaller."""
    a = left.select(F.col("id").alias("left_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x", radius).alias("cx"), cell("y", radius).alias("cy"))
    b = _around(right, radius).select(F.col("id").alias("right_id"), F.col("x").alias("bx"), F.col("y").alias("by"), "cx", "cy")
    d2 = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))
    pairs = a.join(b, ["cx", "cy"]).withColumn("d2", d2)
    return pairs.where(F.col("d2") <= radius * radius if inclusive else F.col("d2") < radius * radius).select("left_id", "right_id", "d2")


def nearest_within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """For each left point with any: the nearest right point, the least id on ties."""
    return within(left, right, radius).groupBy("left_id").agg(F.min(F.struct("d2", "right_id")).alias("m")).select("left_id", F.col("m.right_id").alias("right_id"), F.col("m.d2").alias("d2"))


def last_writer(points: DataFrame, writers: DataFrame, radius: float) -> DataFrame:
    """The reverse direction: each writer marks its nearest point; a point keeps its writer of the highest id."""
    return nearest_within(writers, points, radius).groupBy("right_id").agg(F.max("left_id").alias("writer")).select(F.col("right_id").alias("point_id"), "writer")


def box_cells(boxes: DataFrame, size: float) -> DataFrame:
    """``boxes`` (min_x, min_y, max_x, max_y) once per cell they touch."""
    span = lambda v: F.explode(F.sequence(cell(f"min_{v}", size), cell(f"max_{v}", size)))
    return boxes.withColumn("cx", span("x")).withColumn("cy", span("y"))


def covered_cells(boxes: DataFrame, size: float) -> DataFrame:
    """(cx, cy) of the cells that lie wholly in one of the boxes (min_x, min_y, max_x, max_y)."""
    first, last = (lambda v: F.ceil(F.col(f"min_{v}") / size)), (lambda v: F.floor(F.col(f"max_{v}") / size) - 1)
    held = boxes.where((first("x") <= last("x")) & (first("y") <= last("y")))
    span = lambda v: F.explode(F.sequence(first(v), last(v)))
    return held.withColumn("cx", span("x")).withColumn("cy", span("y")).select("cx", "cy").distinct()


def _nearest_box(points: DataFrame, boxes: DataFrame, size: float, reach: int, whole: bool) -> DataFrame:
    """``points`` (id, x, y, d) with d, where null, the distance to the nearest box that touches a cell within ``reach``.

    Unless ``whole``, only if no other box can be nearer. Points that have d ask no cell.
    """
    cx, cy = cell("x", size), cell("y", size)
    ask = F.col("d").isNull()
    around = lambda c: F.sequence(c - reach, c + reach)
    near = points.withColumn("cx", F.explode(F.when(ask, around(cx)).otherwise(F.array(F.lit(None).cast("bigint"))))).withColumn("cy", F.explode(F.when(ask, around(cy)).otherwise(F.array(cy))))
    met = near.join(box_cells(boxes, size).select("cx", "cy", "min_x", "min_y", "max_x", "max_y"), ["cx", "cy"], "left")
    gap = lambda v: F.greatest(F.col(f"min_{v}") - F.col(v), F.col(v) - F.col(f"max_{v}"), F.lit(0.0))
    # A point without a box there has no distance, not that of the one bound that is known.
    apart = F.when(F.col("min_x").isNotNull(), F.sqrt(gap("x") * gap("x") + gap("y") * gap("y")))
    least = met.groupBy("id", "x", "y").agg(F.max("d").alias("d"), F.min(apart).alias("found"))
    room = lambda v, c: [F.col(v) - (c - reach) * size, (c + reach + 1) * size - F.col(v)]
    sure = F.col("found") <= F.least(*room("x", cx), *room("y", cy))
    return least.select("id", "x", "y", F.coalesce("d", "found" if whole else F.when(sure, F.col("found"))).alias("d"))


def box_distance(points: DataFrame, boxes: DataFrame, size: float, reach: int = 3) -> DataFrame:
    """The distance of each point (id, x, y) to the nearest box that touches a cell within ``reach`` of its own; 1e18 without one.

    Where boxes lie over one another most points are in one, which a quarter
    cell that a box covers wholly tells; then the boxes in quarter cells about
    the point are asked, and only points that have none so near ask all cells
    within reach.
    """
    nowhere = F.when(F.col("x").isNull() | F.col("y").isNull(), F.lit(1e18))
    if reach < 1:
        known = points.select("id", "x", "y", nowhere.alias("d"))
    else:
        fine = size / 4
        held = covered_cells(boxes, fine).withColumn("held", F.lit(0.0))
        placed = points.select("id", "x", "y", cell("x", fine).alias("cx"), cell("y", fine).alias("cy")).join(held, ["cx", "cy"], "left")
        known = _nearest_box(placed.select("id", "x", "y", F.coalesce(nowhere, "held").alias("d")), boxes, fine, 1, False)
    least = _nearest_box(known, boxes, size, reach, True).groupBy("id").agg(F.min("d").alias("d"))
    return points.select("id").join(least, "id", "left").select("id", F.coalesce("d", F.lit(1e18)).alias("distance"))


def tile_overlaps(boxes: DataFrame, extent: float) -> DataFrame:
    """(id, col, row) of the square tiles that a box strictly overlaps."""
    last = lambda v: F.greatest(F.ceil(F.col(f"max_{v}") / extent) - 1, cell(f"min_{v}", extent))
    span = lambda v: F.explode(F.sequence(cell(f"min_{v}", extent), last(v)))
    tiles = boxes.withColumn("col", span("x")).withColumn("row", span("y"))
    strict = (F.col("min_x") < (F.col("col") + 1) * extent) & (F.col("max_x") > F.col("col") * extent) & (F.col("min_y") < (F.col("row") + 1) * extent) & (F.col("max_y") > F.col("row") * extent)
    return tiles.where(strict).select("id", "col", "row")


def box_overlaps(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """Pairs (left_id, right_id) of strictly overlapping boxes; a pair counts in the cell of its greater lower corner."""
    a = box_cells(left, size).select("cx", "cy", F.col("id").alias("left_id"), *[F.col(c).alias(f"a_{c}") for c in ("min_x", "min_y", "max_x", "max_y")])
    b = box_cells(right, size).select("cx", "cy", F.col("id").alias("right_id"), *[F.col(c).alias(f"b_{c}") for c in ("min_x", "min_y", "max_x", "max_y")])
    met = a.join(b, ["cx", "cy"])
    here = (cell(F.greatest("a_min_x", "b_min_x"), size) == F.col("cx")) & (cell(F.greatest("a_min_y", "b_min_y"), size) == F.col("cy"))
    strict = (F.col("a_min_x") < F.col("b_max_x")) & (F.col("a_max_x") > F.col("b_min_x")) & (F.col("a_min_y") < F.col("b_max_y")) & (F.col("a_max_y") > F.col("b_min_y"))
    return met.where(here & strict).select("left_id", "right_id")


def in_tile(points: DataFrame, extent: float) -> DataFrame:
    return points.withColumn("col", cell("x", extent)).withColumn("row", cell("y", extent))


def uncovered(tiles: DataFrame, covered: DataFrame, factor: int) -> DataFrame:
    """``tiles`` (col, row) with at least one of their ``factor`` x ``factor`` base cells not in ``covered`` (col, row)."""
    span = lambda v: F.explode(F.sequence(F.col(v) * factor, F.col(v) * factor + factor - 1))
    base = tiles.select("col", "row").withColumn("bc", span("col")).withColumn("br", span("row"))
    free = base.join(covered.select(F.col("col").alias("bc"), F.col("row").alias("br")).distinct(), ["bc", "br"], "left_anti")
    return tiles.join(free.select("col", "row").distinct(), ["col", "row"], "left_semi")


def crossings(a: DataFrame, b: DataFrame, size: float, left: tuple[str, ...] = (), right: tuple[str, ...] = ()) -> DataFrame:
    """(left_id, right_id, ta, tb) where segments (id, x1, y1, x2, y2) cross, ends included; near-parallel ones don't.

    Columns of either side that are named in ``left`` and ``right`` come along,
    and with them the left one's ends as ax1, ay1, ax2, ay2.
    """
    box = lambda s: s.withColumns({f"{m}_{v}": f(f"{v}1", f"{v}2") for v in "xy" for m, f in (("min", F.least), ("max", F.greatest))})
    named = lambda s, p, i, more: box_cells(box(s), size).select("cx", "cy", F.col("id").alias(i), *more, *[F.col(c).alias(p + c) for c in ("x1", "y1", "x2", "y2", "min_x", "min_y")])
    # Dealt out by cell: a broadcast of the smaller side would leave the pairs to as few tasks as the other has files.
    met = named(a, "a", "left_id", left).join(named(b, "b", "right_id", right).hint("merge"), ["cx", "cy"])
    c = F.col
    dx, dy, ex, ey = c("ax2") - c("ax1"), c("ay2") - c("ay1"), c("bx2") - c("bx1"), c("by2") - c("by1")
    denom = dx * ey - dy * ex
    fx, fy = c("bx1") - c("ax1"), c("by1") - c("ay1")
    here = (cell(F.greatest("amin_x", "bmin_x"), size) == c("cx")) & (cell(F.greatest("amin_y", "bmin_y"), size) == c("cy"))
    # Null where near-parallel, as Spark may divide before it filters.
    t = met.where(here).withColumn("denom", F.when(F.abs(denom) >= 1e-12, denom))
    t = t.withColumn("ta", (fx * ey - fy * ex) / c("denom")).withColumn("tb", (fx * dy - fy * dx) / c("denom"))
    return t.where("ta between 0 and 1 and tb between 0 and 1").select("left_id", "right_id", "ta", "tb", *left, *right, *[k for k in ("ax1", "ay1", "ax2", "ay2") if left or right])


def rail_crossing_class(medium: str, road_z: str, rail_z: str) -> Column:
    """How a road crosses a profiled railway."""
    over = F.col(road_z) - F.col(rail_z)
    return F.when(F.col(medium).isin("U", "T"), "RoadOverpass").when(F.col(medium).isin("L", "B"), "RoadUnderpass").when(F.abs(over) < LEVEL_M, "Level").when(over > 0, "RoadOverpass").otherwise("RoadUnderpass")


def road_crossing_class(own_z: Column, other_z: Column) -> Column:
    """How a profiled road crosses another."""
    over = own_z - other_z
    return F.when(F.abs(over) < LEVEL_M, "Level").when(over > 0, "Overpass").otherwise("Underpass")


def polylines(vertices: DataFrame, *carried: str) -> DataFrame:
    """One row per ``seg_id`` with ``coords``, its vertices in order."""
    return vertices.groupBy("seg_id", *carried).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y", "z"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"))).alias("coords"))


def _steps(coords: str) -> Column:
    rest = F.slice(coords, 2, F.greatest(F.size(coords) - 1, F.lit(0)))
    return F.zip_with(F.slice(coords, 1, F.greatest(F.size(coords) - 1, F.lit(0))), rest, lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])))


def length(coords: str = "coords") -> Column:
    return F.aggregate(_steps(coords), F.lit(0.0), lambda a, x: a + x)


def distances(coords: str = "coords") -> Column:
    """Cumulative length at each vertex."""
    return F.aggregate(_steps(coords), F.array(F.lit(0.0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def bounds(coords: str = "coords") -> dict[str, Column]:
    pick = lambda f, v: f(F.transform(coords, lambda p: p[v]))
    return {"min_x": pick(F.array_min, "x"), "min_y": pick(F.array_min, "y"), "max_x": pick(F.array_max, "x"), "max_y": pick(F.array_max, "y")}


def n_samples(length: str, spacing: float) -> Column:
    return F.greatest(F.lit(2), (F.col(length) / spacing).cast("int") + 1)


def densify(lines: DataFrame, spacing: float) -> DataFrame:
    """max(2, int(length / spacing) + 1) samples along each line (seg_id, coords), evenly spread with both ends."""
    placed = lines.withColumn("at", distances()).withColumn("len", F.element_at("at", -1)).where((F.col("len") >= 1) & (F.size("coords") >= 2))
    samples = placed.withColumn("n", n_samples("len", spacing)).select("seg_id", "coords", "at", "len", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("sample"))
    # The share first, so that the last sample is the last vertex to the last bit.
    share = F.col("sample") / (F.col("n") - 1)
    samples = samples.withColumn("d", F.col("len") * share)
    # The piece that holds the place: the last vertex at or before it, short of the last.
    k = F.greatest(F.lit(1), F.least(F.size("at") - 1, F.size(F.filter("at", lambda a: a <= F.col("d")))))
    s = samples.withColumn("k", k)
    a, b = F.element_at("coords", F.col("k")), F.element_at("coords", F.col("k") + 1)
    d0, d1 = F.element_at("at", F.col("k")), F.element_at("at", F.col("k") + 1)
    # A line of one piece takes the share itself, which d / len can miss by a bit.
    t = F.when(F.size("at") == 2, share).when(d1 > d0, (F.col("d") - d0) / (d1 - d0)).otherwise(0.0)
    return s.withColumn("t", t).select("seg_id", "sample", "d", *[(a[v] + F.col("t") * (b[v] - a[v])).alias(v) for v in ("x", "y", "z")])
