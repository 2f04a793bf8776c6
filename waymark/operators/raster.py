"""Rasters as rows (tile_id, width, height, cells) with row-major cells, null for no data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Colour stops (place, red, green, blue) and land-cover codes (code, name, red, green, blue).
STOPS = [
    (0.00, 1, 97, 69),
    (0.15, 46, 153, 79),
    (0.30, 121, 200, 87),
    (0.45, 233, 230, 110),
    (0.55, 205, 163, 69),
    (0.70, 157, 110, 68),
    (0.85, 185, 176, 172),
    (1.00, 255, 255, 255),
]
LAND_COVER = [
    (10, "Built-up", 160, 160, 160),
    (20, "Agriculture", 240, 220, 130),
    (30, "Forest", 34, 139, 34),
    (50, "Open land", 194, 178, 128),
    (60, "Bog", 107, 142, 35),
    (70, "Glacier", 220, 240, 255),
    (80, "Freshwater", 65, 105, 225),
    (81, "Sea", 30, 60, 150),
]
NO_DATA_RGB, LOW_RGB = (70, 130, 180), (0, 80, 80)
TINT = 0.4


def tiles(cells: DataFrame, width: int, height: int) -> DataFrame:
    """Gather cells (tile_id, idx, elevation) to one row per tile."""
    found = cells.groupBy("tile_id").agg(F.array_sort(F.collect_list(F.struct("idx", "elevation"))).alias("c"))
    return found.select("tile_id", F.lit(width).alias("width"), F.lit(height).alias("height"), F.transform("c", lambda p: p["elevation"]).alias("cells"))


def bilinear(fx: Column, fy: Column, width: str = "width", height: str = "height", cells: str = "cells") -> Column:
    """The value at pixel coordinates, from corners without a half-pixel shift; null outside the interior or by a null cell."""
    ix, iy = F.floor(fx).cast("int"), F.floor(fy).cast("int")
    inside = (ix >= 0) & (iy >= 0) & (ix <= F.col(width) - 2) & (iy <= F.col(height) - 2)
    v = lambda dx, dy: F.get(cells, (iy + dy) * F.col(width) + ix + dx)
    tx, ty = fx - ix, fy - iy
    top, bottom = v(0, 0) * (1 - tx) + v(1, 0) * tx, v(0, 1) * (1 - tx) + v(1, 1) * tx
    return F.when(inside, top * (1 - ty) + bottom * ty)


def sample_first(points: DataFrame, rasters: DataFrame, size: float) -> DataFrame:
    """The value of each point (id, x, y) from the first raster, by tile_id, that has one there.

    Rasters (tile_id, x0, y0, step, width, height, cells) go from x0 east and from
    y0 south. Points meet the rasters of their grid cell only.
    """
    extent = rasters.withColumns({"min_x": F.col("x0"), "max_x": F.col("x0") + F.col("step") * F.col("width"), "max_y": F.col("y0"), "min_y": F.col("y0") - F.col("step") * F.col("height")})
    span = lambda v: F.explode(F.sequence(F.floor(F.col(f"min_{v}") / size), F.floor(F.col(f"max_{v}") / size)))
    placed = extent.withColumn("cx", span("x")).withColumn("cy", span("y"))
    met = points.withColumn("cx", F.floor(F.col("x") / size)).withColumn("cy", F.floor(F.col("y") / size)).join(placed, ["cx", "cy"])
    inside = F.col("x").between(F.col("min_x"), F.col("max_x")) & F.col("y").between(F.col("min_y"), F.col("max_y"))
    value = bilinear((F.col("x") - F.col("x0")) / F.col("step"), (F.col("y0") - F.col("y")) / F.col("step"))
    found = met.where(inside).withColumn("value", value).where("value is not null")
    first = found.groupBy("id").agg(F.min_by("value", "tile_id").alias("elevation"))
    return points.select("id").join(first, "id", "left")


def extent_of(rasters: DataFrame) -> DataFrame:
    """Least and greatest value of each tile; (0, 1) without data."""
    known = F.filter("cells", lambda v: v.isNotNull())
    return rasters.select("tile_id", F.coalesce(F.array_min(known), F.lit(0.0)).alias("low"), F.coalesce(F.array_max(known), F.lit(1.0)).alias("high"))


def _blend(a: Column, b: Column, t: Column) -> Column:
    return F.floor(a + t * (b - a)).cast("int")


def colour(elevation: str, low: str, high: str, artype: str) -> list[Column]:
    """red, green, blue of a cell; land cover 0 is none."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(elevation) - F.col(low)) / (F.col(high) - F.col(low))))
    out = []
    for k, name in enumerate(("red", "green", "blue")):
        ramp = F.lit(None).cast("int")
        for lower, upper in reversed(list(zip(STOPS[:-1], STOPS[1:], strict=True))):
            ramp = F.when(t <= upper[0], _blend(F.lit(lower[k + 1]), F.lit(upper[k + 1]), (t - lower[0]) / (upper[0] - lower[0]))).otherwise(ramp)
        tint = F.lit(128)
        for code, *rest in LAND_COVER:
            tint = F.when(F.col(artype) == code, rest[k + 1]).otherwise(tint)
        value = F.when(F.col(artype) == 0, ramp).otherwise(_blend(ramp, tint, F.lit(TINT)))
        value = F.when(F.col(elevation) <= 0, LOW_RGB[k]).otherwise(value)
        for code, *rest in LAND_COVER:
            if code in (70, 80, 81):
                value = F.when(F.col(artype) == code, rest[k + 1]).otherwise(value)
        out.append(F.when(F.col(elevation).isNull(), NO_DATA_RGB[k]).otherwise(value).alias(name))
    return out


def land_cover_name(artype: str) -> Column:
    name = F.lit(None).cast("string")
    for code, called, *_ in LAND_COVER:
        name = F.when(F.col(artype) == code, called).otherwise(name)
    return name


def _fill(g: np.ndarray, passes: int) -> np.ndarray:
    """``g`` with its NaN cells filled in place and in raster order, pass by pass.

    Cells that are filled in one pass see those filled before them in it, so
    only cells next to known ones, or behind such in raster order, are visited.
    """
    h, w = g.shape
    padded = np.full((h + 2, w + 2), np.nan)
    padded[1:-1, 1:-1] = g
    flat, step = padded.ravel().tolist(), w + 2
    holes = [(r + 1) * step + c + 1 for r, c in np.argwhere(np.isnan(g)).tolist()]
    for _ in range(passes):
        left = []
        for k in holes:
            near = [v for v in (flat[k - step], flat[k + step], flat[k - 1], flat[k + 1]) if v == v]
            if near:
                flat[k] = sum(near) / len(near)
            else:
                left.append(k)
        if len(left) == len(holes):
            break
        holes = left
    return np.array(flat).reshape(h + 2, step)[1:-1, 1:-1]


def fill_gaps(rasters: DataFrame, passes: int = 10) -> DataFrame:
    """Fill cells without data with the mean of their known 4-neighbours, in place and in raster order, pass by pass."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, done = batch["cells"], []
            widths, heights = batch["width"].to_pylist(), batch["height"].to_pylist()
            for k in range(batch.num_rows):
                cells = column[k].values.to_numpy(zero_copy_only=False).astype(float)
                done.append(_fill(cells.reshape(heights[k], widths[k]), passes).ravel())
            flat = np.concatenate(done) if done else np.zeros(0)
            offsets = pa.array(np.cumsum([0, *map(len, done)]), pa.int32())
            # No data is null, by a mask.
            filled = pa.ListArray.from_arrays(offsets, pa.array(flat, mask=np.isnan(flat)))
            yield pa.RecordBatch.from_arrays([filled if n == "cells" else batch[n] for n in batch.schema.names], batch.schema.names)

    return rasters.mapInArrow(fill, rasters.schema)


def affine(col: Column, row: Column, gt: str = "gt") -> tuple[Column, Column]:
    """Geographic place of a pixel by a geotransform of six numbers."""
    g = [F.col(gt)[k] for k in range(6)]
    return g[0] + col * g[1] + row * g[2], g[3] + col * g[4] + row * g[5]


def affine_inverse(x: Column, y: Column, gt: str = "gt") -> tuple[Column, Column]:
    """Pixel column and row of a place; null where the geotransform has no inverse."""
    g = [F.col(gt)[k] for k in range(6)]
    det = g[1] * g[5] - g[2] * g[4]
    dx, dy = x - g[0], y - g[3]
    return F.try_divide(g[5] * dx - g[2] * dy, det), F.try_divide(g[1] * dy - g[4] * dx, det)


def pixel_lookup(rasters: DataFrame, col: Column, row: Column, width: str = "width", height: str = "height", cells: str = "cells") -> Column:
    """The cell at a pixel, null outside the raster."""
    inside = (col >= 0) & (col < F.col(width)) & (row >= 0) & (row < F.col(height))
    return F.when(inside, F.get(rasters[cells], (row * F.col(width) + col).cast("int")))


def _inside(x: Column, y: Column) -> Column:
    """Whether a place is in ``ring``, by the even-odd rule."""
    after = F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1))
    crossed = lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < a["x"] + (b["x"] - a["x"]) * F.try_divide(y - a["y"], b["y"] - a["y"]))
    sides = F.zip_with("ring", after, lambda a, b: F.when(crossed(a, b), 1).otherwise(0))
    return F.aggregate(sides, F.lit(0), lambda n, s: n + s) % 2 == 1


def uppermost(polygons: DataFrame, size: float) -> DataFrame:
    """Polygons (ord, artype, ring) with their bounds, once per cell (cx, cy) in which a pixel may be theirs.

    In each cell those under one that fills it are left out: the last polygon
    that holds a pixel there is that one or a later one.
    """
    pick = lambda f, v: f(F.transform("ring", lambda p: p[v]))
    boxed = polygons.withColumns({"min_x": pick(F.array_min, "x"), "max_x": pick(F.array_max, "x"), "min_y": pick(F.array_min, "y"), "max_y": pick(F.array_max, "y")})
    span = lambda v: F.explode(F.sequence(F.floor(F.col(f"min_{v}") / size), F.floor(F.col(f"max_{v}") / size)))
    placed = boxed.withColumn("cx", span("x")).withColumn("cy", span("y"))
    # A cell without any side near it is in the ring or out of it as a whole.
    after = F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1))
    meets = lambda a, b, v: (F.least(a[v], b[v]) <= (F.col(f"c{v}") + 1) * size) & (F.greatest(a[v], b[v]) >= F.col(f"c{v}") * size)
    sided = F.exists(F.zip_with("ring", after, lambda a, b: meets(a, b, "x") & meets(a, b, "y")), lambda m: m)
    fills = ~sided & _inside((F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size)
    best = F.max(F.when(fills, F.col("ord"))).over(W.partitionBy("cx", "cy"))
    return placed.withColumn("best", best).where(F.col("best").isNull() | (F.col("ord") >= F.col("best"))).drop("best")


def burn(pixels: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """artype of each pixel centre (id, x, y): the last polygon (ord, artype, ring) by ord that holds it, by the even-odd rule; else 0.

    Codes outside 0-255 become 0. Rings are arrays of (x, y), closed or not.
    Pixels meet the polygons of their quarter cell that none above them fills.
    """
    fine = size / 4
    met = pixels.withColumn("cx", F.floor(F.col("x") / fine)).withColumn("cy", F.floor(F.col("y") / fine)).join(uppermost(polygons, fine), ["cx", "cy"])
    met = met.where(F.col("x").between(F.col("min_x"), F.col("max_x")) & F.col("y").between(F.col("min_y"), F.col("max_y")))
    held = met.where(_inside(F.col("x"), F.col("y")))
    last = held.groupBy("id").agg(F.max_by("artype", "ord").alias("artype"))
    code = F.when(F.col("artype").between(0, 255), F.col("artype")).otherwise(0)
    return pixels.select("id").join(last, "id", "left").select("id", F.coalesce(code, F.lit(0)).alias("artype"))
