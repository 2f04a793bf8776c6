"""Catalogs of sources: elevation rasters and their bounds, archives within archives, layers with fallbacks, cached extracts."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.scalars import box_tag, dtm_inner_path, first_char
from waymark.operators.features import known_categories
from waymark.operators.geodesy import from_utm, to_utm
from waymark.sources.binary import FIELD, HEIGHT, SCALE, TIE, WIDTH
from waymark.sources.formats import zip_entries
from waymark.sources.storage import cached_table

#: The GeoTIFF key of the projected system, names of the inner archives, and how deep they are looked for.
GEO_KEYS, PROJECTED = 34735, 3072
RAILWAY_NAME, ROADS_NAME, DEEPEST = ("Banenettverk", "GML"), ("NVDB-VegnettPluss",), 4
#: Layers in which roads are looked for, in order.
ROAD_LAYERS = ("roads", "Veglenke")
HEADER = "width int, height int, gt array<double>, epsg int"


def tiff_header(data: bytes) -> tuple[int, int, list[float], int]:
    """Width, height, geotransform and EPSG code (0 if none) of a TIFF, without its pixels."""
    end = "<" if data[:2] == b"II" else ">"
    at, tags = struct.unpack_from(end + "I", data, 4)[0], {}
    for k in range(struct.unpack_from(end + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(end + "HHI", data, at + 2 + 12 * k)
        if tag in (WIDTH, HEIGHT, SCALE, TIE, GEO_KEYS):
            size = struct.calcsize(FIELD[kind]) * n
            where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(end + "I", data, at + 10 + 12 * k)[0]
            tags[tag] = struct.unpack_from(f"{end}{n}{FIELD[kind]}", data, where)
    step, tie = tags.get(SCALE, (1.0, 1.0)), tags.get(TIE, (0.0,) * 6)
    gt = [tie[3] - tie[0] * step[0], step[0], 0.0, tie[4] + tie[1] * step[1], 0.0, -step[1]]
    keys = tags.get(GEO_KEYS, ())
    epsg = next((keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k] == PROJECTED), 0)
    return tags[WIDTH][0], tags[HEIGHT][0], gt, epsg


def zone_of(epsg: Column) -> Column:
    """The UTM zone of a European or world grid's code; 33 for any other."""
    return F.when(epsg.between(25828, 25838), epsg - 25800).when(epsg.between(32601, 32660), epsg - 32600).otherwise(33)


def _by_zone(zone: Column, make) -> Column:
    out = make(33)
    for z in (31, 32, 34, 35, 36):
        out = F.when(zone == z, make(z)).otherwise(out)
    return out


def raster_index(spark: SparkSession, path: str) -> DataFrame:
    """A row per elevation raster in the archives under ``path``: zip, inner path, size, geotransform, code, and bounds.

    min_x to max_y are in zone 33, from all four corners; lon_min to lat_max in
    degrees. Only headers are decoded. Entries whose name or header is of no
    raster are left out.
    """
    entries = zip_entries(spark, path).withColumn("inner_path", dtm_inner_path(F.col("entry"))).where("inner_path <> ''")
    wanted = entries.select("zip", "entry", "inner_path")
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("zip"), "content")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content, listed in zip(batch["zip"], batch["content"], batch["listed"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as outer:
                    for e in listed:
                        entry, inner_path = e["entry"], e["inner_path"]
                        with zipfile.ZipFile(io.BytesIO(outer.read(entry))) as inner:
                            tif = inner_path.rsplit("/", 1)[-1]
                            if tif in inner.namelist() and (data := inner.read(tif))[:2] in (b"II", b"MM"):
                                rows.append((name, inner_path, *tiff_header(data)))
            yield pd.DataFrame(rows, columns=["zip", "inner_path", "width", "height", "gt", "epsg"])

    listed = wanted.groupBy("zip").agg(F.collect_list(F.struct("entry", "inner_path")).alias("listed"))
    found = files.join(F.broadcast(listed), "zip").mapInPandas(read, f"zip string, inner_path string, {HEADER}")
    return with_bounds(found)


def with_bounds(rasters: DataFrame) -> DataFrame:
    """Rasters (width, height, gt, epsg) with their bounds in zone 33 and in degrees, from all four corners."""
    zone = zone_of(F.col("epsg"))
    x = [F.col("gt")[0], F.col("gt")[0] + F.col("width") * F.col("gt")[1]]
    y = [F.col("gt")[3], F.col("gt")[3] + F.col("height") * F.col("gt")[5]]
    corners = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a in x for b in y])
    out = rasters.withColumn("zone", zone).withColumn("id", F.monotonically_increasing_id())
    each = out.select("*", F.explode(corners).alias("c"))
    lon, lat = (_by_zone(F.col("zone"), lambda z, k=k: from_utm(F.col("c.x"), F.col("c.y"), z)[k]) for k in (0, 1))
    each = each.withColumn("lon", lon).withColumn("lat", lat)
    east, north = to_utm(F.col("lon"), F.col("lat"), 33)
    same = F.col("zone") == 33
    each = each.withColumn("e", F.when(same, F.col("c.x")).otherwise(east)).withColumn("n", F.when(same, F.col("c.y")).otherwise(north))
    bounds = {"min_x": F.min("e"), "min_y": F.min("n"), "max_x": F.max("e"), "max_y": F.max("n"), "lon_min": F.min("lon"), "lat_min": F.min("lat"), "lon_max": F.max("lon"), "lat_max": F.max("lat")}
    return each.groupBy("id", *[c for c in rasters.columns], "zone").agg(*[v.alias(k) for k, v in bounds.items()]).drop("id", "zone")


def inner_archives(spark: SparkSession, path: str, deepest: int = DEEPEST) -> DataFrame:
    """zip, kind (railway or roads), entry: the first archive of each kind inside the archives under ``path``.

    Folders of an archive are searched to ``deepest`` levels, in order of name.
    """
    found = zip_entries(spark, path).where(F.col("entry").endswith(".zip") & (F.size(F.split("entry", "/")) <= deepest + 1))
    has = lambda words: F.forall(F.array(*map(F.lit, words)), lambda w: F.contains(F.element_at(F.split("entry", "/"), -1), w))
    kind = F.when(has(RAILWAY_NAME), "railway").when(has(ROADS_NAME), "roads")
    return found.withColumn("kind", kind).where("kind is not null").groupBy("zip", "kind").agg(F.min("entry").alias("entry"))


def road_table(features: DataFrame) -> DataFrame:
    """Features (vegkategori, vegnummer, feltoversikt, coords, ...) as the roads layer: known categories, three fields, lines."""
    kept = features.withColumn("kategori", first_char(F.col("vegkategori"), "F")).where(known_categories())
    return kept.select("kategori", F.coalesce(F.col("vegnummer").cast("int"), F.lit(0)).alias("nummer"), F.substring(F.coalesce("feltoversikt", F.lit("")), 1, 10).alias("feltoversikt"), "coords").where(F.size("coords") >= 2)


def cached_roads(spark: SparkSession, path: str, make) -> DataFrame:
    """The roads layer at ``path``, made and written there the first time."""
    return cached_table(spark, path, "kategori", lambda: road_table(make()))


def layer_of_choice(layers: dict[str, DataFrame], wanted: tuple[str, ...] = ROAD_LAYERS) -> DataFrame:
    """The first wanted layer there is, else the first of all."""
    for name in wanted:
        if name in layers:
            return layers[name]
    return next(iter(layers.values()))


def clipped(elements: DataFrame, min_lon: float, min_lat: float, max_lon: float, max_lat: float) -> DataFrame:
    """OSM elements in a rectangle: nodes there, ways with one of them and all nodes of these, relations with one of those."""
    nodes = elements.where("kind = 'node'")
    there = nodes.where(F.col("lon").between(min_lon, max_lon) & F.col("lat").between(min_lat, max_lat)).select("id")
    ways = elements.where("kind = 'way'")
    refs = ways.select("id", F.explode("refs").alias("ref"))
    met = refs.join(there.select(F.col("id").alias("ref")), "ref", "left_semi").select("id").distinct()
    kept = ways.join(met, "id", "left_semi")
    needed = there.union(kept.select(F.explode("refs").alias("id"))).distinct()
    relations = elements.where("kind = 'relation'")
    member = relations.select("id", F.explode("refs").alias("ref")).join(met.select(F.col("id").alias("ref")), "ref", "left_semi").select("id").distinct()
    return nodes.join(needed, "id", "left_semi").unionByName(kept).unionByName(relations.join(member, "id", "left_semi"))


def cached_extract(spark: SparkSession, folder: str, bounds: tuple[float, float, float, float], make) -> DataFrame:
    """Tracks of an extract named by its rounded bounds under ``folder``: reused if it is one, else made and written."""
    name = spark.range(1).select(box_tag(*map(F.lit, bounds)).alias("n")).first().n
    return cached_table(spark, f"{folder}/{name}", "railway", make)
