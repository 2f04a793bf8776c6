"""Scalar rules on tags, names and classes, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords of building kinds and roof shapes, road ranks and prefixes, railway types.
BUILDING_KINDS = {
    1: ["house", "residential", "apartments", "detached", "terrace", "semidetached_house", "bungalow", "cabin", "hut", "dormitory", "houseboat", "farm", "static_caravan"],
    2: ["commercial", "retail", "office", "hotel", "supermarket", "kiosk", "shop"],
    3: ["industrial", "warehouse", "factory", "hangar", "manufacture"],
}
ROOF_KINDS = {
    1: ["gabled", "gambrel", "saltbox", "round"],
    2: ["hipped", "half-hipped", "mansard"],
    3: ["pyramidal", "dome", "onion", "cone", "conical"],
    4: ["skillion", "lean_to", "mono_pitch", "monopitch"],
}
ROAD_ORDER = "ERFKP"
ROAD_PREFIX = {"E": "E", "R": "Rv", "F": "Fv", "K": "Kv", "P": "Pv"}
RAILWAY_TYPES = ["rail", "subway", "tram", "light_rail", "narrow_gauge", "construction", "disused", "abandoned", "preserved"]
SPEED_COLOURS = [(130, (40, 160, 40)), (100, (80, 180, 40)), (70, (200, 200, 40)), (40, (220, 140, 40))]
SLOW_COLOUR = (200, 60, 40)
JUNCTION_NAMES = {
    "Switch": "Switch",
    "DoubleSwitch": "Double switch",
    "Diamond": "Diamond crossing",
    "Overpass": "Track overpass",
    "Underpass": "Track underpass",
    "Level": "Road level crossing",
    "RoadOverpass": "Road overpass",
    "RoadUnderpass": "Road underpass",
}
DTM_NAME = r"Basisdata_(\d+-\d+)_Celle_(\d+)_DTM10UTM(\d+)_TIFF\.zip"


def tag(tags: str, key: str) -> Column:
    """The value of ``key`` in a ``"k"=>"v"`` string; empty without it."""
    return F.regexp_extract(tags, f'"{re.escape(key)}"=>"([^"]*)"', 1)


def leading_int(text: Column) -> Column:
    """The integer that a text begins with, after blanks; 0 without one, or with one that is no 32-bit integer."""
    digits = F.regexp_extract(text, r"^\s*([+-]?\d{1,18})", 1)
    number = F.when(digits != "", digits).cast("long")
    return F.coalesce(F.when(number.between(-(1 << 31), (1 << 31) - 1), number).cast("int"), F.lit(0))


def leading_float(text: Column) -> Column:
    """The decimal number that a text begins with, after blanks; 0 without one."""
    digits = F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.coalesce(F.when(digits != "", digits).try_cast("double"), F.lit(0.0))


def nonzero(number: Column) -> Column:
    return F.when(number != 0, number)


def positive(number: Column) -> Column:
    return F.when(number > 0, number)


def not_empty(text: Column) -> Column:
    return F.when(text != "", text)


def first_char(text: Column, default: str) -> Column:
    return F.coalesce(not_empty(F.substring(text, 1, 1)), F.lit(default))


def _kind(text: Column, kinds: dict[int, list[str]]) -> Column:
    out = F.lit(0)
    for kind, words in kinds.items():
        out = F.when(text.isin(words), kind).otherwise(out)
    return out


def building_kind(text: Column) -> Column:
    return _kind(text, BUILDING_KINDS)


def roof_kind(text: Column) -> Column:
    return _kind(text, ROOF_KINDS)


def building_height(levels: Column) -> Column:
    """Three metres a level, two levels if unknown, between 3 and 180."""
    return F.least(F.lit(180.0), F.greatest(F.lit(3.0), F.when(levels > 0, levels).otherwise(2) * 3.0))


def road_rank(kategori: Column) -> Column:
    """0 to 4 in the order of ``ROAD_ORDER``, 99 for any other."""
    rank = F.lit(99)
    for k, code in enumerate(ROAD_ORDER):
        rank = F.when(kategori == code, k).otherwise(rank)
    return rank


def road_label(kategori: str, nummer: str) -> Column:
    prefix = F.col(kategori)
    for code, text in ROAD_PREFIX.items():
        prefix = F.when(F.col(kategori) == code, text).otherwise(prefix)
    return F.concat(prefix, F.col(nummer).cast("string"))


def crossing_label(kategori: str, nummer: str) -> Column:
    """As on crossings: E and Rv, all others Fv."""
    return F.concat(F.when(F.col(kategori) == "E", "E").when(F.col(kategori) == "R", "Rv").otherwise("Fv"), F.col(nummer).cast("string"))


def speed_colour(speed: Column) -> Column:
    out = F.array(*map(F.lit, SLOW_COLOUR))
    for least, rgb in reversed(SPEED_COLOURS):
        out = F.when(speed >= least, F.array(*map(F.lit, rgb))).otherwise(out)
    return out


def elevation_step(extent: Column) -> Column:
    return F.when(extent > 2000, 500).when(extent > 1000, 200).when(extent > 500, 100).otherwise(50)


def km_step(extent: Column) -> Column:
    return F.when(extent > 500, 50).when(extent > 200, 20).when(extent > 100, 10).when(extent > 50, 5).otherwise(1)


def track_type(service: Column) -> Column:
    return F.when(service == "yard", 2).otherwise(1)


def electrified(value: Column) -> Column:
    return F.coalesce(value.isin("yes", "contact_line"), F.lit(False)).cast("int")


def says_yes(value: Column) -> Column:
    return F.coalesce(F.lower(F.substring(value, 1, 1)) == "y", F.lit(False))


def dtm_parts(name: Column) -> list[Column]:
    """sheet, cell and zone of an elevation archive's name; empty where it is none."""
    return [F.regexp_extract(name, DTM_NAME, k).alias(c) for k, c in ((1, "sheet"), (2, "cell"), (3, "zone"))]


def dtm_inner_path(name: Column) -> Column:
    """Where the raster lies in an elevation archive's entry; empty where the name is of none."""
    sheet, cell, zone = (F.regexp_extract(name, DTM_NAME + "$", k) for k in (1, 2, 3))
    inner = F.concat(F.regexp_replace(sheet, "-", "_"), F.lit("_10m_z"), zone, F.lit(".tif"))
    return F.when(zone != "", F.concat(name, F.lit("/"), inner)).otherwise("")


def junction_name(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in JUNCTION_NAMES.items() for x in pair])[kind], F.lit("Unknown"))


def box_tag(*bounds: Column) -> Column:
    """Bounds as part of a file name: two decimals each."""
    return F.format_string("_osm_%.2f_%.2f_%.2f_%.2f", *bounds)


def box_text(*bounds: Column) -> Column:
    """Bounds as an argument: six decimals each."""
    return F.format_string("%.6f,%.6f,%.6f,%.6f", *bounds)


def tile_path(lod: str, col: str, row: str) -> Column:
    return F.format_string("tiles/%d/%d_%d/", F.col(lod), F.col(col), F.col(row))
