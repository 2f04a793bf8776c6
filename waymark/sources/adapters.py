"""Views of the star-schema tables as lines, points, rasters and networks.

Each is one SQL text with dialect tokens, so that Spark and an oracle read the
same relation; ``spark_sql`` and ``duckdb_sql`` fill the tokens in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_TEXTS = {
    # line = user, 100 hours = 1 km, value = elevation, null = no data
    "points": """select user_id as line_id, event_id, (MICROS(ts) - 1704067200000000) / CAST(360000000000 AS DOUBLE) as km,
       CASE WHEN CAST(JK as BIGINT) % 25 = 0 THEN NULL ELSE value END as elevation,
       CASE event_type WHEN 'error' THEN 'U' WHEN 'signup' THEN 'L' WHEN 'purchase' THEN 'B' ELSE ' ' END as medium,
       CASE WHEN event_id % 5 = 0 THEN 0 ELSE 60 + 20 * (CAST(floor((MICROS(ts) - 1704067200000000) / CAST(360000000000 AS DOUBLE)) AS INT) % 3) END as speed
from events""",
    # one polyline per order
    "vertices": """select CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'E' WHEN '2' THEN 'R' WHEN '3' THEN 'F' WHEN '4' THEN 'K' ELSE 'P' END as kategori,
       CAST(o_custkey % 97 + 1 AS INT) as nummer, l_orderkey as seg_id,
       row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) as pos,
       CAST((l_partkey*37 + l_linenumber*211) % 20011 AS DOUBLE) as x, CAST((l_suppkey*1009 + l_partkey*13) % 20021 AS DOUBLE) as y, l_quantity as z
from lineitem join orders on l_orderkey = o_orderkey""",
    "stations": """select s_suppkey as line_id, s_name as name, CAST((s_suppkey*37) % 72 AS DOUBLE)/10 as km, CASE WHEN s_nationkey % 4 = 0 THEN 'I' ELSE 'S' END as type
from supplier""",
    "places": "select c_custkey as id, CAST((c_custkey*7919) % 4001 AS DOUBLE) as x, CAST((c_custkey*104729) % 4003 AS DOUBLE) as y from customer",
    "stops": "select s_suppkey as id, CAST((s_suppkey*6151) % 4001 AS DOUBLE) as x, CAST((s_suppkey*12289 + 500) % 4003 AS DOUBLE) as y from supplier",
    # 8 x 8 cells per vector, row-major, null = no data
    "cells": """select vec_id as tile_id, vec_id % 25 as col, CAST(floor(vec_id / 25) AS BIGINT) as row, i as idx,
       CASE WHEN (vec_id + i) % 29 = 0 THEN NULL ELSE 500 * (CAST(CELL AS DOUBLE) + 0.5) END as elevation
from embeddings EXPL""",
    # a weighted forest: the parent of a key is its third
    "forest": "select c_custkey as a, CAST(floor(c_custkey / 3) AS BIGINT) as b, abs(c_acctbal) + 1 as w from customer where c_custkey > 0 and c_mktsegment <> 'BUILDING'",
    "tags": """select event_id, concat('"type"=>"', event_type, '","k"=>"', JK, '"') as tags from events""",
    # short straight segments about the places and the stops
    "roads": "select id, x as x1, y as y1, x + 60 * (id % 7 - 3) + 5 as x2, y + 60 * (id % 5 - 2) + 3 as y2, CAST(id % 50 AS DOUBLE) as z1, CAST(id % 31 AS DOUBLE) as z2 from (PLACES) p",
    "rails": "select id, x as x1, y as y1, x + 300 * (id % 5 - 2) + 7 as x2, y + 300 * (id % 3 - 1) + 11 as y2, CAST(id % 40 AS DOUBLE) as elevation, CASE id % 6 WHEN 0 THEN 'U' WHEN 1 THEN 'L' WHEN 2 THEN 'T' ELSE ' ' END as medium from (STOPS) s",
}
_TOKENS = {
    "spark": {"MICROS(ts)": "unix_micros(cast(ts as timestamp))", "JK": "get_json_object(props, '$.k')", "CELL": "element_at(embedding, cast(i+1 as int))", "EXPL": "lateral view explode(sequence(0L,63L)) e as i"},
    "duckdb": {"MICROS(ts)": "epoch_us(ts)", "JK": "(props->>'$.k')", "CELL": "embedding[i+1]", "EXPL": ", range(64) t(i)"},
}
_TABLES = ("events", "lineitem", "orders", "supplier", "customer", "embeddings")


def _text(name: str, dialect: str) -> str:
    text = _TEXTS[name].replace("PLACES", _TEXTS["places"]).replace("STOPS", _TEXTS["stops"])
    for token, meaning in _TOKENS[dialect].items():
        text = text.replace(token, meaning)
    return text


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The relation ``name`` over the tables in ``sf_dir``."""
    text = _text(name, "spark")
    for table in _TABLES:
        for word in (f"from {table}", f"join {table}"):
            text = text.replace(word, f"{word.split()[0]} {{{table}}}")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **used)


def duckdb_sql(name: str) -> str:
    return _text(name, "duckdb")
