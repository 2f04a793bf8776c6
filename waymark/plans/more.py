"""Queries of filters, features, blocks, whole profiles, views and coordinates, with DuckDB SQL by brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import scalars as S
from waymark.operators import export as E
from waymark.operators import features as K
from waymark.operators import geodesy as G
from waymark.operators import junctions as J
from waymark.operators import network as N
from waymark.operators import profile as P
from waymark.operators import rails as L
from waymark.operators import raster as R
from waymark.operators import roads as O
from waymark.operators import spatial as X
from waymark.operators import views as V
from waymark.plans.queries import _CLEAN, _GAUSS, _GRADE, _boxes, _limit_sql, _lines, query, rounded
from waymark.sources import catalog, formats
from waymark.sources.adapters import relation

#: Metres of a test raster's cell, and of its side; neighbours share a row of cells.
STEP, SIDE = 70.0, 490.0
SIZE = 560.0


def _rasters(spark, sf_dir):
    cells = relation(spark, sf_dir, "cells")
    place = cells.select("tile_id", (F.col("col") * SIDE).alias("x0"), (F.col("row") * SIDE + 8 * STEP).alias("y0")).distinct()
    return R.tiles(cells, 8, 8).join(place, "tile_id").withColumn("step", F.lit(STEP))


# Every point against every raster that may hold it; the least tile with a value wins.
_TILES = f"tiles as (select tile_id, col * {SIDE} as x0, row * {SIDE} + {8 * STEP} as y0, list(elevation order by idx) as c from cells group by tile_id, col, row)"


def _sample_sql(source: str, out: str) -> str:
    """``out`` (id, elevation): the bilinear value of the points (id, x, y) in ``source``."""
    v = lambda dx, dy: f"c[(iy + {dy}) * 8 + ix + {dx} + 1]"
    return f"""{out}f as (select p.id, t.tile_id, t.c, (p.x - x0) / {STEP} as fx, (y0 - p.y) / {STEP} as fy from {source} p join tiles t on p.x between x0 and x0 + {8 * STEP} and p.y between y0 - {8 * STEP} and y0),
{out}i as (select *, cast(floor(fx) as int) as ix, cast(floor(fy) as int) as iy from {out}f),
{out}v as (select id, tile_id, ({v(0, 0)} * (1 - (fx - ix)) + {v(1, 0)} * (fx - ix)) * (1 - (fy - iy)) + ({v(0, 1)} * (1 - (fx - ix)) + {v(1, 1)} * (fx - ix)) * (fy - iy) as value from {out}i where ix between 0 and 6 and iy between 0 and 6),
{out} as (select id, arg_min(value, tile_id) as elevation from {out}v where value is not null group by id)"""


# --- filters and scalar rules -------------------------------------------------------------------


@query("""select id, id % 3 = 0 as operational, 'L' || id % 7 = 'L2' as of_line, coalesce(service in ('siding', 'yard'), false) or coalesce(usage = 'industrial', false) as siding, case when service = 'yard' then 2 else 1 end as track_type,
cast(coalesce(service in ('yes', 'contact_line'), false) as int) as electrified, coalesce(lower(substr(service, 1, 1)) = 'y', false) as says_yes, nullif(service, '') as not_empty, case when coalesce(service, '') = '' then ' ' else substr(service, 1, 1) end as first_char
from (select id, ([null, '', 'siding', 'yard', 'yes', 'contact_line', 'Yes', 'spur'])[1 + id % 8] as service, ([null, 'industrial', 'main'])[1 + id % 3] as usage from places)""", "places")
def track_rules(spark, sf_dir):
    pick = lambda words, n: F.get(F.array(*[F.lit(w) for w in words]), (F.col("id") % n).cast("int"))
    rows = relation(spark, sf_dir, "places").select("id", F.when(F.col("id") % 3 == 0, "I").otherwise("N").alias("banestatus"), F.concat(F.lit("L"), (F.col("id") % 7).cast("string")).alias("line"), pick([None, "", "siding", "yard", "yes", "contact_line", "Yes", "spur"], 8).alias("service"), pick([None, "industrial", "main"], 3).alias("usage"))
    s = F.col("service")
    return rows.select("id", K.operational().alias("operational"), K.of_line("line", "L2").alias("of_line"), K.siding().alias("siding"), S.track_type(s).alias("track_type"), S.electrified(s).alias("electrified"), S.says_yes(s).alias("says_yes"), S.not_empty(s).alias("not_empty"), S.first_char(s, " ").alias("first_char"))


@query("""select kategori, nummer, kategori in ('E', 'R', 'F') as against_e, kategori in ('E', 'R', 'F', 'K') as against_k, kategori in ('E', 'R', 'F', 'K', 'P') as against_p, kategori in ('E', 'R', 'F', 'K', 'P') as known, kategori = 'R' and nummer = 7 as one_road,
cast(case kategori when 'E' then 0.05 when 'R' then 0.06 when 'F' then 0.08 when 'K' then 0.1 else 0.12 end as double) as grade, cast(case when kategori in ('E', 'R', 'F') then 25 else 50 end as double) as spacing from (select distinct kategori, nummer from vertices)""", "vertices")
def road_filters(spark, sf_dir):
    roads = relation(spark, sf_dir, "vertices").select("kategori", "nummer").distinct()
    against = [K.crossing_roads("kategori", c).alias(f"against_{c.lower()}") for c in "EKP"]
    k = F.col("kategori")
    return roads.select("kategori", "nummer", *against, K.known_categories().alias("known"), K.of_road("R", 7).alias("one_road"), O.parameter(k, 1).alias("grade"), O.parameter(k, 3).alias("spacing"))


@query("""select p_partkey, p_size, name, regexp_extract(name, 'Basisdata_(\\d+-\\d+)_', 1) as sheet, case when name like '%TIFF.zip' then name || '/' || (p_partkey % 900 + 1) || '_' || (p_size % 4) || '_10m_z' || (32 + p_size % 3) || '.tif' else '' end as inner_path,
'tiles/' || (p_size % 4) || '/' || p_partkey || '_' || (p_partkey % 17) || '/' as path, printf('_osm_%.2f_%.2f_%.2f_%.2f', p_retailprice, p_size::double, p_size / 7.0::double, 0.0::double) as tag, printf('%.6f,%.6f,%.6f,%.6f', p_retailprice, p_size::double, p_size / 7.0::double, 0.0::double) as box
from (select *, case when p_size % 5 = 0 then 'Other_' || p_partkey || '.zip' else 'Basisdata_' || (p_partkey % 900 + 1) || '-' || (p_size % 4) || '_Celle_' || p_size || '_DTM10UTM' || (32 + p_size % 3) || '_TIFF.zip' end as name from part)""")
def archive_names(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    text = lambda c: c.cast("string")
    usual = F.concat(F.lit("Basisdata_"), text(key % 900 + 1), F.lit("-"), text(size % 4), F.lit("_Celle_"), text(size), F.lit("_DTM10UTM"), text(size % 3 + 32), F.lit("_TIFF.zip"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("name", F.when(size % 5 == 0, F.concat(F.lit("Other_"), text(key), F.lit(".zip"))).otherwise(usual))
    part = part.withColumn("lod", size % 4).withColumn("row", key % 17)
    bounds = (F.col("p_retailprice"), size.cast("double"), size / F.lit(7.0), F.lit(0.0))
    return part.select("p_partkey", "p_size", "name", S.dtm_parts(F.col("name"))[0], S.dtm_inner_path(F.col("name")).alias("inner_path"), S.tile_path("lod", "p_partkey", "row").alias("path"), S.box_tag(*bounds).alias("tag"), S.box_text(*bounds).alias("box"))


_KINDS = {"house": 1, "residential": 1, "apartments": 1, "detached": 1, "terrace": 1, "semidetached_house": 1, "bungalow": 1, "cabin": 1, "hut": 1, "dormitory": 1, "houseboat": 1, "farm": 1, "static_caravan": 1, "commercial": 2, "retail": 2, "office": 2, "hotel": 2, "supermarket": 2, "kiosk": 2, "shop": 2, "industrial": 3, "warehouse": 3, "factory": 3, "hangar": 3, "manufacture": 3, "yes": 0, "church": 0}
_ROOFS = {"gabled": 1, "gambrel": 1, "saltbox": 1, "round": 1, "hipped": 2, "half-hipped": 2, "mansard": 2, "pyramidal": 3, "dome": 3, "onion": 3, "cone": 3, "conical": 3, "skillion": 4, "lean_to": 4, "mono_pitch": 4, "monopitch": 4, "flat": 0}


@query("select * from (values " + ", ".join(f"('{w}', {_KINDS.get(w, 0)}, {_ROOFS.get(w, 0)})" for w in (*_KINDS, *_ROOFS)) + ") t(word, kind, roof)")
def all_keywords(spark, sf_dir):
    words = spark.createDataFrame([(w,) for w in (*_KINDS, *_ROOFS)], "word string")
    return words.select("word", S.building_kind(F.col("word")).alias("kind"), S.roof_kind(F.col("word")).alias("roof"))


_FEATURES = """f as (select id, (['multipolygon', 'line', 'point'])[1 + id % 3] as kind, (['house', '', 'platform', 'rail', 'tram', 'platform_edge', 'switch', 'other'])[1 + id % 8] as v,
 '"name"=>"N' || id || '","building:levels"=>"' || (id % 7 - 1) || 'x","height"=>"' || (id % 9 - 1) || '.5m","gauge"=>"' || (id % 5 - 1) * 1435 || '","layer"=>"' || (id % 5 - 2) || '","service"=>"' || case when id % 2 = 0 then 'yard' else '' end || '"' as rest from places),
g as (select *, case when kind = 'multipolygon' and v = 'house' then 'buildings' when kind = 'multipolygon' and v in ('platform', 'platform_edge') then 'railway_platforms' when kind = 'line' and v in ('rail', 'tram') then 'railway_tracks' when kind = 'line' and v in ('platform', 'platform_edge') then 'railway_platforms' when kind = 'point' and v not in ('house', '') then 'railway_points' end as layer from f)"""


def _features(spark, sf_dir):
    i = F.col("id")
    pick = lambda words: F.get(F.array(*map(F.lit, words)), (i % len(words)).cast("int"))
    text = lambda c: c.cast("string")
    rows = relation(spark, sf_dir, "places").withColumn("kind", pick(["multipolygon", "line", "point"])).withColumn("v", pick(["house", "", "platform", "rail", "tram", "platform_edge", "switch", "other"]))
    key = F.when(F.col("v") == "house", "building").otherwise("railway")
    rest = F.concat(F.lit('"name"=>"N'), text(i), F.lit('","building:levels"=>"'), text(i % 7 - 1), F.lit('x","height"=>"'), text(i % 9 - 1), F.lit('.5m","gauge"=>"'), text((i % 5 - 1) * 1435), F.lit('","layer"=>"'), text(i % 5 - 2), F.lit('","service"=>"'), F.when(i % 2 == 0, "yard").otherwise(""), F.lit('"'))
    tags = F.concat(F.lit('"'), key, F.lit('"=>"'), F.col("v"), F.lit('",'), rest)
    return rows.select(i.alias("osm_id"), "kind", tags.alias("tags"), F.array(F.struct("x", "y")).alias("coords"))


@query(f"""with {_FEATURES} select layer, id as osm_id, 'N' || id as name, case when layer = 'buildings' and id % 7 > 1 then cast(id % 7 - 1 as int) end as levels, case when layer = 'buildings' and id % 9 > 0 then cast(id % 9 - 0.5 as double) end as height,
case when layer = 'railway_tracks' and id % 5 <> 1 then cast((id % 5 - 1) * 1435 as int) end as gauge, case when layer = 'railway_tracks' and id % 5 <> 2 then cast(id % 5 - 2 as int) end as layer_no, case when layer = 'railway_tracks' and id % 2 = 0 then 'yard' end as service from g where layer is not null""", "places")
def osm_layer_rows(spark, sf_dir):
    out = None
    none = {"name": "string", "levels": "int", "height": "double", "gauge": "int", "layer": "int", "service": "string"}
    for name, rows in formats.osm_layers(_features(spark, sf_dir)).items():
        own = [F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()]
        part = rows.select("osm_id", *own).withColumnRenamed("layer", "layer_no").withColumn("layer", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"with {_FEATURES}, c as (select layer, count(*) as n from g where layer is not null group by layer) select * from c union all select 'total', cast(sum(n) as bigint) from c", "places")
def osm_layer_counts(spark, sf_dir):
    layers = formats.osm_layers(_features(spark, sf_dir))
    every = None
    for name, rows in layers.items():
        part = rows.select(F.lit(name).alias("layer"))
        every = part if every is None else every.unionByName(part)
    return V.layer_counts(every)


@query("select c_custkey, coalesce(try_cast(nullif(regexp_extract(t, '^\\s*([+-]?(\\d+\\.?\\d*|\\.\\d+))', 1), '') as double), 0) as number, coalesce(try_cast(nullif(regexp_extract(t, '^\\s*([+-]?\\d{1,18})', 1), '') as int), 0) as whole from (select c_custkey, ' ' || c_acctbal || 'm' as t from customer)")
def leading_numbers(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.format_string(" %sm", F.col("c_acctbal").cast("decimal(18,2)")).alias("t"))
    return c.select("c_custkey", S.leading_float(F.col("t")).alias("number"), S.leading_int(F.col("t")).alias("whole"))


# --- geometry -------------------------------------------------------------------------------------


@query("select id, kind, part, n from (select id, 'LineString' as kind, 0 as part, 2 as n from places where id % 4 = 0 union all select id, 'MultiLineString', p.p, 2 + p.p from places, range(2) p(p) where id % 4 = 1)", "places")
def line_parts(spark, sf_dir):
    line = lambda n: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.struct((F.col("x") + k).alias("x"), F.col("y")))
    kind = F.get(F.array(*map(F.lit, ["LineString", "MultiLineString", "Point", "Polygon"])), (F.col("id") % 4).cast("int"))
    rows = relation(spark, sf_dir, "places").select("id", kind.alias("kind"), kind.alias("own_kind"), F.array(line(2), line(3), line(1)).alias("parts"))
    return K.line_parts(rows).select("id", F.col("own_kind").alias("kind"), "part", F.size("coords").alias("n"))


@query("select id, p.p as part, 4 + p.p as n, cast(p.p + id % 10 as double) as first_x from places, range(3) p(p) where p.p < id % 4", "places")
def exterior_rings(spark, sf_dir):
    ring = lambda n, at: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.struct((F.lit(at) + F.col("id") % 10 + k - 1).cast("double").alias("x"), k.cast("double").alias("y")))
    polygons = F.slice(F.array(*[F.array(ring(4 + k, k), ring(3, 50)) for k in range(3)]), F.lit(1), (F.col("id") % 4).cast("int"))
    rows = relation(spark, sf_dir, "places").select("id", polygons.alias("polygons"))
    return K.exterior(rows).select("id", "part", F.size("ring").alias("n"), F.get("ring", 0)["x"].alias("first_x"))


@query("select id, case when n > 3 then 3 end as size, case when n > 3 then 0.0::double end as first_x from (select id, 2 + id % 3 as n from places)", "places")
def open_rings(spark, sf_dir):
    # Rings whose last vertex repeats the first; of two or three vertices only one or two are left.
    vertex = lambda k, n: F.struct(F.when(k == n, 0.0).otherwise((k - 1).cast("double")).alias("x"), F.lit(0.0).alias("y"))
    n = (F.col("id") % 3 + 2).cast("int")
    rows = relation(spark, sf_dir, "places").withColumn("n", n).withColumn("c", F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: vertex(k, F.col("n"))))
    ring = K.ring("c")
    return rows.select("id", F.size(ring).alias("size"), F.get(ring, 0)["x"].alias("first_x")).select("id", F.when(F.col("size") > 0, F.col("size")).alias("size"), "first_x")


@query(f"""with v as (select seg_id, count(*) filter (z >= 2.0) as n, sum(case when z >= 2.0 then greatest(z + 0.6, 2.6) end) as total, sum(step) as len from (select *, coalesce(sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)), 0) as step from vertices window w as (partition by seg_id order by pos)) group by seg_id)
select seg_id, n, round(total, 4) as total from v where n >= 2 and len >= 5""", "vertices")
def siding_heights(spark, sf_dir):
    found = K.sidings(_lines(spark, sf_dir))
    return rounded(found.select("seg_id", F.size("coords").cast("long").alias("n"), F.aggregate("coords", F.lit(0.0), lambda a, p: a + p["z"]).alias("total")))


_MAIN = "main as (select id as main_id, k.k as k, x1 + k.k * (x2 - x1) / 24 as x, y1 + k.k * (y2 - y1) / 24 as y from rails, range(25) k(k) where k.k % 10 = 0 or k.k = 24)"


@query(f"""with {_MAIN}, b as (select id, 0 as at_end, x1 as x, y1 as y from roads union all select id, 1, x2, y2 from roads),
n as (select b.id, at_end, main_id, k, (b.x - m.x) * (b.x - m.x) + (b.y - m.y) * (b.y - m.y) as d2 from b join main m on (b.x - m.x) * (b.x - m.x) + (b.y - m.y) * (b.y - m.y) < 2500)
select id as seg_id, at_end, main_id, round(d2, 4) as d2 from (select *, row_number() over (partition by id, at_end order by d2, main_id, k) as r from n) where r = 1""", "rails", "roads")
def snap_connections(spark, sf_dir):
    along = lambda k: F.struct((F.col("x1") + k * (F.col("x2") - F.col("x1")) / 24).alias("x"), (F.col("y1") + k * (F.col("y2") - F.col("y1")) / 24).alias("y"))
    main = relation(spark, sf_dir, "rails").select(F.col("id").alias("seg_id"), F.transform(F.sequence(F.lit(0), F.lit(24)), along).alias("coords"))
    ends = F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))
    branch = relation(spark, sf_dir, "roads").select(F.col("id").alias("seg_id"), ends.alias("coords"))
    return rounded(K.snap_connections(branch, main))


@query("""with recursive l as (select id, id % 3 as name, (id * 8 % 400) / 10.0 as x, row_number() over (partition by id % 3 order by id) as rn from places),
k as (select name, rn, id, [x] as kept, true as stays from l where rn = 1 union all
 select l.name, l.rn, l.id, case when list_bool_or(list_transform(k.kept, lambda v: abs(v - l.x) < 1)) then k.kept else list_append(k.kept, l.x) end, not list_bool_or(list_transform(k.kept, lambda v: abs(v - l.x) < 1)) from k join l on l.name = k.name and l.rn = k.rn + 1)
select id as seg_id from k where stays""", "places")
def drop_repeated_lines(spark, sf_dir):
    # Ends 0.8 m apart: a dropped line drops no other.
    x = F.col("id") * 8 % 400 / 10.0
    lines = relation(spark, sf_dir, "places").select(F.col("id").alias("seg_id"), (F.col("id") % 3).cast("string").alias("name"), F.lit(" ").alias("medium"), F.array(*[F.struct((x + a).alias("x"), F.lit(0.0).alias("y")) for a in (0.0, 10.0)]).alias("coords"))
    return N.drop_repeated_lines(lines).select("seg_id")


@query(f"with {_TILES}, {_sample_sql('places', 's')} select places.id, round(elevation, 4) + 0.0 as elevation from places left join s using (id)", "cells", "places")
def raster_fall_through(spark, sf_dir):
    return rounded(R.sample_first(relation(spark, sf_dir, "places").select("id", "x", "y"), _rasters(spark, sf_dir), SIZE))


@query(f"with {_TILES}, v as (select p.id * 10 + k.k as id, p.x + k.k * 40.0 as x, p.y + k.k * 25.0 as y from places p, range(3) k(k)), {_sample_sql('v', 's')} select id // 10 as id, round(min(elevation), 4) + 0.0 as base from s group by id // 10", "cells", "places")
def footprint_base(spark, sf_dir):
    ring = F.array(*[F.struct((F.col("x") + k * 40.0).alias("x"), (F.col("y") + k * 25.0).alias("y")) for k in range(3)])
    rings = relation(spark, sf_dir, "places").select("id", ring.alias("ring"))
    return rounded(K.base_elevation(rings, _rasters(spark, sf_dir), SIZE).select("id", "base"))


@query("""with m as (select p.id, p.id % 5 as line, s.id as sid, (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) as d2, s.x / 100 as km, row_number() over (partition by p.id order by (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y), s.x / 100) as k from places p join stops s on s.id % 5 = p.id % 5)
select id, round(km, 4) as km, round(d2, 3) as d2 from m where k = 1""", "places", "stops")
def nearest_on_line(spark, sf_dir):
    points = relation(spark, sf_dir, "stops").select((F.col("id") % 5).alias("line_id"), (F.col("x") / 100).alias("km"), F.lit(1.0).alias("elevation"), F.lit(" ").alias("medium"), "x", "y")
    marks = relation(spark, sf_dir, "places").select(F.col("id").alias("mark"), (F.col("id") % 5).alias("line_id"), "x", "y")
    found = J.nearest_on_line(marks, points, 120.0)
    back = found.join(points.select("line_id", "km", F.col("x").alias("px"), F.col("y").alias("py")), ["line_id", "km"])
    d2 = (F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2
    return rounded(back.groupBy(F.col("mark").alias("id"), "km").agg(F.min(d2).alias("d2")).select("id", F.round("km", 4).alias("km"), F.round("d2", 3).alias("d2")))


@query("select id, round(lon, 6) as lon, round(lat, 6) as lat from (select id, 4 + x / 160 as lon, 57 + y / 300 as lat from places)", "places")
def projection_round_trip(spark, sf_dir):
    rows = relation(spark, sf_dir, "places").select("id", (4 + F.col("x") / 160).alias("lon"), (57 + F.col("y") / 300).alias("lat"))
    x, y = G.to_utm(F.col("lon"), F.col("lat"))
    there = rows.select("id", x.alias("x"), y.alias("y"))
    lon, lat = G.from_utm(F.col("x"), F.col("y"))
    return there.select("id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("select id, round(x, 4) as x, round(y, 4) as y, round((x - 1000.5) * 0.05 + (y - 2000.25) * 0.01, 4) + 0.0 as col from places", "places")
def affine_round_trip(spark, sf_dir):
    gt = F.array(*map(F.lit, [1000.5, 20.0, 4.0, 2000.25, 0.0, -20.0]))
    rows = relation(spark, sf_dir, "places").withColumn("gt", gt)
    col, row = R.affine_inverse(F.col("x"), F.col("y"))
    at = rows.withColumn("c", col).withColumn("r", row)
    x, y = R.affine(F.col("c"), F.col("r"))
    return rounded(at.select("id", x.alias("x"), y.alias("y"), F.col("c").alias("col")))


@query("select id, cast(round(3.141592653589793 * 2.25 + 3 * 20, 0) as double) as area, 34 as n from places where id <= 50", "places")
def buffer_areas(spark, sf_dir):
    rows = relation(spark, sf_dir, "places").where("id <= 50")
    turn = F.col("id") / 7.0
    ring = G.stadium(F.col("x"), F.col("y"), F.col("x") + 20 * F.cos(turn), F.col("y") + 20 * F.sin(turn), 1.5)
    after = F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1))
    # Taken about the first corner, so that great coordinates cost no digits.
    x, y = (lambda p: p["x"] - F.get("ring", 0)["x"]), (lambda p: p["y"] - F.get("ring", 0)["y"])
    twice = F.aggregate(F.zip_with("ring", after, lambda a, b: x(a) * y(b) - x(b) * y(a)), F.lit(0.0), lambda s, v: s + v)
    return rows.select("id", ring.alias("ring")).select("id", F.round(F.abs(twice) / 2, 0).alias("area"), F.size("ring").alias("n"))


# --- blocks -----------------------------------------------------------------------------------------


def _tile_cells(spark, sf_dir):
    return R.tiles(relation(spark, sf_dir, "cells"), 8, 8).select(F.lit(0).alias("lod"), F.col("tile_id").alias("col"), F.lit(0).cast("long").alias("row"), "cells")


@query("select tile_id as col, cast(idx as int) as idx, round(cast(cast(elevation as float) as double), 3) + 0.0 as elevation from cells", "cells")
def terrain_blocks(spark, sf_dir):
    read = formats.unpacked(formats.grids(_tile_cells(spark, sf_dir), "terrain"), "terrain")
    return read.select("col", "idx", (F.round(F.col("elevation").cast("double"), 3) + 0.0).alias("elevation"))


@query("select tile_id as col, cast(idx as int) as idx, cast((tile_id + idx) % 82 as int) as artype from cells", "cells")
def landcover_blocks(spark, sf_dir):
    cells = relation(spark, sf_dir, "cells").groupBy("tile_id").agg(F.transform(F.array_sort(F.collect_list("idx")), lambda i: ((F.col("tile_id") + i) % 82).cast("int")).alias("cells"))
    rows = cells.select(F.lit(0).alias("lod"), F.col("tile_id").alias("col"), F.lit(0).cast("long").alias("row"), "cells")
    return formats.unpacked(formats.grids(rows, "landcover"), "landcover").select("col", "idx", "artype")


_BOX_TILES = "t as (select id, c.i as col, r.i as row from (select id, least(x1, x2) as a, least(y1, y2) as b, greatest(x1, x2) as c, greatest(y1, y2) as d from {0}) q join range(-3, 8) c(i) on a < (c.i + 1) * 1024 and c > c.i * 1024 join range(-3, 8) r(i) on b < (r.i + 1) * 1024 and d > r.i * 1024)"
_ONE_LEVEL = [(0, 4.0, 0.0, 0.0)]


def _ends(z: str | None = None):
    struct = lambda n: F.struct(F.col(f"x{n}").alias("x"), F.col(f"y{n}").alias("y"), (F.col(f"z{n}") if z else F.lit(1.5)).alias("z"))
    return F.array(struct(1), struct(2)).alias("coords")


def _every_tile(spark):
    return spark.range(-10, 15).select(F.lit(0).alias("lod"), F.col("id").alias("col")).crossJoin(spark.range(-10, 15).select(F.col("id").alias("row")))


@query(f"with {_BOX_TILES.format('rails')} select t.col, t.row, id as track_id, cast(id % 3 as int) as type, medium, cast(id % 2 as int) as electrified, round(x1, 2) + 0.0 as x1, round(y2, 2) + 0.0 as y2, cast(id % 5 * 20 as int) as speed from rails join t using (id)", "rails")
def track_blocks(spark, sf_dir):
    i = F.col("id")
    tracks = relation(spark, sf_dir, "rails").select(i.alias("key"), (i % 3).cast("int").alias("type"), "medium", (i % 2).cast("int").alias("electrified"), F.array(F.lit(0), (i % 5 * 20).cast("int")).alias("speeds"), _ends())
    blocks = E.vector_blocks(tracks, "key", "tracks", _every_tile(spark), _ONE_LEVEL, 256)
    read = formats.unpacked(blocks, "tracks")
    return rounded(read.select("col", "row", "track_id", "type", "medium", "electrified", F.col("xyz")[0]["x"].cast("double").alias("x1"), F.col("xyz")[1]["y"].cast("double").alias("y2"), F.col("speeds")[1].alias("speed")), 2)


@query(f"with {_BOX_TILES.format('roads')} select t.col, t.row, case when id % 2 = 0 then 'E' else 'K' end as kategori, id as nummer, round(x1, 2) + 0.0 as x1, round(z2, 2) + 0.0 as z2 from roads join t using (id)", "roads")
def road_block_rows(spark, sf_dir):
    roads = relation(spark, sf_dir, "roads").select(F.col("id").alias("key"), F.when(F.col("id") % 2 == 0, "E").otherwise("K").alias("kategori"), F.col("id").alias("nummer"), _ends("z"))
    read = formats.unpacked(E.vector_blocks(roads, "key", "roads", _every_tile(spark), _ONE_LEVEL, 256), "roads")
    return rounded(read.select("col", "row", "kategori", "nummer", F.col("xyz")[0]["x"].cast("double").alias("x1"), F.col("xyz")[1]["z"].cast("double").alias("z2")), 2)


@query(f"with {_BOX_TILES.format('roads')} select t.col, t.row, cast(id % 4 as int) as kind, cast(id % 5 as int) as roof, round(z1, 2) + 0.0 as base, 6.0::double as height, round(x2, 2) + 0.0 as x2 from roads join t using (id)", "roads")
def building_blocks(spark, sf_dir):
    rows = relation(spark, sf_dir, "roads").select(F.col("id").alias("key"), (F.col("id") % 4).cast("int").alias("kind"), (F.col("id") % 5).cast("int").alias("roof"), F.col("z1").alias("base"), F.lit(6.0).alias("height"), _ends())
    read = formats.unpacked(E.vector_blocks(rows, "key", "buildings", _every_tile(spark), _ONE_LEVEL, 256), "buildings")
    return rounded(read.select("col", "row", "kind", "roof", F.col("base").cast("double").alias("base"), F.col("height").cast("double").alias("height"), F.col("xy")[1]["x"].cast("double").alias("x2")), 2)


@query(f"with {_BOX_TILES.format('rails')} select t.col, t.row, round(elevation, 2) + 0.0 as base, 0.5::double as height, round(y1, 2) + 0.0 as y1 from rails join t using (id)", "rails")
def platform_blocks(spark, sf_dir):
    rows = relation(spark, sf_dir, "rails").select(F.col("id").alias("key"), F.col("elevation").alias("base"), F.lit(0.5).alias("height"), _ends())
    read = formats.unpacked(E.vector_blocks(rows, "key", "platforms", _every_tile(spark), _ONE_LEVEL, 256), "platforms")
    return rounded(read.select("col", "row", F.col("base").cast("double").alias("base"), F.col("height").cast("double").alias("height"), F.col("xy")[0]["y"].cast("double").alias("y1")), 2)


@query(f"""with {_TILES}, px as (select (t.i * 8 + py.i) * 8 + px.i as id, t.i as col, py.i * 8 + px.i as idx, t.i * 400 + (px.i + 0.5) * 50 as x, 400 - (py.i + 0.5) * 50 as y from range(0, 9) t(i), range(8) py(i), range(8) px(i)), {_sample_sql('px', 's')}
select col, cast(idx as int) as idx, round(elevation, 4) + 0.0 as elevation from px left join s using (id)""", "cells")
def heightmap_samples(spark, sf_dir):
    # No passes of filling, so that each pixel is what is sampled at its centre.
    tiles = spark.range(9).select(F.lit(0).alias("lod"), F.col("id").alias("col"), F.lit(0).cast("long").alias("row"))
    placed = E.placed_tiles(tiles, [(0, 50.0, 0.0, 0.0)], 8)
    maps = E.heightmaps(E.in_order(placed), _rasters(spark, sf_dir), SIZE, 8, 0)
    return rounded(maps.select("col", F.posexplode("cells").alias("idx", "elevation")))


# --- whole profiles (a chain runs from the end that is farthest from its first node) --------------------------------------------------------------------------------

_SAMPLED = f"""seg as (select id as seg_id, id % 7 as line_id, 3.0 * (id // 7) as start, 3.0 * (id // 7) + case when id % 4 = 0 then 0 else 1.5 end as stop, case medium when 'T' then ' ' else medium end as medium, x1, y1, x2, y2, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) as len from rails),
d0 as (select *, greatest(2, cast(floor(len / 50) as int) + 1) as n from seg where len >= 1),
d1 as (select seg_id * 1000 + k.k as id, seg_id, line_id, medium, start + k.k / (n - 1) * case when stop > start then stop - start else len / 1000 end as km, x1 + k.k / (n - 1) * (x2 - x1) as x, y1 + k.k / (n - 1) * (y2 - y1) as y from d0, range(0, 200) k(k) where k.k < n),
{_TILES}, {_sample_sql('d1', 's')},
points as (select d1.line_id, d1.id as event_id, d1.km, s.elevation, d1.medium, 0 as speed, d1.x, d1.y from d1 left join s using (id))"""

_SMOOTH = f"""{_CLEAN}, {_GAUSS}, {_limit_sql("gauss", 0.025, True, "fw")}, {_limit_sql("fw", 0.025, False, "bw").replace("select *, row_number", "select line_id, event_id, km, medium, speed, elevation, row_number")}, {_GRADE.format("(select line_id, event_id, km, medium, elevation from bw)")},
sg as (select a.line_id, a.event_id, a.km, a.elevation, a.k, a.n, (select sum(exp(-0.5 * pow((b.km - a.km) / 0.42, 2)) * b.grade) / sum(exp(-0.5 * pow((b.km - a.km) / 0.42, 2))) from g1 b where b.line_id = a.line_id and b.km between a.km - 1.26 and a.km + 1.26) as grade from g1 a),
ed as (select line_id, min(km) as km0, max(km) as km1, arg_min(elevation, km) as e0, arg_max(elevation, km) as e1 from sg group by line_id),
st as (select a.line_id, a.event_id, a.km, a.n, a.elevation, coalesce(sum(a.grade * (a.km - b.km) * 1000) over (partition by a.line_id order by a.km), 0) as climb from sg a left join sg b on b.line_id = a.line_id and b.k = a.k - 1),
en as (select line_id, arg_max(climb, km) as climb1 from st group by line_id),
rb as (select st.line_id, st.event_id, case when n >= 3 then e0 + climb + (e1 - e0 - climb1) * (case when km1 > km0 then (km - km0) / (km1 - km0) else 0 end) else elevation end as elevation from st join ed using (line_id) join en using (line_id)),
sm as (select c.line_id, c.event_id, c.km, c.medium, case when t.n_points < 3 then c.elevation else coalesce(rb.elevation, bw.elevation) end as e from clean c join (select line_id, count(*) as n_points from clean group by line_id) t using (line_id) left join bw on bw.event_id = c.event_id left join rb on rb.event_id = c.event_id),
cl as (select line_id, event_id, km, medium, case when medium <> 'U' and e is not null then greatest(e, 2.6) else e end as elevation from sm),
s2 as (select *, row_number() over (partition by line_id order by km) as rn from cl),
tb as (select t.line_id, t.event_id, t.rn, (select max(o.rn) from s2 o where o.line_id = t.line_id and o.rn < t.rn and o.medium <> 'U') as p, (select min(o.rn) from s2 o where o.line_id = t.line_id and o.rn > t.rn and o.medium <> 'U') as q from s2 t where t.medium = 'U'),
done as (select s2.line_id, s2.event_id, s2.km, s2.medium, case when s2.medium <> 'U' then s2.elevation when a.elevation is not null and b.elevation is not null then a.elevation + (s2.km - a.km) / (b.km - a.km) * (b.elevation - a.elevation) else coalesce(a.elevation, b.elevation, s2.elevation) end as elevation
 from s2 left join tb on tb.event_id = s2.event_id left join s2 a on a.line_id = tb.line_id and a.rn = tb.p left join s2 b on b.line_id = tb.line_id and b.rn = tb.q)"""


def _rail_profile(spark, sf_dir, roads=None):
    i = F.col("id")
    start = F.floor(i / 7) * 3.0
    medium = F.when(F.col("medium") == "T", " ").otherwise(F.col("medium"))
    segments = relation(spark, sf_dir, "rails").select((i % 7).alias("line_id"), i.alias("seg_id"), start.alias("start"), (start + F.when(i % 4 == 0, 0.0).otherwise(1.5)).alias("end"), medium.alias("medium"), _ends())
    stations = relation(spark, sf_dir, "stations").select((F.col("line_id") % 7).alias("line_id"), "name", "km")
    return L.build_profile(segments, stations, _rasters(spark, sf_dir), SIZE, roads)


@query(f"with recursive {_SAMPLED}, {_SMOOTH} select line_id, event_id, round(km, 4) as km, medium, round(elevation, 4) + 0.0 as elevation from done", "rails", "cells")
def rail_profile(spark, sf_dir):
    points = _rail_profile(spark, sf_dir).points
    return rounded(points.select("line_id", (F.col("seg_id") * 1000 + F.col("sample")).alias("event_id"), "km", "medium", "elevation"))


@query(f"""with recursive {_SAMPLED}, {_SMOOTH}, m as (select s.line_id % 7 as line_id, s.name, round(s.km, 4) as km, d.elevation, row_number() over (partition by s.line_id % 7, s.name, s.km order by abs(d.km - s.km), d.km) as k from stations s join done d on d.line_id = s.line_id % 7)
select line_id, name, km, round(elevation, 4) + 0.0 as elevation from m where k = 1""", "rails", "cells", "stations")
def rail_profile_stations(spark, sf_dir):
    return rounded(_rail_profile(spark, sf_dir).stations.select("line_id", "name", "km", "elevation"))


@query(f"""with recursive {_SAMPLED}, {_SMOOTH}, d as (select *, km - lag(km) over w as dkm, elevation - lag(elevation) over w as de from done window w as (partition by line_id order by km))
select line_id, round(max(km) - min(km), 4) as length_km, round(coalesce(max(elevation), 0), 3) as max_elevation, round(coalesce(sum(de) filter (de > 0), 0), 3) as climb, cast(1 + count(*) filter (dkm > 0.5) as bigint) as n_segments, (select count(*) from stations s where s.line_id % 7 = d.line_id) as n_stations from d group by line_id""", "rails", "cells", "stations")
def rail_profile_stats(spark, sf_dir):
    stats = _rail_profile(spark, sf_dir).stats
    return stats.select("line_id", F.round("length_km", 4).alias("length_km"), F.round("max_elevation", 3).alias("max_elevation"), F.round("climb", 3).alias("climb"), "n_segments", "n_stations")


def _road_profile(spark, sf_dir):
    kategori = F.get(F.array(*map(F.lit, "ERFKP")), (F.col("id") % 5).cast("int")).alias("kategori")
    roads = relation(spark, sf_dir, "roads").select("id", kategori, F.col("id").cast("int").alias("nummer"), "x1", "y1", "z1", "x2", "y2", "z2")
    lines = relation(spark, sf_dir, "roads").select(kategori, F.col("id").cast("int").alias("nummer"), F.col("id").alias("seg_id"), _ends("z"))
    rails = relation(spark, sf_dir, "rails").select("id", F.concat(F.lit("L"), (F.col("id") % 7).cast("string")).alias("line"), "medium", "x1", "y1", "x2", "y2")
    return O.build_profile(lines, roads, rails, _rasters(spark, sf_dir), SIZE)


_ROADS = """r as (select *, (['E', 'R', 'F', 'K', 'P'])[1 + id % 5] as kat, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) as len from roads),
rp as (select id, kat || id as road, kat, case when len >= 10 then x2 else x1 end as x1, case when len >= 10 then y2 else y1 end as y1, case when len >= 10 then z2 else z1 end as z1, case when len >= 10 then x1 else x2 end as x2, case when len >= 10 then y1 else y2 end as y2, case when len >= 10 then z1 else z2 end as z2, len, greatest(2, cast(floor(len / case when kat in ('E', 'R', 'F') then 25 else 50 end) as int) + 1) as n from r where len >= 1),
pt as (select id, road, k.k as sample, len / 1000 * k.k / (n - 1) as km, z1 + k.k / (n - 1) * (z2 - z1) as elevation from rp, range(0, 40) k(k) where k.k < n)"""


@query(f"with {_ROADS} select road, sample, round(km, 4) as km, round(elevation, 4) + 0.0 as elevation from pt", "roads")
def road_profile(spark, sf_dir):
    return rounded(_road_profile(spark, sf_dir).points.select(F.col("line_id").alias("road"), "sample", "km", "elevation"))


_MET = f"""with {_ROADS}, {_TILES},
o as (select id, kat as o_kat, kat || id as o_road, false as rail, null::varchar as medium, x1, y1, z1, x2, y2, z2 from r union all select -id, null, 'L' || id % 7, true, medium, x1, y1, 0, x2, y2, 0 from rails),
x as (select a.*, o.id as oid, o.o_kat, o.o_road, o.rail, o.medium, o.z1 as oz1, o.z2 as oz2, (a.x2 - a.x1) * (o.y2 - o.y1) - (a.y2 - a.y1) * (o.x2 - o.x1) as den, (o.x1 - a.x1) * (o.y2 - o.y1) - (o.y1 - a.y1) * (o.x2 - o.x1) as na, (o.x1 - a.x1) * (a.y2 - a.y1) - (o.y1 - a.y1) * (a.x2 - a.x1) as nb
 from rp a join o on o.id <> a.id and (o.rail or o.o_kat in ('E', 'R', 'F') or (a.kat in ('K', 'P') and o.o_kat = 'K') or (a.kat = 'P' and o.o_kat = 'P')) and least(o.x1, o.x2) <= greatest(a.x1, a.x2) and greatest(o.x1, o.x2) >= least(a.x1, a.x2) and least(o.y1, o.y2) <= greatest(a.y1, a.y2) and greatest(o.y1, o.y2) >= least(a.y1, a.y2)),
h as (select row_number() over () as id, id as rid, road, o_road, rail, medium, na / den * len / 1000 as km, x1 + na / den * (x2 - x1) as x, y1 + na / den * (y2 - y1) as y, oz1 + nb / den * (oz2 - oz1) as oz from x where abs(den) >= 1e-12 and na / den between 0 and 1 and nb / den between 0 and 1),
e as (select h.*, pt.elevation, row_number() over (partition by h.id order by abs(pt.km - h.km), pt.km) as k from h join pt on pt.id = h.rid),
{_sample_sql('h', 'g')},
c as (select e.*, g.elevation as ground from e left join g on g.id = e.id where k = 1),
w as (select *, case when rail and medium in ('U', 'T') then 'Overpass' when rail and medium in ('L', 'B') then 'Underpass' when rail and ground is null then 'Level' when abs(elevation - case when rail then ground else oz end) < 5 then 'Level' when elevation > case when rail then ground else oz end then 'Overpass' else 'Underpass' end as kind from c),
m as (select road, o_road, rail, list(w order by km, x, y, elevation, kind) as hits from w group by road, o_road, rail)"""


@query(f"{_MET} select road, o_road as crossing, rail as is_railway, round(hits[1 + len(hits) // 2].km, 4) as km, hits[1 + len(hits) // 2].kind as kind from m", "roads", "rails", "cells")
def road_intersections(spark, sf_dir):
    # Roads are shorter than a cluster, so all hits of one road are one cluster.
    met = _road_profile(spark, sf_dir).stations
    return met.select("road", F.when(F.col("is_railway"), F.col("crossing")).otherwise(F.replace("crossing", F.lit("v"), F.lit(""))).alias("crossing"), "is_railway", F.round("km", 4).alias("km"), "kind")


@query(f"{_MET}, n as (select road, count(*) filter (rail) as n_rail_crossings, count(*) filter (not rail) as n_road_crossings from m group by road) select rp.road, 2 as n_vertices, coalesce(n_rail_crossings, 0) as n_rail_crossings, coalesce(n_road_crossings, 0) as n_road_crossings, round(len / 1000, 4) as length_km from rp left join n using (road)", "roads", "rails", "cells")
def road_profile_stats(spark, sf_dir):
    return rounded(_road_profile(spark, sf_dir).stats.select(F.col("line_id").alias("road"), "n_vertices", "n_rail_crossings", "n_road_crossings", "length_km"))


# --- tracks, views ---------------------------------------------------------------------------------


@query("""with t as (select id as seg_id, 0 as type, 'L' || id % 7 as line from rails union all select id, 1 + id % 2, '' from roads where id % 10 = 0) select row_number() over (order by type, seg_id) - 1 as track_id, seg_id, cast(type as int) as type, line from t""", "rails", "roads")
def all_tracks(spark, sf_dir):
    return K.all_tracks(*_tracks(spark, sf_dir)).select("track_id", "seg_id", "type", "line")


def _tracks(spark, sf_dir):
    main = relation(spark, sf_dir, "rails").select(F.col("id").alias("seg_id"), F.concat(F.lit("L"), (F.col("id") % 7).cast("string")).alias("line"), "medium", _ends())
    side = relation(spark, sf_dir, "roads").where("id % 10 = 0").select(F.col("id").alias("seg_id"), F.lit("").alias("line"), F.lit(" ").alias("medium"), _ends(), (F.col("id") % 2 + 1).cast("int").alias("type"))
    return main, side


@query("""with t as (select 0 as type, 'L' || id % 7 as line, x1, y1, x2, y2 from rails union all select 1, '', x1, y1, x2, y2 from roads where id % 10 = 0)
select cast(trunc(sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))) / 1000) as int) as total_km, count(*) filter (type = 0) as n_main, count(*) filter (type = 1) as n_siding, count(distinct line) filter (line <> '') as n_lines from t""", "rails", "roads")
def track_statistics(spark, sf_dir):
    main, side = _tracks(spark, sf_dir)
    return K.track_stats(main.withColumn("type", F.lit(0)).unionByName(side))


_OVER = "select '{0}' as layer, id from {1} where least(x1, x2) <= {4} and greatest(x1, x2) >= {2} and least(y1, y2) <= {5} and greatest(y1, y2) >= {3}"


def _layers(spark, sf_dir):
    return {"tracks": _boxes(spark, sf_dir, "rails"), "buildings": _boxes(spark, sf_dir, "roads"), "stations": relation(spark, sf_dir, "stops")}


@query(f"{_OVER.format('tracks', 'rails', 500, 500, 2500, 2000)} union all {_OVER.format('buildings', 'roads', 500, 500, 2500, 2000)} union all select 'stations', id from stops where x between 500 and 2500 and y between 500 and 2000", "rails", "roads", "stops")
def map_overlay(spark, sf_dir):
    return V.overlay(_layers(spark, sf_dir), (500.0, 500.0, 2500.0, 2000.0))


@query(f"{_OVER.format('tracks', 'rails', -1000, -500, 3000, 3500)} union all select 'stations', id from stops where x between -1000 and 3000 and y between -500 and 3500", "rails", "stops")
def local_map(spark, sf_dir):
    return V.local_map(_layers(spark, sf_dir), 1000.0, 1500.0)


@query("select id from rails where least(x1, x2) <= 2600 and greatest(x1, x2) >= 400 and least(y1, y2) <= 2100 and greatest(y1, y2) >= 400", "rails")
def padded_rectangle(spark, sf_dir):
    return _boxes(spark, sf_dir, "rails").where(K.near((500.0, 500.0, 2500.0, 2000.0), 100.0)).select("id")


@query(f"""with {_TILES}, px as (select r.i * 40 + c.i as id, 0 + (c.i + 0.5) * 50 as x, 2000 - (r.i + 0.5) * 50 as y from range(40) r(i), range(40) c(i)), {_sample_sql('px', 's')} select id // 40 as row, id % 40 as col, round(elevation, 4) + 0.0 as elevation from px left join s using (id)""", "cells")
def local_crop(spark, sf_dir):
    return rounded(V.crop(spark, 1000.0, 1000.0, _rasters(spark, sf_dir), SIZE, 1000.0, 50))


@query("""select id, cast(trunc((x - 2000 + 2000) / 2) as int) as px, cast(trunc((1500 + 2000 - y) / 2) as int) as py, round(2000 - 2000 + trunc((x - 2000 + 2000) / 2) * 2, 3) as back_x, round(sqrt((x - 2000) * (x - 2000) + (y - 1500) * (y - 1500)), 4) as distance,
cast(70 + trunc(x / 4001 * 900) as int) as diagram_x, cast(20 + trunc((1 - y / 4003) * 450) as int) as diagram_y, round(4001.0 * (70 + trunc(x / 4001 * 900) - 70) / 900, 4) as back_km from places""", "places")
def map_coordinates(spark, sf_dir):
    cx, cy, x, y = F.lit(2000.0), F.lit(1500.0), F.col("x"), F.col("y")
    px, py = V.to_pixel(x, y, cx, cy)
    rows = relation(spark, sf_dir, "places").withColumn("px", px).withColumn("py", py).withColumn("diagram_x", V.diagram_x(x, F.lit(0.0), F.lit(4001.0), 1000)).withColumn("diagram_y", V.diagram_y(y, F.lit(0.0), F.lit(4003.0)))
    back_x, _ = V.to_place(F.col("px"), F.col("py"), cx, cy)
    return rounded(rows.select("id", "px", "py", F.round(back_x, 3).alias("back_x"), V.from_centre(x, y, cx, cy).alias("distance"), "diagram_x", "diagram_y", V.diagram_km(F.col("diagram_x"), F.lit(0.0), F.lit(4001.0), 1000).alias("back_km")))


@query("select min(least(x1, x2)) as min_x, min(least(y1, y2)) as min_y, max(greatest(x1, x2)) as max_x, max(greatest(y1, y2)) as max_y, 0.0::double as none from rails", "rails")
def bounds_union(spark, sf_dir):
    none = V.bounds_of(_boxes(spark, sf_dir, "rails").limit(0)).select((F.col("min_x") + F.col("max_y")).alias("none"))
    return V.bounds_of(_boxes(spark, sf_dir, "rails")).join(F.broadcast(none))


@query("select id % 7 as line_id, min(x) - 100 as min_x, min(y) - 100 as min_y, max(x) + 100 as max_x, max(y) + 100 as max_y from stops group by 1", "stops")
def profile_bounds(spark, sf_dir):
    return V.profile_bounds(relation(spark, sf_dir, "stops").withColumn("line_id", F.col("id") % 7), 100.0)


@query("""select tile_id, round(elevation, 3) + 0.0 as elevation, cast(artype as int) as artype, case artype when 10 then 'Built-up' when 30 then 'Forest' end as cover_name from (select tile_id, max(case when idx = 8 * (tile_id % 8) + tile_id % 9 then elevation end) filter (tile_id % 9 < 8) as elevation, case when tile_id % 9 < 8 then ([10, 30])[1 + (8 * (tile_id % 8) + tile_id % 9) % 2] end as artype from cells group by tile_id)""", "cells")
def pixel_facts(spark, sf_dir):
    cover = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(i % 2 == 0, 10).otherwise(30))
    rasters = R.tiles(relation(spark, sf_dir, "cells"), 8, 8).withColumn("cover", cover).withColumn("gt", F.array(*map(F.lit, [500000.0, 10.0, 0.0, 7000000.0, 0.0, -10.0])))
    # Column 8 is outside.
    pixels = rasters.select("tile_id", (F.col("tile_id") % 9).cast("int").alias("col"), (F.col("tile_id") % 8).cast("int").alias("row"))
    return V.pixel_facts(rasters, pixels).select("tile_id", F.round("elevation", 3).alias("elevation"), "artype", "cover_name")


@query("""select id, printf('%.1f', x / 100 + 0.001) as km_text, printf('%.0f m', cast(y as double)) as elevation_text, (['Switch', 'Double switch', 'Diamond crossing', 'Track overpass', 'Track underpass', 'Road level crossing', 'Road overpass', 'Road underpass'])[1 + id % 8] || case when id % 3 > 0 then ' (' || id % 3 || ')' else '' end as type from places""", "places")
def junction_listing(spark, sf_dir):
    kinds = F.array(*map(F.lit, ["Switch", "DoubleSwitch", "Diamond", "Overpass", "Underpass", "RoadLevel", "RoadOverpass", "RoadUnderpass"]))
    rows = relation(spark, sf_dir, "places").select(F.col("id").alias("line_id"), (F.col("x") / 100 + 0.001).alias("km"), F.col("y").alias("elevation"), F.get(kinds, (F.col("id") % 8).cast("int")).alias("kind"), (F.col("id") % 3).cast("int").alias("n_switches"), F.lit("").alias("description"))
    return V.junction_listing(rows).select(F.col("line_id").alias("id"), "km_text", "elevation_text", "type")


@query("select id % 11 as road, count(*) filter (id % 4 = 0) as n_railways, count(*) filter (id % 4 <> 0) as n_roads, count(*) as n_all from places group by 1", "places")
def crossing_counts(spark, sf_dir):
    return V.crossing_counts(relation(spark, sf_dir, "places").select((F.col("id") % 11).alias("road"), (F.col("id") % 4 == 0).alias("is_railway")))


@query("select count(distinct id % 5) as n_archives, count(*) as n_entries, count(*) filter (id % 3 = 0) as n_rasters from places", "places")
def archive_totals(spark, sf_dir):
    return V.archive_totals(relation(spark, sf_dir, "places").select((F.col("id") % 5).alias("zip"), F.when(F.col("id") % 3 == 0, "x").otherwise("").alias("inner_path")))


@query("""with e as (select id, case when x > y then x else y end as m from places) select id, medium, others, case when medium in ('U', 'T', 'L', 'B') then others like '% %' when medium = ' ' then others similar to '.*[UTLB].*' else false end as apart from (select id, ([' ', 'U', 'T', 'L', 'B'])[1 + id % 5] as medium, ([' ', 'U', 'UL', ' B', 'TT'])[1 + id % 7 % 5] as others from e)""", "places")
def grade_separation(spark, sf_dir):
    pick = lambda words, i: F.get(F.array(*map(F.lit, words)), i.cast("int"))
    rows = relation(spark, sf_dir, "places").select("id", pick([" ", "U", "T", "L", "B"], F.col("id") % 5).alias("medium"), pick([" ", "U", "UL", " B", "TT"], F.col("id") % 7 % 5).alias("others"))
    return rows.select("id", "medium", "others", K.own_medium_separated(F.col("medium"), F.filter(F.split("others", ""), lambda c: c != "")).alias("apart"))


@query("select id, min_x as e, 33 as zone from (select id, 500000 + x as min_x from places)", "places")
def raster_bounds(spark, sf_dir):
    rows = relation(spark, sf_dir, "places").select("id", F.lit(10).alias("width"), F.lit(10).alias("height"), F.array(500000 + F.col("x"), F.lit(10.0), F.lit(0.0), 7000000 + F.col("y"), F.lit(0.0), F.lit(-10.0)).alias("gt"), F.lit(25833).alias("epsg"))
    found = catalog.with_bounds(rows.withColumnRenamed("id", "place"))
    return found.select(F.col("place").alias("id"), F.col("min_x").alias("e"), catalog.zone_of(F.col("epsg")).alias("zone"))
