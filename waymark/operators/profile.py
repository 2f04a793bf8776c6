"""Elevation profiles along lines: cleaning, smoothing, tunnels, statistics, speeds.

A profile is rows (line, km, elevation, medium, ...), null elevation meaning no
data.  All operators work on all lines at once, as windows over one line in the
order of km, so one hash partitioning by line serves a whole chain of them.
Points of equal km, as where segments meet, go by those of ``TIES`` that there are.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Fixed values of the profile rules: metres, kilometres and shares.
MIN_PLAUSIBLE, BED_OFFSET, FLOOR = 2.0, 0.6, 2.6
SIGMA_KM, MAX_GRADE, GRADE_SIGMA_KM = 0.21, 0.025, 0.42
GAP_KM, MOST_UNKNOWN = 0.5, 5
#: Columns that order points of equal km.
TIES = ("seg_id", "sample", "event_id")


def elevation() -> Column:
    return F.col("elevation")


def medium() -> Column:
    return F.col("medium")


def surface() -> Column:
    return medium() != "U"


def by_km(points: DataFrame, forward: bool = True):
    """A line's points in order, or in the reverse of that order."""
    order = ["km", *[c for c in TIES if c in points.columns]]
    return W.partitionBy("line_id").orderBy(*[F.asc(c) if forward else F.desc(c) for c in order])


def _known(points: DataFrame, value: Column, forward: bool) -> Column:
    """The last value that is not null up to each point; each frame grows from its start, so a line costs one pass."""
    return F.last(value, ignorenulls=True).over(by_km(points, forward).rowsBetween(W.unboundedPreceding, 0))


def whole_line():
    return W.partitionBy("line_id")


def drop_failed(points: DataFrame) -> DataFrame:
    """Drop points without data outside tunnels."""
    return points.where(elevation().isNotNull() | (medium() == "U"))


def null_implausible(points: DataFrame) -> DataFrame:
    return points.withColumn("elevation", F.when(~(surface() & (elevation() < MIN_PLAUSIBLE)), elevation()))


def add_bed(points: DataFrame) -> DataFrame:
    return points.withColumn("elevation", F.when(surface(), elevation() + BED_OFFSET).otherwise(elevation()))


def clamp(points: DataFrame) -> DataFrame:
    return points.withColumn("elevation", F.when(surface() & elevation().isNotNull(), F.greatest(elevation(), F.lit(FLOOR))).otherwise(elevation()))


def clean(points: DataFrame) -> DataFrame:
    return add_bed(null_implausible(drop_failed(points)))


def _gaussian(points: DataFrame, value: str, included: Column, sigma: float) -> DataFrame:
    """``points`` with the weighted mean of ``value`` over included rows within three sigma; excluded rows keep theirs."""
    held = F.when(included, F.struct(F.col("km").alias("k"), F.col(value).alias("v")))
    # A frame of doubles can only be written in SQL.
    frame = f"collect_list(held) over (partition by line_id order by km range between {3 * sigma}D preceding and {3 * sigma}D following)"
    near = points.withColumn("held", held).withColumn("near", F.expr(frame))
    weight = lambda p: F.exp(-0.5 * F.pow((p["k"] - F.col("km")) / sigma, 2))
    total = F.aggregate("near", F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w")), lambda a, p: F.struct((a["s"] + weight(p) * p["v"]).alias("s"), (a["w"] + weight(p)).alias("w")))
    mean = near.withColumn("total", F.when(F.col("held").isNotNull(), total))
    return mean.withColumn(value, F.when(F.col("held").isNotNull(), F.col("total.s") / F.col("total.w")).otherwise(F.col(value))).drop("held", "near", "total")


def smooth_elevation(points: DataFrame, sigma: float = SIGMA_KM) -> DataFrame:
    return _gaussian(points, "elevation", surface() & elevation().isNotNull(), sigma)


def limit_grade(points: DataFrame, grade: float = MAX_GRADE, forward: bool = True) -> DataFrame:
    """Lower surface points to what the grade allows from the point before (or after).

    The rule e_i = min(e_i, e_(i-1) + G dkm) is a running minimum of e - G km
    within islands that begin where the rule doesn't apply, or cannot lower the
    point: where even the least elevation of the island so far allows it. km
    count from an island's start and points that the rule leaves keep their
    very elevations, since what is lost in e - G km at great km comes back
    many times over where grades are carried across a gap.
    """
    sign = 1 if forward else -1
    order = by_km(points, forward)
    slope = grade * 1000
    step = sign * (F.col("km") - F.lag("km").over(order))
    starts = F.lag("km").over(order).isNull() | ~surface() | elevation().isNull() | F.lag("elevation").over(order).isNull() | (step <= 0)
    number = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0)).over(order)
    parts = points.withColumns({"starts": starts, "step": step}).withColumn("part", number("starts"))
    way = F.asc("km") if forward else F.desc("km")
    so_far = lambda *keys: W.partitionBy("line_id", *keys).orderBy(way)
    least = F.min(elevation()).over(so_far("part").rowsBetween(W.unboundedPreceding, -1))
    islands = parts.withColumn("starts", F.col("starts") | F.coalesce(elevation() <= least + slope * F.col("step"), F.lit(False))).withColumn("island", number("starts"))
    within = so_far("island").rowsBetween(W.unboundedPreceding, 0)
    placed = islands.withColumn("rise", slope * sign * (F.col("km") - F.first("km").over(within)))
    own = elevation() - F.col("rise")
    lowest = placed.withColumn("lowest", F.min(own).over(within))
    limited = F.when(F.col("starts") | (own <= F.col("lowest")), elevation()).otherwise(F.col("lowest") + F.col("rise"))
    return lowest.withColumn("elevation", limited).select(*points.columns)


def _used(points: DataFrame) -> DataFrame:
    return points.where(surface() & elevation().isNotNull())


def grades(points: DataFrame) -> DataFrame:
    """The surface points with data, with ``grade`` from the one before; the first has the second's."""
    order = by_km(points)
    step = (F.col("km") - F.lag("km").over(order)) * 1000
    own = F.when(step > 0, (elevation() - F.lag("elevation").over(order)) / step).when(step.isNotNull(), 0.0)
    return _used(points).withColumn("g", own).withColumn("grade", F.coalesce("g", F.lead("g").over(order), F.lit(0.0))).drop("g")


def rebuild(points: DataFrame, sigma: float = GRADE_SIGMA_KM) -> DataFrame:
    """Smooth the grades of surface points, add them up from the first point, and spread the drift at the last evenly.

    Lines of under three such points keep their elevations, as do all other points.
    """
    smooth, order = _gaussian(grades(points), "grade", F.lit(True), sigma), by_km(points)
    climb = F.coalesce(F.col("grade") * (F.col("km") - F.lag("km").over(order)) * 1000, F.lit(0.0))
    smooth = smooth.withColumn("climb", climb)
    line = whole_line()
    start = F.first("elevation").over(order)
    smooth = smooth.withColumn("made", start + F.sum("climb").over(order.rowsBetween(W.unboundedPreceding, 0)))
    to_end = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    drift = F.last("elevation").over(to_end) - F.last("made").over(to_end)
    span = F.max("km").over(line) - F.min("km").over(line)
    share = F.when(span > 0, (F.col("km") - F.min("km").over(line)) / span).otherwise(0.0)
    made = F.when(F.count("*").over(line) >= 3, F.col("made") + drift * share).otherwise(elevation())
    rest = points.where(~(surface() & elevation().isNotNull()) | medium().isNull())
    return smooth.withColumn("elevation", made).select(*points.columns).unionByName(rest)


def smooth(points: DataFrame, sigma: float = SIGMA_KM, grade: float = MAX_GRADE, grade_sigma: float = GRADE_SIGMA_KM) -> DataFrame:
    """The whole smoothing; lines of under three points stay as they are."""
    counted = points.withColumn("n_points", F.count("*").over(whole_line()))
    done = smooth_elevation(counted.where("n_points >= 3"), sigma)
    done = rebuild(limit_grade(limit_grade(done, grade), grade, forward=False), grade_sigma)
    return done.unionByName(counted.where("n_points < 3")).drop("n_points")


def fill_tunnels(points: DataFrame) -> DataFrame:
    """Give each run of tunnel points the line between its neighbours, marked ``interpolated``.

    A neighbour without data counts as absent: with one, its elevation is
    taken; with none the points keep theirs.
    """
    other = F.when(surface(), F.struct("km", "elevation"))
    p = points.withColumn("b", _known(points, other, True)).withColumn("a", _known(points, other, False))
    e0, e1, k0, k1 = F.col("b.elevation"), F.col("a.elevation"), F.col("b.km"), F.col("a.km")
    share = F.when(k1 > k0, (F.col("km") - k0) / (k1 - k0)).otherwise(0.5)
    filled = F.when(e0.isNotNull() & e1.isNotNull(), e0 + share * (e1 - e0)).otherwise(F.coalesce(e0, e1))
    tunnel = medium() == "U"
    return p.withColumn("interpolated", F.coalesce(tunnel & filled.isNotNull(), F.lit(False))).withColumn("elevation", F.when(tunnel, F.coalesce(filled, elevation())).otherwise(elevation())).drop("a", "b")


def line_stats(points: DataFrame) -> DataFrame:
    """Length, extent, climb, descent, steepest grade, tunnel and bridge length and parts of each line."""
    order = by_km(points)
    dkm, de = F.col("km") - F.lag("km").over(order), elevation() - F.lag("elevation").over(order)
    p = points.withColumn("dkm", dkm).withColumn("de", de)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    sound = elevation().isNotNull()
    return p.groupBy("line_id").agg(
        (F.max("km") - F.min("km")).alias("length_km"),
        F.coalesce(F.min("elevation"), F.lit(0.0)).alias("min_elevation"),
        F.coalesce(F.max("elevation"), F.lit(0.0)).alias("max_elevation"),
        total(F.when(F.col("de") > 0, F.col("de"))).alias("climb"),
        total(F.when(F.col("de") < 0, -F.col("de"))).alias("descent"),
        F.coalesce(F.max(F.when(F.col("dkm") > 0, F.abs(F.col("de") / (F.col("dkm") * 1000)) * 100)), F.lit(0.0)).alias("max_grade"),
        total(F.when((medium() == "U") & sound, F.col("dkm"))).alias("tunnel_km"),
        total(F.when(medium().isin("L", "B") & sound, F.col("dkm"))).alias("bridge_km"),
        (F.count_if(F.col("dkm") > GAP_KM) + 1).alias("n_segments"),
    )


def _runs(points: DataFrame, value: str, out: str) -> DataFrame:
    """``points`` with ``out``, the number of the run of equal ``value`` along the line."""
    order = by_km(points)
    changes = F.when(F.col(value).eqNullSafe(F.lag(value).over(order)) & F.lag("km").over(order).isNotNull(), 0).otherwise(1)
    return points.withColumn("change", changes).withColumn(out, F.sum("change").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("change")


def fill_speed_gaps(points: DataFrame, most: int = MOST_UNKNOWN) -> DataFrame:
    """Runs of at most ``most`` unknown speeds (0) between equal known ones take that speed."""
    known = F.when(F.col("speed") != 0, F.col("speed"))
    p = _runs(points.withColumn("is_known", F.col("speed") != 0), "is_known", "run").withColumn("b", _known(points, known, True)).withColumn("a", _known(points, known, False))
    n = F.count("*").over(W.partitionBy("line_id", "run"))
    return p.withColumn("speed", F.when((F.col("speed") == 0) & (n <= most) & (F.col("a") == F.col("b")), F.col("b")).otherwise(F.col("speed"))).drop("a", "b", "run", "is_known")


def speed_sections(points: DataFrame) -> DataFrame:
    """Runs of at least two points of one known speed, after short gaps are filled: ends and middle point."""
    p = _runs(fill_speed_gaps(points), "speed", "run")
    found = p.where("speed <> 0").groupBy("line_id", "run", "speed").agg(F.count("*").alias("n_points"), F.array_sort(F.collect_list("km")).alias("kms")).where("n_points >= 2")
    middle = F.element_at("kms", (F.floor((F.col("n_points") - 1) / 2) + 1).cast("int"))
    return found.select("line_id", "speed", F.col("kms")[0].alias("start_km"), F.element_at("kms", -1).alias("end_km"), middle.alias("middle_km"), "n_points")


def medium_segments(points: DataFrame) -> DataFrame:
    """A row per run of one medium."""
    return _runs(points, "medium", "segment").groupBy("line_id", "segment", "medium").agg(F.min("km").alias("start_km"), F.max("km").alias("end_km"), F.count("*").alias("n_points"))


def nearest_along(marks: DataFrame, points: DataFrame, most_km: float | None = None, carried: tuple[str, ...] = ("name",)) -> DataFrame:
    """``marks`` (line_id, km and the ``carried`` columns) with the elevation of the nearest point of their line; the first in km on ties.

    Both sides are merged along the line and looked up by two windows, so no
    mark meets more than its two neighbours.
    """
    own = marks.select("line_id", "km", F.lit(None).cast("struct<km:double,elevation:double>").alias("p"), F.struct(*carried).alias("m"))
    both = points.select("line_id", "km", F.struct("km", "elevation").alias("p"), F.lit(None).cast(own.schema["m"].dataType).alias("m")).unionByName(own)
    # Ranges, so that a point at a mark's own km is found whichever comes first; the reverse order looks ahead.
    nearest = lambda way: F.last("p", ignorenulls=True).over(W.partitionBy("line_id").orderBy(way("km")).rangeBetween(W.unboundedPreceding, 0))
    before, after = nearest(F.asc), nearest(F.desc)
    m = both.withColumn("b", before).withColumn("a", after).where("p is null")
    to_b, to_a = F.col("km") - F.col("b.km"), F.col("a.km") - F.col("km")
    pick = F.when(to_a.isNull() | (to_b <= to_a), F.col("b")).otherwise(F.col("a"))
    found = m.withColumn("near", pick).where("near is not null")
    if most_km is not None:
        found = found.where(F.abs(F.col("near.km") - F.col("km")) < most_km)
    return found.select("line_id", *[F.col("m")[c].alias(c) for c in carried], "km", F.col("near.km").alias("point_km"), F.col("near.elevation").alias("elevation"))


def cluster_rows(hits: DataFrame, keys: list[str], width: float, at: str = "km", tied: str | None = None) -> DataFrame:
    """The middle row of each cluster of a key's rows less than ``width`` from the cluster's first, with first_km and n_hits.

    Rows go by ``at`` and then by their other columns. A key's rows, the
    crossings of two lines, are one array. With ``tied``, their last column,
    two more: ``ties``, its values where all other columns are the middle
    row's, and ``place``, which of them in order is the middle one.
    """
    rest = [c for c in hits.columns if c not in (*keys, at)]
    every = F.array_sort(F.collect_list(F.struct(at, *rest)))
    grouped = hits.groupBy(*keys).agg(every.alias("hits"))
    anchors = F.aggregate("hits", F.array().cast("array<double>"), lambda a, x: F.when((F.size(a) == 0) | (x[at] - F.element_at(F.concat(F.array(F.lit(0.0)), a), -1) >= width), F.concat(a, F.array(x[at]))).otherwise(a))
    clusters = grouped.withColumn("anchors", anchors).select(*keys, "hits", "anchors", F.posexplode("anchors").alias("i", "anchor"))
    end = F.coalesce(F.get("anchors", F.col("i") + 1), F.lit(float("inf")))
    members = F.filter("hits", lambda x: (x[at] >= F.col("anchor")) & (x[at] < end))
    found = clusters.withColumn("m", members)
    middle = F.floor(F.size("m") / 2).cast("int")
    found = found.select(*keys, F.col("anchor").alias("first_km"), F.size("m").cast("long").alias("n_hits"), F.get("m", middle).alias("hit"), "m")
    if tied is None:
        return found.select(*keys, "first_km", "n_hits", "hit.*")
    place_of = lambda x: F.struct(*[x[c] for c in (at, *rest) if c != tied])
    before = F.size(F.filter("m", lambda x: place_of(x) < place_of(F.col("hit"))))
    ties = F.transform(F.filter("m", lambda x: place_of(x).eqNullSafe(place_of(F.col("hit")))), lambda x: x[tied])
    return found.select(*keys, "first_km", "n_hits", "hit.*", ties.alias("ties"), (middle - before).alias("place"))


def cluster_middles(hits: DataFrame, width: float, key: str = "line_id", at: str = "km") -> DataFrame:
    """The middle hit of each cluster of hits less than ``width`` from the cluster's first."""
    found = cluster_rows(hits.select(key, F.col(at).alias("middle_km")), [key], width, "middle_km")
    return found.select(key, "first_km", "n_hits", "middle_km")


def diagram_extent(points: DataFrame) -> DataFrame:
    """Elevation limits of a line's diagram: a tenth or 20 m of room, not under 0, on multiples of 50."""
    low, high = F.min("elevation"), F.max("elevation")
    found = points.groupBy("line_id").agg(low.alias("low"), high.alias("high")).where("low is not null")
    pad = F.greatest((F.col("high") - F.col("low")) * 0.1, F.lit(20.0))
    return found.select("line_id", (F.floor(F.greatest(F.col("low") - pad, F.lit(0.0)) / 50) * 50).cast("long").alias("from_m"), (F.ceil((F.col("high") + pad) / 50) * 50).cast("long").alias("to_m"))


def road_stats(points: DataFrame) -> DataFrame:
    """As :func:`line_stats`, without tunnels, bridges and gaps."""
    return line_stats(points).select("line_id", "length_km", "min_elevation", "max_elevation", "climb", "descent", "max_grade")


def first_of_ranges(rows: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Keep rows (line_id, seg, start, end) that repeat no kept one, in the order of start and seg, within the tolerance."""

    def keep(pdf):
        pdf = pdf.sort_values(["start", "end", "seg"])
        kept, out = [], []
        for k, (a, b) in enumerate(zip(pdf["start"], pdf["end"], strict=True)):
            while kept and a - kept[0][0] >= tolerance:
                kept.pop(0)
            if not any(abs(a - x) < tolerance and abs(b - y) < tolerance for x, y in kept):
                kept.append((a, b))
                out.append(k)
        return pdf.iloc[out]

    return rows.groupBy("line_id").applyInPandas(keep, rows.schema)
