"""Transverse Mercator (Krueger series in the third flattening) as column arithmetic, and buffers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# GRS80, UTM scale and false easting.
AXIS, FLATTENING, SCALE, EASTING = 6378137.0, 1 / 298.257222101, 0.9996, 500000.0
N = FLATTENING / (2 - FLATTENING)
RADIUS = AXIS / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ECC = math.sqrt(FLATTENING * (2 - FLATTENING))
FORWARD = [N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440, 61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280]
INVERSE = [N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440, 17 * N**3 / 480 - 37 * N**4 / 840, 4397 * N**4 / 161280]
# From the conformal to the geodetic latitude.
LATITUDE = [2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45, 7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45, 56 * N**3 / 15 - 136 * N**4 / 35, 4279 * N**4 / 630]


def central_meridian(zone: int) -> float:
    return zone * 6.0 - 183.0


def _sum(terms: list[Column]) -> Column:
    out = F.lit(0.0)
    for t in terms:
        out = out + t
    return out


def to_utm(lon: Column, lat: Column, zone: int = 33) -> tuple[Column, Column]:
    """Easting and northing (northern half) of degrees."""
    phi, lam = F.radians(lat), F.radians(lon - central_meridian(zone))
    t = F.sinh(F.atanh(F.sin(phi)) - ECC * F.atanh(ECC * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    x = eta + _sum([a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(FORWARD, 1)])
    y = xi + _sum([a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(FORWARD, 1)])
    return EASTING + SCALE * RADIUS * x, SCALE * RADIUS * y


def from_utm(x: Column, y: Column, zone: int = 33) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    xi, eta = y / (SCALE * RADIUS), (x - EASTING) / (SCALE * RADIUS)
    xi0 = xi - _sum([b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(INVERSE, 1)])
    eta0 = eta - _sum([b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(INVERSE, 1)])
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))
    phi = chi + _sum([d * F.sin(2 * j * chi) for j, d in enumerate(LATITUDE, 1)])
    return F.degrees(F.atan2(F.sinh(eta0), F.cos(xi0))) + central_meridian(zone), F.degrees(phi)


def stadium(x1: Column, y1: Column, x2: Column, y2: Column, radius: float, per_quadrant: int = 8) -> Column:
    """The ring about a segment at ``radius``, round at both ends."""
    turn = F.atan2(y2 - y1, x2 - x1)
    steps = range(-per_quadrant, per_quadrant + 1)
    corner = lambda x, y, k, half: F.struct((x + radius * F.cos(turn + half + k * math.pi / 2 / per_quadrant)).alias("x"), (y + radius * F.sin(turn + half + k * math.pi / 2 / per_quadrant)).alias("y"))
    return F.array(*[corner(x2, y2, k, 0.0) for k in steps], *[corner(x1, y1, k, math.pi) for k in steps])


def buffer_ring(coords: list[tuple[float, float]], radius: float, per_quadrant: int = 8) -> list[tuple[float, float]]:
    """The ring about a polyline at ``radius``: round at both ends and where it turns outward; equal neighbours count once."""
    line = [p for k, p in enumerate(coords) if k == 0 or p != coords[k - 1]]
    if len(line) < 2:
        return []

    def arc(centre: tuple[float, float], start: float, turn: float) -> list[tuple[float, float]]:
        n = max(1, math.ceil(abs(turn) / (math.pi / 2 / per_quadrant) - 1e-9))
        return [(centre[0] + radius * math.cos(start + turn * k / n), centre[1] + radius * math.sin(start + turn * k / n)) for k in range(n + 1)]

    def side(way: list[tuple[float, float]]) -> list[tuple[float, float]]:
        """The right-hand side of a way, and the half circle about its last point."""
        angles = [math.atan2(b[1] - a[1], b[0] - a[0]) for a, b in zip(way[:-1], way[1:], strict=True)]
        out = []
        for k, (p, a) in enumerate(zip(way[1:], angles, strict=True)):
            if k == 0:
                out += arc(way[0], a - math.pi / 2, 0.0)[:1]
            if k + 1 == len(angles):
                return out + arc(p, a - math.pi / 2, math.pi)
            turn = (angles[k + 1] - a + math.pi) % (2 * math.pi) - math.pi
            if turn > 0:
                out += arc(p, a - math.pi / 2, turn)
            else:
                # Inside a turn the offsets of both pieces meet.
                reach = radius / max(math.cos(turn / 2), 0.1)
                out.append((p[0] + reach * math.cos(a + turn / 2 - math.pi / 2), p[1] + reach * math.sin(a + turn / 2 - math.pi / 2)))
        return out

    return side(line)[:-1] + side(line[::-1])[:-1]


def buffered(lines: DataFrame, radius: float = 1.5, per_quadrant: int = 8) -> DataFrame:
    """``lines`` (id, coords) as rings (id, ring); lines of under two different vertices go."""

    def rings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [buffer_ring([(p["x"], p["y"]) for p in c], radius, per_quadrant) for c in batch["coords"]]
            kept = [k for k, ring in enumerate(made) if ring]
            rings_ = pd.Series([[{"x": x, "y": y} for x, y in made[k]] for k in kept], dtype=object)
            yield pd.DataFrame({"id": pd.Series(batch["id"].iloc[kept].tolist(), dtype="int64"), "ring": rings_})

    return lines.select("id", "coords").mapInPandas(rings, "id long, ring array<struct<x:double,y:double>>")
