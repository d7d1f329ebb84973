"""Geometry on a sphere, as columns. Positions are ``struct<lon,lat>`` in degrees; rings are arrays of them, closed."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import EARTH_KM

MIN_VERTICES, MAX_VERTICES = 8, 360
MAX_CORRIDOR_KM = 2000.0


def position(lon: Column, lat: Column) -> Column:
    return F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat"))


def haversine_km(a: Column, b: Column) -> Column:
    p, q = F.radians(a["lat"]), F.radians(b["lat"])
    half = lambda x: F.sin(x / 2)
    chord = half(q - p) * half(q - p) + F.cos(p) * F.cos(q) * half(F.radians(b["lon"] - a["lon"])) * half(F.radians(b["lon"] - a["lon"]))
    return 2 * EARTH_KM * F.asin(F.sqrt(chord))


def destination(center: Column, km: Column | float, bearing: Column) -> Column:
    """The position at a distance and bearing (radians, clockwise from north)."""
    d = (F.lit(km) if isinstance(km, (int, float)) else km) / EARTH_KM
    p = F.radians(center["lat"])
    sine = F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(bearing)
    east = F.atan2(F.sin(bearing) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * sine)
    lon = center["lon"] + F.degrees(east)
    return position(F.pmod(lon + 540.0, F.lit(360.0)) - 180.0, F.degrees(F.asin(sine)))


def disc(center: Column, km: Column | float, vertices: int = 48) -> Column:
    """A closed ring of positions around the center; null for a radius that isn't positive."""
    if not MIN_VERTICES <= vertices <= MAX_VERTICES:
        raise ValueError(f"a disc has {MIN_VERTICES} to {MAX_VERTICES} vertices")
    radius = F.lit(float(km)) if isinstance(km, (int, float)) else km
    ring = F.transform(F.sequence(F.lit(0), F.lit(vertices - 1)), lambda i: destination(center, radius, i * (2 * math.pi / vertices)))
    return F.when(radius > 0, F.concat(ring, F.slice(ring, 1, 1)))


def mean_position(ring: Column) -> Column:
    """Mean of a closed ring's corners."""
    corners = F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(1)))
    mean = lambda name: F.aggregate(corners, F.lit(0.0), lambda s, p: s + p[name], lambda s: s / F.size(corners))
    return position(mean("lon"), mean("lat"))


def mean_distance_km(center: Column, ring: Column) -> Column:
    """Mean distance of a closed ring's corners from the center, 1 km at least."""
    corners = F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(1)))
    return F.greatest(F.lit(1.0), F.aggregate(corners, F.lit(0.0), lambda s, p: s + haversine_km(center, p), lambda s: s / F.size(corners)))


def valid_position(p: Column) -> Column:
    return F.coalesce(p["lon"].between(-180.0, 180.0) & p["lat"].between(-90.0, 90.0), F.lit(False))


def ring_of(pairs: Column) -> Column:
    """``[[lon, lat], ...]`` as positions."""
    return F.transform(pairs, lambda x: position(F.get(x, F.lit(0)), F.get(x, F.lit(1))))


def valid_ring(ring: Column) -> Column:
    """Four positions at least, closed, all in range."""
    return F.coalesce((F.size(ring) >= 4) & (F.element_at(ring, 1) == F.element_at(ring, -1)) & F.forall(ring, valid_position), F.lit(False))


def valid_geometry(g: Column) -> Column:
    """Whether the arm that ``type`` names is there and well formed."""
    return F.coalesce(
        F.when(g["type"] == "point", (F.size(g["coordinates"]) == 2) & valid_position(position(F.get(g["coordinates"], F.lit(0)), F.get(g["coordinates"], F.lit(1)))))
        .when(g["type"] == "polygon", (F.size(g["rings"]) > 0) & F.forall(g["rings"], lambda r: valid_ring(ring_of(r))))
        .when(g["type"] == "cells", g["resolution"].between(0, 15) & (F.size(g["cells"]) > 0) & F.forall(g["cells"], lambda c: c.rlike("^[0-9a-f]{1,16}$"))),
        F.lit(False),
    )


def _around(lon: float, lat: float, km: float, n: int) -> list[tuple[float, float]]:
    d, p, out = km / EARTH_KM, math.radians(lat), []
    for i in range(n):
        t = 2 * math.pi * i / n
        s = math.sin(p) * math.cos(d) + math.cos(p) * math.sin(d) * math.cos(t)
        out.append((lon + math.degrees(math.atan2(math.sin(t) * math.sin(d) * math.cos(p), math.cos(d) - math.sin(p) * s)), math.degrees(math.asin(s))))
    return out


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull, counter-clockwise, by angles from its lowest point; collinear points are left out."""
    start = min(points, key=lambda p: (p[1], p[0]))
    rest = sorted({p for p in points if p != start}, key=lambda p: (math.atan2(p[1] - start[1], p[0] - start[0]), (p[0] - start[0]) ** 2 + (p[1] - start[1]) ** 2))
    kept = [start]
    for p in rest:
        while len(kept) > 1 and (kept[-1][0] - kept[-2][0]) * (p[1] - kept[-2][1]) - (kept[-1][1] - kept[-2][1]) * (p[0] - kept[-2][0]) <= 0:
            kept.pop()
        kept.append(p)
    return kept


def corridor_ring(a: tuple[float, float], a_km: float, b: tuple[float, float], b_km: float, vertices: int = 48) -> list[tuple[float, float]] | None:
    """Hull of two discs in a plane scaled at their middle latitude; None beyond ``MAX_CORRIDOR_KM``."""
    mean = math.radians((a[1] + b[1]) / 2)
    span = 2 * EARTH_KM * math.asin(min(1.0, math.sqrt(math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2)))
    if span > MAX_CORRIDOR_KM or min(a_km, b_km) <= 0:
        return None
    scale = max(math.cos(mean), 1e-9)
    flat = [(x * scale, y) for x, y in _around(*a, a_km, vertices) + _around(*b, b_km, vertices)]
    ring = [(x / scale, y) for x, y in hull(flat)]
    return [*ring, ring[0]]


def corridor(a_lon: Column | str, a_lat: Column | str, a_km: Column, b_lon: Column | str, b_lat: Column | str, b_km: Column, vertices: int = 48) -> Column:
    """The ring around two discs, counter-clockwise from its lowest corner, as ``corridor_ring``; null if they are too far apart.

    A corner of the hull is a point from which all others lie within a half circle: sorted by
    direction, two neighbouring ones are more than half a turn apart.
    """
    a, b = (position(F.col(x) if isinstance(x, str) else x, F.col(y) if isinstance(y, str) else y) for x, y in ((a_lon, a_lat), (b_lon, b_lat)))
    scale = F.greatest(F.cos(F.radians((a["lat"] + b["lat"]) / 2)), F.lit(1e-9))

    def rim(center: Column, km: Column) -> Column:
        d, p = km / EARTH_KM, F.radians(center["lat"])

        def corner(i: Column) -> Column:
            t = i * (2 * math.pi / vertices)
            sine = F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(t)
            # not wrapped at the date line, so that both discs stay on one side
            lon = center["lon"] + F.degrees(F.atan2(F.sin(t) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * sine))
            return F.struct((lon * scale).alias("x"), F.degrees(F.asin(sine)).alias("y"))

        return F.transform(F.sequence(F.lit(0), F.lit(vertices - 1)), corner)

    return F.when((haversine_km(a, b) <= MAX_CORRIDOR_KM) & (F.least(a_km, b_km) > 0), _hull(F.concat(rim(a, a_km), rim(b, b_km)), scale))


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """``body(value)`` with the value computed once: lambdas of arrays would compute it again wherever they name it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hull(points: Column, scale: Column) -> Column:
    """Corners of the convex hull of points (x, y), with x taken back to degrees."""
    turn = lambda p, q: F.atan2(q["y"] - p["y"], q["x"] - p["x"])

    def opens(angles: Column) -> Column:
        # each direction and the one before it; the first comes after the last, a whole turn on
        before = F.concat(F.slice(angles, -1, 1), F.slice(angles, 1, F.size(angles) - 1))
        gaps = F.zip_with(angles, before, lambda x, y: F.when(x < y, x - y + 2 * math.pi).otherwise(x - y))
        return F.exists(gaps, lambda g: g > math.pi + 1e-9)

    def ring(corners: Column, start: Column) -> Column:
        rest = F.filter(corners, lambda p: (p["x"] != start["x"]) | (p["y"] != start["y"]))
        sorted_ = F.array_sort(F.transform(rest, lambda p: F.struct(turn(start, p).alias("t"), p["x"].alias("x"), p["y"].alias("y"))))
        first = F.array(position(start["x"] / scale, start["y"]))
        return F.concat(first, F.transform(sorted_, lambda p: position(p["x"] / scale, p["y"])), first)

    corners_of = lambda all_: F.filter(all_, lambda p: _let(F.array_sort(F.transform(F.filter(all_, lambda q: q != p), lambda q: turn(p, q))), opens))
    lowest = lambda corners: F.element_at(F.array_sort(F.transform(corners, lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x")))), 1)
    return _let(F.array_distinct(points), lambda all_: _let(corners_of(all_), lambda corners: _let(lowest(corners), lambda start: ring(corners, start))))
