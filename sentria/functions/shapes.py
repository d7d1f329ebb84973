"""Covers of geometries as sets of H3 cells, for distinct geometries in plain Python."""

from __future__ import annotations

import math

from ..params import EARTH_KM
from . import h3grid

Cells = set[int]
#: The estimate of a polygon's cells may exceed the real count so many times before it is refused.
SLACK = 2.0


class Refused(ValueError):
    """Why there is no cover: ``invalid_geometry`` or ``cover_too_large``."""


def parsed(text: str) -> tuple[int, int]:
    """Resolution and number of a cell's text."""
    try:
        cell = h3grid.parsed(text)
    except h3grid.NotACell as e:
        raise Refused("invalid_geometry") from e
    return h3grid.resolution_of(cell), cell


def texts(cells: Cells, resolution: int) -> list[str]:
    return sorted(map(h3grid.text_of, cells))


def centroid(cells: Cells, resolution: int) -> tuple[float, float, float]:
    """Longitude and latitude of the mean center, and the radius of a circle of equal area."""
    found = [h3grid.center_of(c) for c in cells]
    return sum(x for x, _ in found) / len(found), sum(y for _, y in found) / len(found), math.sqrt(sum(map(h3grid.area_km2, cells)) / math.pi)


def _ring_km2(ring: list[tuple[float, float]]) -> float:
    steps = zip(ring, ring[1:], strict=False)
    return abs(sum(math.radians(q[0] - p[0]) * (2 + math.sin(math.radians(p[1])) + math.sin(math.radians(q[1]))) for p, q in steps)) * EARTH_KM**2 / 2


def _km(p: tuple[float, float], q: tuple[float, float]) -> float:
    a, b = math.radians(p[1]), math.radians(q[1])
    return 2 * EARTH_KM * math.asin(min(1.0, math.sqrt(math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(q[0] - p[0]) / 2) ** 2)))


def _inside(rings: list[list[tuple[float, float]]], x: float, y: float) -> bool:
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def _touched(rings: list[list[tuple[float, float]]], resolution: int, step_km: float, limit: float) -> Cells:
    """Cells along the boundary, looked up at steps of such a length."""
    out: Cells = set()
    for ring in rings:
        for p, q in zip(ring, ring[1:], strict=False):
            n = max(1, math.ceil(_km(p, q) / step_km))
            out.update(h3grid.cell_of(p[0] + (q[0] - p[0]) * t / n, p[1] + (q[1] - p[1]) * t / n, resolution) for t in range(n))
            if len(out) > limit:
                raise Refused("cover_too_large")
    return out


def polygon(rings: list[list[tuple[float, float]]], resolution: int, max_cells: int) -> Cells:
    """Cells with their center inside; all that it touches if there are none.

    What is certainly too large is refused by its area and boundary. The cells
    along the boundary are then grown inwards, neighbour by neighbour.
    """
    edge = h3grid.mean_edge_km(resolution)
    area = _ring_km2(rings[0]) - sum(map(_ring_km2, rings[1:]))
    boundary = sum(_km(p, q) for ring in rings for p, q in zip(ring, ring[1:], strict=False))
    if max(area / h3grid.mean_area_km2(resolution), boundary / edge) > SLACK * max_cells:
        raise Refused("cover_too_large")
    seen = _touched(rings, resolution, edge / 2, math.inf)
    edge_cells, found = h3grid.disk(seen, 1), set()
    seen = set(edge_cells)
    while edge_cells:
        fresh = {c for c in edge_cells if _inside(rings, *h3grid.center_of(c))}
        found |= fresh
        if len(found) > max_cells:
            raise Refused("cover_too_large")
        edge_cells = {n for c in fresh for n in h3grid.neighbours(c)} - seen
        seen |= edge_cells
    return found or _touched(rings, resolution, edge / 20, max_cells)


def recast(listed: list[str], resolution: int, max_cells: int, declared: int | None = None) -> Cells:
    """A list of ids at another resolution: parents, or all children if they fit."""
    known = [parsed(t) for t in listed]
    have = known[0][0] if declared is None else declared
    if any(r != have for r, _ in known):
        raise Refused("invalid_geometry")
    cells = {c for _, c in known}
    if resolution <= have:
        return {h3grid.parent_of(c, resolution) for c in cells}
    if sum(h3grid.children_count(c, resolution) for c in cells) > max_cells:
        raise Refused("cover_too_large")
    return {child for c in cells for child in h3grid.children_of(c, resolution)}


def around(lon: float, lat: float, km: float, vertices: int) -> list[tuple[float, float]]:
    """A closed ring at a distance, clockwise from north."""
    from .sphere import _around

    ring = _around(lon, lat, km, vertices)
    return [*ring, ring[0]]


def _position(pair: list | None) -> tuple[float, float]:
    if not pair or len(pair) != 2 or any(x is None or not math.isfinite(x) for x in pair) or abs(pair[0]) > 180 or abs(pair[1]) > 90:
        raise Refused("invalid_geometry")
    return pair[0], pair[1]


def rings_of(geometry: dict) -> list[list[tuple[float, float]]]:
    rings = [[_position(p) for p in ring or []] for ring in geometry["rings"] or []]
    if not rings or any(len(r) < 4 or r[0] != r[-1] for r in rings):
        raise Refused("invalid_geometry")
    return rings


def covered(geometry: dict, resolution: int, max_cells: int, point_km: float | None = None, vertices: int = 48) -> Cells:
    """Cells of a geometry; a point is one cell, or a disc if ``point_km`` is given."""
    kind = geometry["type"]
    if kind == "point":
        at = _position(geometry["coordinates"])
        cells = {h3grid.cell_of(*at, resolution)} if point_km is None else polygon([around(*at, point_km, vertices)], resolution, max_cells)
    elif kind == "polygon":
        cells = polygon(rings_of(geometry), resolution, max_cells)
    elif kind == "cells" and geometry["cells"]:
        cells = recast(geometry["cells"], resolution, max_cells, geometry.get("resolution"))
    else:
        raise Refused("invalid_geometry")
    if len(cells) > max_cells:
        raise Refused("cover_too_large")
    return cells


def expanded(cells: Cells, rings: int, max_cells: int) -> Cells:
    grown = h3grid.disk(cells, rings)
    if len(grown) > max_cells:
        raise Refused("cover_too_large")
    return grown


Segment = tuple[float, float, float, float]


def _box(lon: float, lat: float, resolution: int) -> tuple[float, float, float, float] | None:
    """Degrees around a cell's middle that hold the middles of all cells within it; None at the date line and the poles."""
    up = math.degrees(2.0 * h3grid.mean_edge_km(resolution) / EARTH_KM)
    if abs(lat) + up >= 89.0:
        return None
    side = up / math.cos(math.radians(abs(lat) + up))
    return None if abs(lon) + side >= 180.0 else (lon - side, lat - up, lon + side, lat + up)


def _meets(s: Segment, box: tuple[float, float, float, float]) -> bool:
    """Whether a segment has a point in a box."""
    x1, y1, x2, y2 = s
    left, low, right, high = box
    if max(x1, x2) < left or min(x1, x2) > right or max(y1, y2) < low or min(y1, y2) > high:
        return False
    # the corners on both sides of its line, or one on it
    side = [(x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) for x, y in ((left, low), (right, low), (right, high), (left, high))]
    return min(side) <= 0 <= max(side)


def _crossed(segments: list[Segment], a: tuple[float, float], b: tuple[float, float]) -> bool:
    """Whether a way from a to b, first along the parallel and then along the meridian, crosses the segments an odd number of times."""
    odd = False
    low, high = sorted((a[0], b[0]))
    down, up = sorted((a[1], b[1]))
    for x1, y1, x2, y2 in segments:
        if (y1 > a[1]) != (y2 > a[1]) and low < (x2 - x1) * (a[1] - y1) / (y2 - y1) + x1 <= high:
            odd = not odd
        if (x1 > b[0]) != (x2 > b[0]) and down < (y2 - y1) * (b[0] - x1) / (x2 - x1) + y1 <= up:
            odd = not odd
    return odd


def _within(segments: list[Segment], x: float, y: float) -> bool:
    return sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for x1, y1, x2, y2 in segments) % 2 == 1


def coarse_cells(rings: list[list[tuple[float, float]]], resolution: int) -> list[tuple[int, bool, list[Segment]]]:
    """Cells that may hold parts of a polygon: each with whether its middle is inside, and the segments near it (all of them, at the date line)."""
    segments = [(*p, *q) for ring in rings for p, q in zip(ring, ring[1:], strict=False)]
    edge = h3grid.disk(_touched(rings, resolution, h3grid.mean_edge_km(resolution) / 2, math.inf), 1)
    seen, fresh, out = set(edge), set(edge), []
    while fresh:
        grown = set()
        for cell in sorted(fresh):
            at = h3grid.center_of(cell)
            box, inside = _box(*at, resolution), _within(segments, *at)
            near = segments if box is None else [s for s in segments if _meets(s, box)]
            out.append((cell, inside, near))
            if inside:
                grown.update(h3grid.neighbours(cell))
        fresh = grown - seen
        seen |= fresh
    return out


def split_cell(cell: int, inside: bool, segments: list[Segment]) -> list[tuple[int, bool, list[Segment]]]:
    """A cell's children, likewise, from the segments near the cell alone."""
    at, r = h3grid.center_of(cell), h3grid.resolution_of(cell) + 1
    whole = _box(*at, r - 1) is None
    out = []
    for child in h3grid.children_of(cell, r):
        middle = h3grid.center_of(child)
        box = _box(*middle, r)
        within = _within(segments, *middle) if whole else inside != _crossed(segments, at, middle)
        out.append((child, within, segments if box is None else [s for s in segments if _meets(s, box)]))
    return out
