"""H3 on numpy arrays: what ``h3grid`` says of one cell, of many at once.

The same steps as there, with its tables as arrays. Positions so close to the edge between two
cells or faces that rounding could tell, and areas of pentagons, are left to ``h3grid``.
"""

from __future__ import annotations

import math

import numpy as np

from . import h3grid as G

_MIDDLES = np.array(G._MIDDLES)
_LAT0, _LON0, _AXIS = np.array(G.FACES).T
_TURNS = np.array([[*G._turned((1, 0), n), *G._turned((0, 1), n)] for n in range(6)], dtype=np.int64)
_STEPS, _LEFT = np.array(G.STEPS, dtype=np.int64), np.array(G._LEFT, dtype=np.int64)
_DIGITS = np.full((3, 3), -1, dtype=np.int64)
for _digit, (_i, _j) in enumerate(G.STEPS):
    _DIGITS[_i + 1, _j + 1] = _digit
_ON_FACE = np.full((20, 5, 5, 2), -1, dtype=np.int64)
for (_face, (_i, _j)), _found in G._ON_FACE.items():
    _ON_FACE[_face, _i + 2, _j + 2] = _found
_HOME_FACE, _HOME = np.array([f for f, _ in G.BASES], dtype=np.int64), np.array([p for _, p in G.BASES], dtype=np.int64)
_IS_PENTAGON = np.array([b in G.PENTAGONS for b in range(len(G.BASES))])
_OTHER = np.array([[G.CROSSINGS[f, e][0] for e in range(3)] for f in range(20)], dtype=np.int64)
_CROSS_TURNS = np.array([[G.CROSSINGS[f, e][1] for e in range(3)] for f in range(20)], dtype=np.int64)
#: In which turn, to the right from the home face's, the leading digit of a pentagon's cell lies.
_TOWARD = np.array([0, 0, 1, 0, 3, 4, 2], dtype=np.int64)
#: What may be rounding, in lattice steps and in cosines.
_NEAR, _NEAR_FACE = 1e-5, 1e-11


def _edges_around(face: int) -> list[int]:
    """The edges that a walk around a home face's first corner crosses."""
    shared, edge, out = G.CORNER_IDS[face][0], 0, []
    for _ in range(7):
        out.append(edge)
        crossed = {G.CORNER_IDS[face][c] for c in G.EDGES[edge]}
        face = G.CROSSINGS[face, edge][0]
        edge = next(e for e, pair in enumerate(G.EDGES) if shared in (ids := {G.CORNER_IDS[face][c] for c in pair}) and ids != crossed)
    return out


_AROUND = np.array([_edges_around(f) if p == G.CORNERS[0] else [0] * 7 for f, p in G.BASES], dtype=np.int64)


def _finer(i, j, resolution):  # noqa: ANN001, ANN202
    return (2 * i + j, 3 * j - i) if resolution % 2 else (3 * i - j, i + 2 * j)


def _turned(i, j, n):  # noqa: ANN001, ANN202
    t = _TURNS[n]
    return t[..., 0] * i + t[..., 2] * j, t[..., 1] * i + t[..., 3] * j


def _shifts(resolution: int) -> np.ndarray:
    return np.array([[G._crossing(f, e, resolution)[2] for e in range(3)] for f in range(20)], dtype=np.int64)


def _cross(face, i, j, edge, shifts):  # noqa: ANN001, ANN202
    turns = _CROSS_TURNS[face, edge]
    i, j = _turned(i, j, turns)
    shift = shifts[face, edge]
    return _OTHER[face, edge], i + shift[..., 0], j + shift[..., 1], turns


def _edges_beyond(i, j, resolution: int):  # noqa: ANN001, ANN202
    """The edge beyond which each point lies; -1 on the face."""
    if resolution % 2:
        i, j = _finer(i, j, resolution + 1)
        resolution += 1
    low = np.minimum(np.minimum(i, j), 0)
    a, b, c = i - low, j - low, -low
    edge = np.where(c == 0, 0, np.where(a == 0, 2, 1))
    return np.where(a + b + c > 2 * 7 ** (resolution // 2), edge, -1)


def _leading(digits: list[np.ndarray], n: int) -> np.ndarray:
    found = np.zeros(n, dtype=np.int64)
    for d in digits:
        found = np.where(found == 0, d, found)
    return found


def _cells_at(face: np.ndarray, i: np.ndarray, j: np.ndarray, resolution: int) -> np.ndarray:
    digits: list[np.ndarray] = []
    for r in range(resolution, 0, -1):
        a, b = (3 * i - j, i + 2 * j) if r % 2 else (2 * i + j, 3 * j - i)
        up_i, up_j = (a + 3) // 7, (b + 3) // 7
        down_i, down_j = _finer(up_i, up_j, r)
        digits.append(_DIGITS[i - down_i + 1, j - down_j + 1])
        i, j = up_i, up_j
    digits.reverse()
    home, turns, shifts = face.copy(), np.zeros_like(face), _shifts(0)
    i, j = i.copy(), j.copy()
    while len(out := np.flatnonzero((edge := _edges_beyond(i, j, 0)) >= 0)):
        home[out], i[out], j[out], more = _cross(home[out], i[out], j[out], edge[out], shifts)
        turns[out] += more
    found = _ON_FACE[home, i + 2, j + 2]
    base, n = found[:, 0], (turns + found[:, 1]) % 6
    digits = [_LEFT[n, d] for d in digits]
    gap = np.flatnonzero(_IS_PENTAGON[base] & (_leading(digits, len(face)) == G.MISSING))
    if len(gap):
        again = np.where(home[gap] == _HOME_FACE[base[gap]], 1, 5)
        for d in digits:
            d[gap] = _LEFT[again, d[gap]]
    cells = (1 << 59 | resolution << 52 | (1 << 3 * (15 - resolution)) - 1) | base << 45
    for r, d in enumerate(digits, 1):
        cells |= d << 3 * (15 - r)
    return cells


def _places_of(cells: np.ndarray, resolution: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    base = cells >> 45 & 127
    digits = [cells >> 3 * (15 - r) & 7 for r in range(1, resolution + 1)]
    face, (i, j), shifts = _HOME_FACE[base], _HOME[base].T, _shifts(resolution)
    corner_i, corner_j = i, j
    for r, d in enumerate(digits, 1):
        i, j = _finer(i, j, r)
        i, j = i + _STEPS[d, 0], j + _STEPS[d, 1]
        corner_i, corner_j = _finer(corner_i, corner_j, r)
    face, i, j = face.copy(), i.copy(), j.copy()
    at_corner = _IS_PENTAGON[base]
    edge = np.where(at_corner, -1, _edges_beyond(i, j, resolution))
    if at_corner.any():
        leading = _leading(digits, len(cells))
        z = ((i - corner_i) + (j - corner_j) * G._W) * G._unit(resolution)
        toward = _TOWARD[leading]
        off = math.pi - np.angle(z) - toward * (math.pi / 3)
        sector = toward + np.rint((off - 2 * math.pi * np.rint(off / (2 * math.pi))) / (math.pi / 3)).astype(np.int64)
        sector = np.where(at_corner & (leading > 0), sector, 0)
        edge = np.where(sector < 0, 1, edge)
        for n in range(7):
            on = np.flatnonzero(sector > n)
            if len(on):
                face[on], i[on], j[on], _ = _cross(face[on], i[on], j[on], _AROUND[base[on], n], shifts)
    out = np.flatnonzero(edge >= 0)
    if len(out):
        face[out], i[out], j[out], _ = _cross(face[out], i[out], j[out], edge[out], shifts)
    return face, i, j


def _by_resolution(cells: np.ndarray) -> list[tuple[int, np.ndarray]]:
    resolutions = cells >> 52 & 15
    return [(int(r), np.flatnonzero(resolutions == r)) for r in np.unique(resolutions)]


def cells_of(lon: np.ndarray, lat: np.ndarray, resolution: int) -> np.ndarray:
    """The cells that hold positions in degrees."""
    b, a = np.radians(lon), np.radians(lat)
    spots = np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], axis=1)
    cosines = spots @ _MIDDLES.T
    face = np.argmax(cosines, axis=1)
    best = np.partition(cosines, -2, axis=1)
    cosine = best[:, -1]
    lat0, lon0 = _LAT0[face], _LON0[face]
    angle = np.arccos(np.clip(cosine, -1.0, 1.0))
    azimuth = np.arctan2(np.cos(a) * np.sin(b - lon0), np.cos(lat0) * np.sin(a) - np.sin(lat0) * np.cos(a) * np.cos(b - lon0))
    z = np.tan(angle) / G.STEP * np.exp(1j * (_AXIS[face] - azimuth)) / G._unit(resolution)
    y = z.imag * 2 / math.sqrt(3)
    x = z.real + y / 2
    q, r, s = np.rint(x - y), np.rint(y), np.rint(-x)
    dq, dr, ds = np.abs(q - (x - y)), np.abs(r - y), np.abs(s + x)
    first, second = (dq > dr) & (dq > ds), dr > ds
    i = np.where(first, -s, np.where(second, -s, q + r)).astype(np.int64)
    j = np.where(first, r, np.where(second, -q - s, r)).astype(np.int64)
    cells = _cells_at(face, i, j, resolution)
    off = np.sort(np.stack([dq, dr, ds], axis=1), axis=1)
    close = (best[:, -1] - best[:, -2] < _NEAR_FACE) | (cosine > 1 - 1e-12) | (off[:, 2] > 0.5 - _NEAR) | (off[:, 2] - off[:, 1] < _NEAR) & (q + r + s != 0)
    for n in np.flatnonzero(close):
        cells[n] = G.cell_of(float(lon[n]), float(lat[n]), resolution)
    return cells


def centers_of(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longitudes and latitudes of cells' middles in degrees."""
    lon, lat = np.empty(len(cells)), np.empty(len(cells))
    for resolution, at in _by_resolution(cells):
        face, i, j = _places_of(cells[at], resolution)
        z = (i + j * G._W) * G._unit(resolution)
        lat0, lon0 = _LAT0[face], _LON0[face]
        angle, azimuth = np.arctan(np.abs(z) * G.STEP), _AXIS[face] - np.angle(z)
        sine = np.sin(lat0) * np.cos(angle) + np.cos(lat0) * np.sin(angle) * np.cos(azimuth)
        east = lon0 + np.arctan2(np.sin(azimuth) * np.sin(angle) * np.cos(lat0), np.cos(angle) - np.sin(lat0) * sine)
        lon[at], lat[at] = np.degrees(east - 2 * math.pi * np.rint(east / (2 * math.pi))), np.degrees(np.arcsin(np.clip(sine, -1.0, 1.0)))
    return lon, lat


def neighbours(cells: np.ndarray) -> np.ndarray:
    """The six cells around each in a turn; one of five is there twice around a pentagon."""
    out = np.empty((len(cells), 6), dtype=np.int64)
    for resolution, at in _by_resolution(cells):
        face, i, j = _places_of(cells[at], resolution)
        for n in range(6):
            di, dj = G._turned((1, 0), n)
            out[at, n] = _cells_at(face, i + di, j + dj, resolution)
    return out


def areas_km2(cells: np.ndarray) -> np.ndarray:
    around = neighbours(cells)
    lon, lat = (np.radians(x) for x in centers_of(np.concatenate([cells[:, None], around], axis=1).ravel()))
    spots = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1).reshape(-1, 7, 3)
    middle, ring = spots[:, 0], spots[:, 1:]
    dot = lambda u, v: np.einsum("ni,ni->n", u, v)
    corners = middle[:, None] + ring + np.roll(ring, -1, axis=1)
    corners /= np.linalg.norm(corners, axis=2, keepdims=True)
    total = np.zeros(len(cells))
    for n in range(6):
        a, b = corners[:, n], corners[:, (n + 1) % 6]
        total += np.abs(2 * np.arctan2(dot(middle, np.cross(a, b)), 1 + dot(middle, a) + dot(a, b) + dot(b, middle)))
    total *= G.EARTH_KM**2
    ordered = np.sort(around, axis=1)
    for n in np.flatnonzero((ordered[:, 1:] == ordered[:, :-1]).any(axis=1)):
        total[n] = G.area_km2(int(cells[n]))
    return total


def _distinct(rows: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((cells, rows))
    rows, cells = rows[order], cells[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (cells[1:] != cells[:-1])
    return rows[new], cells[new]


def disks(rows: np.ndarray, cells: np.ndarray, rings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of each row and those up to ``rings[row]`` steps away, as pairs in order."""
    rows, cells = _distinct(rows, cells)
    for step in range(int(rings.max(initial=0))):
        go = rings[rows] > step
        around = neighbours(cells[go])
        rows, cells = _distinct(np.concatenate([rows, np.repeat(rows[go], 6)]), np.concatenate([cells, around.ravel()]))
    return rows, cells
