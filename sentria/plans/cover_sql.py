"""Covers of polygons in DuckDB's SQL: the middles of all cells of an area, and which lie in a polygon.

A mesh of positions, finer than a cell, meets every cell. Each is taken to the
middle of its cell on its face, which is looked up once more, because a cell
beyond a face's edge has its middle on the other face. The rest is a
test of each middle against a polygon's edges.
"""

from __future__ import annotations

import math

from ..functions import h3grid
from ..params import EARTH_KM
from .grid_queries import ANGLE, cells_sql

#: Steps of the mesh in degrees: some 2 km, where a cell of resolution 6 is 5 km wide at least.
LON_STEP, LAT_STEP = 0.025, 0.02


def _middle_of(resolution: int) -> str:
    """Middle and area of the cell of each ``id``, from the plane of its face: cells are equal there, and the sphere has them smaller by the cube of the cosine."""
    unit, turn = h3grid.STEP / 7 ** (resolution / 2), h3grid._TURN * (resolution % 2)
    whole = math.sqrt(3) / 2 * (unit * EARTH_KM) ** 2
    return f"""
(SELECT id, degrees(lon0 + atan2(sin(az) * sin(c) * cos(lat0), cos(c) - sin(lat0) * sin(y))) AS lon, degrees(y) AS lat, {whole!r} * pow(cos(c), 3) AS km2
FROM (SELECT *, asin(cos(c) * sin(lat0) + sin(c) * cos(lat0) * cos(az)) AS y
FROM (SELECT l.id, lat0, lon0, atan(sqrt(i * i - i * j + j * j) * {unit!r}) AS c, axis - atan2(j * sqrt(3) / 2, i - j / 2.0) - {turn!r} AS az FROM lattice l JOIN faces f USING (face))))"""


def middles_sql(boxes: str, resolution: int) -> str:
    """A query of ``cell, lon, lat, km2``: all cells with a part in one of the boxes (x1, y1, x2, y2 in degrees, none near the date line)."""
    mesh = f"""SELECT row_number() OVER () AS id, lon, lat FROM (SELECT DISTINCT a * {LON_STEP} AS lon, b * {LAT_STEP} AS lat FROM ({boxes}),
unnest(range(floor(x1 / {LON_STEP})::BIGINT, ceil(x2 / {LON_STEP})::BIGINT + 1)) u(a), unnest(range(floor(y1 / {LAT_STEP})::BIGINT, ceil(y2 / {LAT_STEP})::BIGINT + 1)) v(b))"""
    met = f"WITH {cells_sql(mesh, resolution)} SELECT cell, any_value(m.lon) AS lon, any_value(m.lat) AS lat FROM cells JOIN {_middle_of(resolution)} m USING (id) GROUP BY cell"
    again = f"SELECT row_number() OVER () AS id, lon, lat FROM ({met})"
    return f"(WITH {cells_sql(again, resolution)} SELECT DISTINCT cell, m.lon, m.lat, km2 FROM cells JOIN {_middle_of(resolution)} m USING (id))"


def disc_corners_sql(discs: str, vertices: int = 48) -> str:
    """A query of ``key, i, x, y``: corners of discs (key, lon, lat, km)."""
    d, rim = f"km / {EARTH_KM}", "asin(sin(radians(lat)) * cos(d) + cos(radians(lat)) * sin(d) * cos(t))"
    return f"""(SELECT key, i, lon + degrees(atan2(sin(t) * sin(d) * cos(radians(lat)), cos(d) - sin(radians(lat)) * sin(y))) AS x, degrees(y) AS y
FROM (SELECT *, {rim} AS y FROM (SELECT *, {d} AS d, i * 2 * pi() / {vertices} AS t FROM ({discs}), range(0, {vertices}) s(i))))"""


def inside_sql(corners: str, middles: str) -> str:
    """A query of ``key, cell, lon, lat, km2``: cells with their middles inside of polygons, given as one ring of corners (key, i, x, y) each."""
    return f"""(WITH ring AS (SELECT key, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM {corners} WINDOW w AS (PARTITION BY key ORDER BY i)),
box AS (SELECT key, min(x1) AS west, max(x1) AS east, min(y1) AS south, max(y1) AS north FROM ring GROUP BY key)
SELECT key, cell, lon, lat, any_value(km2) AS km2 FROM box JOIN {middles} ON lon BETWEEN west AND east AND lat BETWEEN south AND north JOIN ring USING (key)
WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / CASE WHEN y1 = y2 THEN 1 ELSE y2 - y1 END + x1 GROUP BY key, cell, lon, lat HAVING count(*) % 2 = 1)"""


def near_sql(middles: str) -> str:
    """A query of ``of, cell``: each cell and its neighbours, whose middles are one width of a cell away (the next ones 1.7 widths)."""
    apart = f"2 * {EARTH_KM} * asin(sqrt(pow(sin(radians(m.lat - f.lat) / 2), 2) + cos(radians(m.lat)) * cos(radians(f.lat)) * pow(sin(radians(m.lon - f.lon) / 2), 2)))"
    return f"(SELECT f.cell AS of, m.cell FROM {middles} f JOIN {middles} m ON m.lat BETWEEN f.lat - 0.2 AND f.lat + 0.2 AND m.lon BETWEEN f.lon - 0.3 AND f.lon + 0.3 WHERE {apart} < 1.35 * sqrt(2 / sqrt(3) * f.km2))"


def grown_sql(found: str, near: str) -> str:
    """A query of ``key, cell``: cells and their neighbours."""
    return f"(SELECT DISTINCT f.key, n.cell FROM {found} f JOIN {near} n ON n.of = f.cell)"


def hull_sql(discs: str, vertices: int = 48) -> str:
    """A query of ``key, i, x, y``: corners of the hull of each key's discs (key, lon, lat, km, scale), in a plane with longitudes times ``scale``.

    A corner is a point with a gap of more than half a turn between the directions of two others.
    """
    rims = disc_corners_sql(f"SELECT struct_pack(of := key, scale := scale, n := row_number() OVER ()) AS key, lon, lat, km FROM ({discs})", vertices)
    return f"""(WITH points AS (SELECT DISTINCT key.of AS key, key.scale AS scale, x * key.scale AS x, y FROM {rims}),
turns AS (SELECT p.key, p.scale, p.x, p.y, atan2(q.y - p.y, q.x - p.x) AS t FROM points p JOIN points q ON p.key = q.key AND (p.x <> q.x OR p.y <> q.y)),
gaps AS (SELECT *, coalesce(t - lag(t) OVER w, t + 2 * pi() - max(t) OVER (PARTITION BY key, x, y)) AS gap FROM turns WINDOW w AS (PARTITION BY key, x, y ORDER BY t)),
corners AS (SELECT key, x, y, any_value(scale) AS scale FROM gaps GROUP BY key, x, y HAVING max(gap) > pi() + 1e-9)
SELECT key, atan2(y - avg(y) OVER v, x - avg(x) OVER v) AS i, x / scale AS x, y FROM corners WINDOW v AS (PARTITION BY key))"""


_AROUND = lambda rows, side: f"SELECT lon - {side} AS x1, lat - {side} AS y1, lon + {side} AS x2, lat + {side} AS y2 FROM ({rows})"
_NATIONS = "SELECT n_nationkey AS key, 22 + 0.7::DOUBLE * n_nationkey AS lon, 44 + 0.3::DOUBLE * n_nationkey AS lat FROM nation"
_discs = lambda km: disc_corners_sql(f"SELECT *, {km} AS km FROM ({_NATIONS})")
_joined = "array_to_string(list_sort(list(printf('%x', cell))), ',')"
_SLIVERS = _discs(0.2)

COVERS = f"""
WITH middles AS MATERIALIZED (SELECT * FROM {middles_sql(_AROUND(_NATIONS, 0.4), 6)}),
discs AS (SELECT key, {_joined} AS disc FROM {inside_sql(_discs(20.0), 'middles')} GROUP BY key),
touched AS (SELECT id // 100 AS key, cell FROM (WITH {cells_sql(f'SELECT key * 100 + i AS id, x AS lon, y AS lat FROM {_SLIVERS}', 6)} SELECT id, cell FROM cells)),
held AS (SELECT key, cell FROM {inside_sql(_SLIVERS, 'middles')}),
slivers AS (SELECT key, {_joined} AS sliver FROM (SELECT key, cell FROM held UNION SELECT key, cell FROM touched WHERE key NOT IN (SELECT key FROM held)) GROUP BY key)
SELECT n_nationkey, disc, NULL::VARCHAR AS disc_error, sliver, NULL::VARCHAR AS sliver_error, NULL::VARCHAR AS large,
    CASE WHEN pi() * 400 * 400 / {h3grid.mean_area_km2(6)!r} > 400 THEN 'cover_too_large' END AS large_error
FROM nation LEFT JOIN discs ON discs.key = n_nationkey LEFT JOIN slivers ON slivers.key = n_nationkey
"""

_SQUARES = f"(SELECT key, i, lon + [-0.5, 0.5, 0.5, -0.5][i + 1] AS x, lat + [-0.5, -0.5, 0.5, 0.5][i + 1] AS y FROM ({_NATIONS}), range(0, 4) s(i))"
REGIONS = f"""
WITH middles AS MATERIALIZED (SELECT * FROM {middles_sql(_AROUND(_NATIONS, 0.6), 6)})
SELECT 'ua-adm1:' || key AS id, round(avg(lon), 1) AS lon, ceil(sqrt(sum(km2) / pi()))::INT AS reach_km, count(*)::INT AS n_cells, NULL::VARCHAR AS error
FROM {inside_sql(_SQUARES, 'middles')} GROUP BY key
"""

_ANGLES = f"(SELECT key, i, lon + {[x for x, _ in ANGLE]}[i + 1] AS x, lat + {[y for _, y in ANGLE]}[i + 1] AS y FROM ({_NATIONS}), range(0, {len(ANGLE)}) s(i))"
DESCENT = f"""
WITH middles AS MATERIALIZED (SELECT * FROM {middles_sql(_AROUND(_NATIONS, 0.6), 6)})
SELECT key AS n_nationkey, printf('%x', cell) AS cell FROM {inside_sql(_ANGLES, 'middles')}
"""

#: Of ``obs`` (place_id, place_no): each town's disc of 10 km and one ring.
FOOTPRINTS = f"""
towns AS (SELECT DISTINCT place_id AS key, 22 + 0.7::DOUBLE * place_no AS lon, 44 + 0.3::DOUBLE * place_no AS lat, 10.0 AS km FROM obs WHERE place_id LIKE 'geonames:%'),
middles AS MATERIALIZED (SELECT * FROM {middles_sql(_AROUND('SELECT * FROM towns', 0.4), 6)}), near AS MATERIALIZED (SELECT * FROM {near_sql('middles')})
SELECT key, printf('%x', cell) AS cell FROM {grown_sql(inside_sql(disc_corners_sql('SELECT * FROM towns'), 'middles'), 'near')}
"""


def track_cells_sql(now_us: str) -> str:
    """Of ``tracks``: cells of live ones at a town, of the disc in which they are by now, or of the corridor from it to another town that they head for."""
    at = lambda n: f"22 + 0.7::DOUBLE * {n} AS lon, 44 + 0.3::DOUBLE * {n} AS lat"
    floor = "CASE class WHEN 'missile' THEN 25.0 ELSE 15.0 END"
    speed = "CASE kind WHEN 'air.attack_drone' THEN 200.0 WHEN 'air.jet_drone' THEN 700.0 WHEN 'air.missile' THEN 1000.0 ELSE 0.0 END"
    return f"""
live_tracks AS (SELECT track_id, position AS p, CASE WHEN target < 100 AND target <> position THEN target END AS q, greatest(10.0, {floor}) AS there,
    greatest(10.0 + least(40.0, {speed} * greatest(0, {now_us} - last_us) / 3.6e9), {floor}) AS here FROM tracks WHERE status IN ('active', 'quiet') AND position < 100),
drawn AS (SELECT track_id AS key, {at('p')}, here AS km, cos(radians(44 + 0.15::DOUBLE * (p + coalesce(q, p)))) AS scale FROM live_tracks
    UNION ALL SELECT track_id, {at('q')}, there, cos(radians(44 + 0.15::DOUBLE * (p + q))) FROM live_tracks WHERE q IS NOT NULL),
boxes AS (SELECT min(lon) - 0.9 AS x1, min(lat) - 0.7 AS y1, max(lon) + 0.9 AS x2, max(lat) + 0.7 AS y2 FROM drawn GROUP BY key),
middles AS MATERIALIZED (SELECT * FROM {middles_sql('SELECT DISTINCT * FROM boxes', 6)}), near AS MATERIALIZED (SELECT * FROM {near_sql('middles')}),
sized AS (SELECT key, count(*) AS n FROM {grown_sql(inside_sql(hull_sql('SELECT * FROM drawn'), 'middles'), 'near')} GROUP BY key)
SELECT track_id, status, coalesce(n, 0)::INT AS n_cells, 0::INT AS n_region_cells FROM tracks LEFT JOIN sized ON sized.key = track_id
"""


SQL = {"G01_G04_covers": COVERS, "G04_descent": DESCENT, "S28_S34_regions": REGIONS}
