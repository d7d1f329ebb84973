"""Registered queries of the H3 grid (G), regions (S28, S34) and covers, with DuckDB counterparts.

The SQL finds the cell of a position by itself, from the grid's faces and base
cells as tables; parents and children are bit arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import h3bits, h3cells, h3grid, sphere
from ..operators import regions
from ..operators.footprint import cover_geometries
from ..params import EARTH_KM, GRID_PROFILES

#: Positions over the whole world, from keys.
LON, LAT = "((c_custkey * 7919 % 36000) / 100.0 - 180)", "((c_custkey * 104729 % 17900) / 100.0 - 89.5)"
NONE = "array<string>"
#: Corners of a shape with an angle that opens inwards, in degrees from a nation's place.
ANGLE = ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.0), (0.0, 0.0), (0.0, 0.5), (-0.5, 0.5))


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # dealt by key: a file of one row group would be one task's work
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey").repartition("c_custkey")
    return c.select("c_custkey", F.expr(f"cast({LON} as double)").alias("lon"), F.expr(f"cast({LAT} as double)").alias("lat"))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", (22 + 0.7 * n).cast("double").alias("lon"), (44 + 0.3 * n).cast("double").alias("lat"))


def _cells(spark: SparkSession, sf_dir: str, resolution: int = 6) -> DataFrame:
    return _positions(spark, sf_dir).withColumn("cell", h3cells.cell_of("lon", "lat", F.lit(resolution)))


def _geometry(kind: str, **fields) -> F.Column:
    types = {"coordinates": "array<double>", "rings": "array<array<array<double>>>", "resolution": "int", "cells": "array<string>"}
    return F.struct(F.lit(kind).alias("type"), *((fields[n] if n in fields else F.lit(None)).cast(t).alias(n) for n, t in types.items()))


def g01_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one cell that covers a point, all over the world."""
    points = _positions(spark, sf_dir).select("c_custkey", _geometry("point", coordinates=F.array("lon", "lat")).alias("geometry"))
    return points.join(cover_geometries(points, 6, 400), "geometry").select("c_custkey", F.array_join("cells", ",").alias("cells"), "error")


def g07_cell_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids as text and back, and what is no cell."""
    c = _cells(spark, sf_dir).withColumn("id", h3bits.to_text("cell"))
    broken = F.translate("id", "f", "8")
    return c.select("c_custkey", "id", h3bits.resolution(F.col("cell")).alias("resolution"), h3bits.base_cell(F.col("cell")).alias("base"), h3bits.is_cell(h3bits.parse(F.col("id"))).alias("valid"), h3bits.is_cell(h3bits.parse(broken)).alias("broken"))


def g05_recast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covers of a listed cell at a coarser and a finer resolution; a wrong resolution, and too many children."""
    c = _cells(spark, sf_dir).select("c_custkey", _geometry("cells", cells=F.array(h3bits.to_text("cell")), resolution=F.lit(6)).alias("geometry"))
    wrong = c.withColumn("geometry", F.col("geometry").withField("resolution", F.lit(7)))
    at = lambda rows, resolution, limit, name: rows.join(cover_geometries(rows, resolution, limit), "geometry").select("c_custkey", F.coalesce(F.array_join("cells", ","), "error").alias(name))
    return at(c, 4, 400, "coarser").join(at(c, 7, 400, "finer"), "c_custkey").join(at(c, 9, 300, "many"), "c_custkey").join(at(wrong, 6, 400, "wrong"), "c_custkey")


def g06_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of k-rings, and whether a cell is in the ring of each of its neighbours."""
    c = _cells(spark, sf_dir).withColumn("ring", h3cells.disk(F.array("cell"), F.lit(1)))
    sizes = c.select("c_custkey", F.size("ring").alias("ring_1"), F.size(h3cells.disk(F.array("cell"), F.lit(2))).alias("ring_2"))
    back = c.select("c_custkey", "cell", F.explode("ring").alias("near")).withColumn("back", F.array_contains(h3cells.disk(F.array("near"), F.lit(1)), F.col("cell")))
    return sizes.join(back.groupBy("c_custkey").agg(F.count_if("back").alias("n_back")), "c_custkey")


def g08_g09_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell split twice, one part left out of odd ones, and compacted again."""
    # the part to leave out is found once a customer, step by step: one nested expression of it would run its inner part again at each mention
    first = _cells(spark, sf_dir).withColumn("first", F.get(h3bits.split(F.col("cell")), F.lit(0))).withColumn("first", F.get(h3bits.split(F.col("first")), F.lit(0)))
    kept = regions.uncompacted(first, 8, 2).filter((F.col("c_custkey") % 2 == 0) | (F.col("cell") != F.col("first")))
    return regions.compacted(kept, "c_custkey", 2).groupBy("c_custkey").agg(F.array_join(F.array_sort(F.collect_list(h3bits.to_text("cell"))), ",").alias("cells"))


def g12_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a position belongs in each grid of the current profile."""
    p = GRID_PROFILES["current"]
    cell = lambda resolution: h3bits.to_text(h3cells.cell_of("lon", "lat", F.lit(resolution)))
    return _positions(spark, sf_dir).select("c_custkey", cell(p.broadcast).alias("broadcast"), cell(p.proximity).alias("proximity"))


def g10_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle of seven cells lies within the one in the middle, and a circle as large has seven times its area."""
    c = _cells(spark, sf_dir).filter("abs(lon) < 179 and abs(lat) < 80").withColumn("c", h3cells.centroid(h3cells.disk(F.array("cell"), F.lit(1))))
    back = h3cells.cell_of("c.lon", "c.lat", F.lit(6))
    mean = 7 * h3grid.mean_area_km2(6)
    return c.select("c_custkey", (back == F.col("cell")).alias("inside"), F.abs(F.pi() * F.col("c.radius_km") * F.col("c.radius_km") / mean - 1).between(0, 0.6).alias("as_large"))


def g01_g04_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 20 km disc around each nation by its cells' middles; a sliver by the cells it touches; one of 400 km is refused."""
    n = _nations(spark, sf_dir)
    disc = lambda km: F.array(F.transform(sphere.disc(sphere.position(F.col("lon"), F.col("lat")), km), lambda p: F.array(p["lon"], p["lat"])))
    made = lambda name, ring: n.select("n_nationkey", _geometry("polygon", rings=ring).alias("geometry")).transform(lambda d: d.join(cover_geometries(d, 6, 400), "geometry")).select("n_nationkey", F.array_join("cells", ",").alias(name), F.col("error").alias(f"{name}_error"))
    return made("disc", disc(20.0)).join(made("sliver", disc(0.2)), "n_nationkey").join(made("large", disc(400.0)), "n_nationkey")


def g04_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of an angle of half degrees beside each nation, by descent from coarse cells."""
    corner = lambda x, y: F.array(F.col("lon") + x, F.col("lat") + y)
    angles = _nations(spark, sf_dir).select(F.col("n_nationkey").alias("id"), F.array(F.array(*(corner(x, y) for x, y in [*ANGLE, ANGLE[0]]))).alias("rings"))
    return regions.cover_polygons(angles, 6).select(F.col("id").alias("n_nationkey"), h3bits.to_text("cell").alias("cell"))


def g03_corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _nations(spark, sf_dir)
    ring = n.withColumn("ring", sphere.corridor("lon", "lat", F.lit(10.0), F.lit(30.0), F.lit(48.0), F.lit(20.0)))
    return ring.select("n_nationkey", F.size("ring").alias("corners"), F.round(sphere.mean_distance_km(sphere.mean_position(F.col("ring")), F.col("ring")), 3).alias("mean_km"))


def s28_s34_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square degree around each nation as a region: its cells, middle and reach."""
    corner = lambda x, y: F.array(F.col("lon") + x, F.col("lat") + y)
    square = F.array(F.array(F.array(corner(-0.5, -0.5), corner(0.5, -0.5), corner(0.5, 0.5), corner(-0.5, 0.5), corner(-0.5, -0.5))))
    built = regions.build_regions(_nations(spark, sf_dir).select(F.concat(F.lit("ua-adm1:"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("x").alias("name"), square.alias("polygons")))
    return built.select("id", F.round("lon", 1).alias("lon"), "reach_km", F.size("cells").alias("n_cells"), "error")


# The same in SQL
_FACES = ", ".join(f"({n}, {lat!r}::DOUBLE, {lon!r}::DOUBLE, {axis!r}::DOUBLE)" for n, (lat, lon, axis) in enumerate(h3grid.FACES))
_ON_FACE = ", ".join(f"({face}, {i}, {j}, {base}, {turns})" for (face, (i, j)), (base, turns) in h3grid._ON_FACE.items())
_CROSSINGS = ", ".join(f"({face}, {edge}, {other}, {turns}, {i}, {j})" for (face, edge), (other, turns, (i, j)) in h3grid.CROSSINGS.items())
_PENTAGONS = ", ".join(f"({base}, {h3grid.BASES[base][0]})" for base in sorted(h3grid.PENTAGONS))
_LEFT = "[" + ", ".join(str(list(row)) for row in h3grid._LEFT) + "]"
_DIGIT = "CASE " + " ".join(f"WHEN {{0}} = {i} AND {{1}} = {j} THEN {d}" for d, (i, j) in enumerate(h3grid.STEPS)) + " END"
_TURNED = {n: h3grid._turned((1, 0), n) + h3grid._turned((0, 1), n) for n in range(6)}
_turn = lambda axis: "CASE turns " + " ".join(f"WHEN {n} THEN {t[axis]} * i + {t[axis + 2]} * j" for n, t in _TURNED.items()) + " END"


def cells_sql(rows: str, resolution: int) -> str:
    """``cells``: the cell of each (id, lon, lat) of a query, as text."""
    size, turn = 7 ** (resolution / 2), h3grid._TURN * (resolution % 2)
    steps, digits = [], []
    for r in range(resolution, 0, -1):
        a, b = ("3 * i - j", "i + 2 * j") if r % 2 else ("2 * i + j", "3 * j - i")
        di, dj = ("i - (2 * ui + uj)", "j - (3 * uj - ui)") if r % 2 else ("i - (3 * ui - uj)", "j - (ui + 2 * uj)")
        source = f"l{r + 1}" if r < resolution else "lattice"
        kept = "".join(f", d{d}" for d in digits)
        steps.append(f"l{r} AS (SELECT id, face, ui AS i, uj AS j, {_DIGIT.format(f'({di})', f'({dj})')} AS d{r}{kept} FROM (SELECT *, floor(({a} + 3) / 7.0)::BIGINT AS ui, floor(({b} + 3) / 7.0)::BIGINT AS uj FROM {source}))")
        digits.append(r)
    listed = ", ".join(f"d{r}" for r in sorted(digits))
    value = " + ".join(f"(turned[{r}]::BIGINT << {3 * (15 - r)})" for r in sorted(digits))
    fill = (1 << 3 * (15 - resolution)) - 1
    return f"""
faces(face, lat0, lon0, axis) AS (VALUES {_FACES}), on_face(face, i, j, base, turns) AS (VALUES {_ON_FACE}), crossings(face, edge, other, turns, si, sj) AS (VALUES {_CROSSINGS}), pentagons(base, home) AS (VALUES {_PENTAGONS}),
places AS (SELECT id, radians(lon) AS lon, radians(lat) AS lat FROM ({rows})),
seen AS (SELECT p.*, f.*, sin(lat0) * sin(lat) + cos(lat0) * cos(lat) * cos(lon - lon0) AS cosine FROM places p, faces f),
nearest AS (SELECT *, tan(acos(least(1.0, cosine))) / {h3grid.STEP!r} * {size!r} AS far, axis - atan2(cos(lat) * sin(lon - lon0), cos(lat0) * sin(lat) - sin(lat0) * cos(lat) * cos(lon - lon0)) - {turn!r} AS angle
    FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC) AS n FROM seen) WHERE n = 1),
plane AS (SELECT id, face, far * cos(angle) + far * sin(angle) / sqrt(3) AS i, far * sin(angle) * 2 / sqrt(3) AS j FROM nearest),
cube AS (SELECT *, round(i - j) AS q, round(j) AS r, round(-i) AS s FROM plane),
off AS (SELECT *, abs(q - (i - j)) AS dq, abs(r - j) AS dr, abs(s + i) AS ds FROM cube),
lattice AS (SELECT id, face, (CASE WHEN dq > dr AND dq > ds THEN -s WHEN dr > ds THEN -s ELSE q + r END)::BIGINT AS i, (CASE WHEN dq > dr AND dq > ds THEN r WHEN dr > ds THEN -q - s ELSE r END)::BIGINT AS j FROM off),
{', '.join(steps)},
around AS (SELECT *, least(i, j, 0) AS low FROM l1),
sides AS (SELECT *, i - low AS a, j - low AS b, -low AS c FROM around),
beyond AS (SELECT s.*, x.other, x.turns AS t, x.si, x.sj FROM sides s LEFT JOIN crossings x ON a + b + c > 2 AND x.face = s.face AND x.edge = CASE WHEN c = 0 THEN 0 WHEN a = 0 THEN 2 ELSE 1 END),
home AS (SELECT id, coalesce(other, face) AS face, {listed}, coalesce(t, 0) AS turned_by, CASE WHEN other IS NULL THEN i ELSE pi + si END AS i, CASE WHEN other IS NULL THEN j ELSE pj + sj END AS j
    FROM (SELECT *, {_turn(0).replace('turns', 't')} AS pi, {_turn(1).replace('turns', 't')} AS pj FROM beyond)),
based AS (SELECT h.*, o.base, (turned_by + o.turns) % 6 AS n, p.home FROM home h JOIN on_face o ON o.face = h.face AND o.i = h.i AND o.j = h.j LEFT JOIN pentagons p ON p.base = o.base),
first_turn AS (SELECT *, list_transform([{listed}], lambda d: {_LEFT}[n + 1][d + 1]) AS d0 FROM based),
second_turn AS (SELECT *, CASE WHEN home IS NOT NULL AND list_filter(d0, lambda d: d <> 0)[1] = 1 THEN list_transform(d0, lambda d: {_LEFT}[CASE WHEN face = home THEN 2 ELSE 6 END][d + 1]) ELSE d0 END AS turned FROM first_turn),
cells AS (SELECT id, base, (1::BIGINT << 59) + ({resolution}::BIGINT << 52) + (base::BIGINT << 45) + {value} + {fill} AS cell FROM second_turn)
"""


_CUSTOMERS = f"SELECT c_custkey AS id, {LON}::DOUBLE AS lon, {LAT}::DOUBLE AS lat FROM customer"
_AT_6 = cells_sql(_CUSTOMERS, 6)
_up = lambda cell, to: f"(({cell} & ~(15::BIGINT << 52)) | ({to}::BIGINT << 52) | {(1 << 3 * (15 - to)) - 1})"
_child = lambda cell, to, d: f"((({cell} & ~(15::BIGINT << 52)) | ({to}::BIGINT << 52)) & ~(7::BIGINT << {3 * (15 - to)}) | ({d}::BIGINT << {3 * (15 - to)}))"
_children = lambda cell, to: "[" + ", ".join(_child(cell, to, d) for d in range(7)) + "]"
_hex = lambda cells: f"array_to_string(list_sort(list_transform({cells}, lambda x: printf('%x', x))), ',')"

#: Points of both discs in a plane scaled at the middle latitude; a corner is a point with a gap of more than half a turn between the directions of two others.
_RIM = "degrees(asin(sin(radians(lat)) * cos(d) + cos(radians(lat)) * sin(d) * cos(t)))"
_CORRIDORS = f"""
WITH ends AS (SELECT n_nationkey AS id, e, CASE e WHEN 0 THEN 22 + 0.7 * n_nationkey ELSE 30.0 END AS lon, CASE e WHEN 0 THEN 44 + 0.3 * n_nationkey ELSE 48.0 END AS lat, CASE e WHEN 0 THEN 10.0 ELSE 20.0 END / {EARTH_KM} AS d, greatest(cos(radians((44 + 0.3 * n_nationkey + 48.0) / 2)), 1e-9) AS scale FROM nation, range(0, 2) r(e)),
rims AS (SELECT id, scale, lon + degrees(atan2(sin(t) * sin(d) * cos(radians(lat)), cos(d) - sin(radians(lat)) * sin(radians(y)))) AS x, y FROM (SELECT *, {_RIM} AS y FROM (SELECT *, i * 2 * pi() / 48 AS t FROM ends, range(0, 48) s(i)))),
points AS (SELECT DISTINCT id, scale, x * scale AS x, y FROM rims),
turns AS (SELECT p.id, p.scale, p.x, p.y, atan2(q.y - p.y, q.x - p.x) AS t FROM points p JOIN points q ON p.id = q.id AND (p.x <> q.x OR p.y <> q.y)),
gaps AS (SELECT *, coalesce(t - lag(t) OVER w, t + 2 * pi() - max(t) OVER (PARTITION BY id, x, y)) AS gap FROM turns WINDOW w AS (PARTITION BY id, x, y ORDER BY t)),
corners AS (SELECT id, x / any_value(scale) AS lon, y AS lat FROM gaps GROUP BY id, x, y HAVING max(gap) > pi() + 1e-9),
middles AS (SELECT id, avg(lon) AS mlon, avg(lat) AS mlat, count(*) AS n FROM corners GROUP BY id)
SELECT id AS n_nationkey, (any_value(n) + 1)::INT AS corners, round(greatest(1.0, avg(2 * {EARTH_KM} * asin(sqrt(pow(sin(radians(lat - mlat) / 2), 2) + cos(radians(lat)) * cos(radians(mlat)) * pow(sin(radians(lon - mlon) / 2), 2))))), 3) AS mean_km
FROM corners JOIN middles USING (id) GROUP BY id
"""

SQL: dict[str, str] = {
    "G03_corridors": _CORRIDORS,
    "G01_points": f"WITH {_AT_6} SELECT id AS c_custkey, printf('%x', cell) AS cells, NULL::VARCHAR AS error FROM cells",
    "G07_cell_ids": f"WITH {_AT_6} SELECT id AS c_custkey, printf('%x', cell) AS id, 6::INT AS resolution, base::INT AS base, true AS valid, false AS broken FROM cells",
    "G05_recast": f"WITH {_AT_6} SELECT id AS c_custkey, printf('%x', {_up('cell', 4)}) AS coarser, {_hex(_children('cell', 7))} AS finer, 'cover_too_large' AS many, 'invalid_geometry' AS wrong FROM cells",
    "G08_G09_compact": f"WITH {_AT_6} SELECT id AS c_custkey, CASE WHEN id % 2 = 0 THEN printf('%x', cell) ELSE {_hex(f'{_children('cell', 7)}[2:] || {_children(_child('cell', 7, 0), 8)}[2:]')} END AS cells FROM cells",
    "G12_profiles": f"WITH {cells_sql(_CUSTOMERS, 8)}, at_7 AS (SELECT * FROM ({'WITH ' + cells_sql(_CUSTOMERS, 7)} SELECT id, printf('%x', cell) AS broadcast FROM cells)) SELECT id AS c_custkey, broadcast, printf('%x', cell) AS proximity FROM cells JOIN at_7 USING (id)",
    "G06_expanded": "SELECT c_custkey, 7::INT AS ring_1, 19::INT AS ring_2, 7::BIGINT AS n_back FROM customer",
    "G10_centroids": f"SELECT c_custkey, true AS inside, true AS as_large FROM customer WHERE abs({LON}) < 179 AND abs({LAT}) < 80",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "G01_points": g01_points, "G01_G04_covers": g01_g04_covers, "G03_corridors": g03_corridors, "G04_descent": g04_descent, "G05_recast": g05_recast, "G06_expanded": g06_expanded, "G07_cell_ids": g07_cell_ids, "G08_G09_compact": g08_g09_compact,
    "G10_centroids": g10_centroids, "G12_profiles": g12_profiles, "S28_S34_regions": s28_s34_regions,
}
