"""Covers by descent against the cells found one by one."""

from __future__ import annotations

import math
import random

import pytest

from sentria.functions import h3grid, shapes
from sentria.operators import regions


def star(rnd, lon, lat, km, corners):
    """A ring of corners at random distances."""
    ring = []
    for i in range(corners):
        t, r = 2 * math.pi * i / corners, km * rnd.uniform(0.3, 1) / 111.2
        ring.append((lon + r * math.cos(t) / max(0.2, math.cos(math.radians(lat))), lat + r * math.sin(t)))
    return [*ring, ring[0]]


def small(ring, by):
    x, y = (sum(p[k] for p in ring[:-1]) / (len(ring) - 1) for k in (0, 1))
    return [(x + (p[0] - x) * by, y + (p[1] - y) * by) for p in ring]


def test_descent_equals_cells_one_by_one(spark):
    rnd = random.Random(7)
    made = {}
    for n in range(12):
        outer = star(rnd, rnd.uniform(-150, 150), rnd.uniform(-65, 65), rnd.choice([40, 120, 300]), rnd.choice([3, 5, 12, 40]))
        made[n] = [outer] if n % 3 else [outer, small(outer, 0.4)]
    made[20] = [star(rnd, 179.0, 10.0, 90, 9)]
    made[21] = [[(0.0, 0.0), (3.0, 0.0), (3.0, 2.0), (0.0, 2.0), (0.0, 0.0)]]
    made[22] = [[(0.0, 0.0), (0.001, 0.0), (0.001, 0.001), (0.0, 0.0)]]
    rows = [(n, [[list(map(float, p)) for p in ring] for ring in rings]) for n, rings in made.items()] + [(30, [[[0.0, 0.0], [1.0, 1.0]]]), (31, None)]
    table = spark.createDataFrame(rows, "id int, rings array<array<array<double>>>")
    got = {}
    for r in regions.cover_polygons(table, 6).collect():
        got.setdefault(r["id"], []).append(r["cell"])
    for n, rings in made.items():
        expected = {c for c in shapes.polygon(rings, 6, 10**6) if shapes._inside(rings, *h3grid.center_of(c))}
        assert len(got.get(n, [])) == len(set(got.get(n, []))) and set(got.get(n, [])) == expected, n
    assert not {22, 30, 31} & set(got) and max(map(len, got.values())) > 1500


@pytest.mark.parametrize("levels", [1, 3])
def test_work_follows_the_boundary(spark, levels):
    """Cells inside are never split: the rows of a level are those near the boundary, and the inside is made whole."""
    ring = [[10.0, 40.0], [16.0, 40.0], [16.0, 46.0], [10.0, 46.0], [10.0, 40.0]]
    table = spark.createDataFrame([(1, [ring])], "id int, rings array<array<array<double>>>")
    found = {r["cell"] for r in regions.cover_polygons(table, 5, levels).collect()}
    assert found == shapes.polygon([[tuple(p) for p in ring]], 5, 10**6)
    coarse = shapes.coarse_cells([[tuple(p) for p in ring]], 3)
    assert any(inside and not near for _, inside, near in coarse)
