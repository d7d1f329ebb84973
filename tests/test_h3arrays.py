"""Cells on arrays against those one by one, and compacting by digits."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentria.functions import h3arrays, h3cells, h3grid
from sentria.operators import regions


@pytest.mark.parametrize("resolution", [0, 1, 3, 6, 11])
def test_arrays_equal_cells_one_by_one(resolution):
    rnd = np.random.default_rng(resolution)
    lon, lat = rnd.uniform(-180, 180, 600), np.degrees(np.arcsin(rnd.uniform(-1, 1, 600)))
    cells = h3arrays.cells_of(lon, lat, resolution)
    assert cells.tolist() == [h3grid.cell_of(x, y, resolution) for x, y in zip(lon.tolist(), lat.tolist(), strict=True)]
    pentagons = [h3grid._made(base, [0] * resolution) for base in sorted(h3grid.PENTAGONS)]
    listed = sorted(set(cells.tolist()) | h3grid.disk(pentagons, 2))
    cells = np.array(listed)
    assert [set(r) for r in h3arrays.neighbours(cells).tolist()] == [set(h3grid.neighbours(c)) for c in listed]
    assert np.allclose(np.stack(h3arrays.centers_of(cells), 1), [h3grid.center_of(c) for c in listed], atol=1e-9)
    assert np.allclose(h3arrays.areas_km2(cells[::5]), [h3grid.area_km2(c) for c in listed[::5]], rtol=1e-6)


def test_columns_of_mixed_resolutions_and_nulls(spark):
    """One call of arrays a batch; what is null, or holds a null, stays null."""
    one, two = h3grid.cell_of(10.0, 50.0, 6), h3grid.cell_of(-30.0, -70.0, 3)
    rows = [(1, [one, one], 1), (2, [one, two], 2), (3, None, 1), (4, [one, None], 1), (5, [], 1), (6, [two], 0)]
    got = spark.createDataFrame(rows, "id int, cells array<long>, k int").coalesce(1).select("id", h3cells.disk("cells", "k").alias("d"), h3cells.centroid("cells").alias("c"), h3cells.center_of(F.get("cells", F.lit(0))).alias("m"))
    found = {r["id"]: r for r in got.collect()}
    for n, cells, k in rows:
        whole = cells is not None and None not in cells
        assert found[n]["d"] == (sorted(h3grid.disk(cells, k)) if whole else None)
        assert (found[n]["c"] is not None) == bool(whole and cells)
        assert (found[n]["m"] is not None) == bool(cells)


def test_compacted_by_digits_shuffles_once(spark):
    """Pentagons have six children, base cells no parent, and a key's rows are dealt once for all levels."""
    pentagon, cell = h3grid._made(4, [0, 0]), h3grid.cell_of(10.0, 50.0, 2)
    rows = [(1, c) for c in h3grid.children_of(pentagon, 4)] + [(2, c) for c in h3grid.children_of(cell, 4)[1:]] + [(3, h3grid._made(7, []))] + [(1, h3grid.children_of(pentagon, 4)[0])]
    table = regions.compacted(spark.createDataFrame(rows, "id int, cell long"), "id", 2)
    got = {}
    for r in table.collect():
        got.setdefault(r["id"], []).append(r["cell"])
    first, *others = h3grid.children_of(cell, 3)
    assert got[1] == [pentagon] and got[3] == [h3grid._made(7, [])]
    assert sorted(got[2]) == sorted(others + h3grid.children_of(first, 4)[1:])
    assert table._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_rings_beside_a_pentagon():
    """The customer at which G06 differs from constants at 60 times the customers: two rings hold 18 cells there."""
    cell = h3grid.cell_of(-67.13, 23.67, 6)
    near = [c for c in h3grid.disk([cell], 2) if h3grid.is_pentagon(c)]
    assert len(near) == 1 and len(h3grid.disk([cell], 1)) == 7 and len(h3grid.disk([cell], 2)) == 18 and len(h3grid.neighbours(near[0])) == 5
