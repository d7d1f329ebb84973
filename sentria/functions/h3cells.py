"""H3 on columns: positions to cells and back, discs and centroids, in Arrow batches. Cells are longs; ``h3bits`` has their algebra."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from . import h3arrays, h3grid

# Arrow and not pandas: a column of longs with nulls would become one of floats, which don't hold a cell.
_POSITION, _CIRCLE = ["lon", "lat"], ["lon", "lat", "radius_km"]


def _spread(values: np.ndarray, at: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """An array of ``n`` with values at some places and nulls elsewhere."""
    out, missing = np.zeros(n, dtype=values.dtype), np.ones(n, dtype=bool)
    out[at], missing[at] = values, False
    return pa.array(out, kind, mask=missing)


def _structs(names: list[str], values: list[np.ndarray], at: np.ndarray, n: int) -> pa.Array:
    missing = np.ones(n, dtype=bool)
    missing[at] = False
    return pa.StructArray.from_arrays([_spread(v, at, n, pa.float64()) for v in values], names, mask=pa.array(missing))


def _listed(cells: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows whose lists are there and hold no null; then row and cell of each of their items."""
    items, rows = cells.flatten(), np.asarray(cells.value_parent_indices(), dtype=np.int64)
    whole = np.asarray(cells.is_valid())
    whole[rows[np.asarray(items.is_null(), dtype=bool)]] = False
    kept = whole[rows]
    return np.flatnonzero(whole), rows[kept], np.asarray(items.fill_null(0), dtype=np.int64)[kept]


@F.arrow_udf(LongType())
def cell_of(lon: pa.Array, lat: pa.Array, resolution: pa.Array) -> pa.Array:
    """The cell of a position; null for none."""
    x, y = (np.asarray(a.cast(pa.float64()).fill_null(np.nan)) for a in (lon, lat))
    r = np.asarray(resolution.cast(pa.int64()).fill_null(-1))
    out, known = np.zeros(len(x), dtype=np.int64), (np.abs(x) <= 180) & (np.abs(y) <= 90) & (r >= 0) & (r <= h3grid.MAX_RESOLUTION)
    for size in np.unique(r[known]):
        at = np.flatnonzero(known & (r == size))
        out[at] = h3arrays.cells_of(x[at], y[at], int(size))
    return pa.array(out, pa.int64(), mask=~known)


@F.arrow_udf(StructType([StructField(n, DoubleType()) for n in _POSITION]))
def center_of(cell: pa.Array) -> pa.Array:
    at = np.flatnonzero(np.asarray(cell.is_valid()))
    return _structs(_POSITION, list(h3arrays.centers_of(np.asarray(cell.drop_null(), dtype=np.int64))), at, len(cell))


@F.arrow_udf(ArrayType(LongType()))
def disk(cells: pa.Array, rings: pa.Array) -> pa.Array:
    """Cells and those up to so many steps away, in order."""
    whole, rows, items = _listed(cells)
    rows, found = h3arrays.disks(rows, items, np.asarray(rings.cast(pa.int64()).fill_null(0)))
    ends = np.searchsorted(rows, np.arange(len(cells) + 1))
    missing = np.ones(len(cells), dtype=bool)
    missing[whole] = False
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found, pa.int64()), mask=pa.array(missing))


@F.arrow_udf(StructType([StructField(n, DoubleType()) for n in _CIRCLE]))
def centroid(cells: pa.Array) -> pa.Array:
    """The mean center of cells, and the radius of a circle as large as they are."""
    _, rows, items = _listed(cells)
    rows, items = h3arrays.disks(rows, items, np.zeros(len(cells), dtype=np.int64))
    at, first, n = np.unique(rows, return_index=True, return_counts=True)
    total = lambda values: np.add.reduceat(values, first) if len(first) else values
    lon, lat = h3arrays.centers_of(items)
    return _structs(_CIRCLE, [total(lon) / n, total(lat) / n, np.sqrt(total(h3arrays.areas_km2(items)) / np.pi)], at, len(cells))
