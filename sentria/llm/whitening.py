"""Whitening of embeddings by matrix-free block subspace iteration.

Entries become integers x. The fit list holds each distinct vector once; its
size n and sums S are exact. The covariance V of the fit list is never
formed: a Spark pass multiplies it with a block Q of ``BLOCK`` columns, as the
sum of (x - S/n) times ((x - S/n) Q) over all rows, each task returning one
matrix of dimensions by columns. The product is orthonormalised against the
blocks before (QR), and a Rayleigh-Ritz step over all of these gives approximate
components with their residuals |Vu - eu|. The next block are the residuals of the
foremost approximations. Keeping the earlier blocks (up to ``KEPT`` of them, then the
foremost approximations only) makes close eigenvalues converge in far fewer
passes than powers of one block; that is the only difference from the plain iteration.
It ends when the residuals of all wanted components are at most ``RESIDUAL`` times the
greatest eigenvalue, or, since it may be that nothing is left to add, when the blocks span the whole space.

A last pass measures the covariance of the whitened fit list itself.

Defined cases: rows whose vector is null or holds null or non-finite entries are
dropped; shorter vectors count as filled up with zeros; entries beyond 2**46 count as
2**46; rows without an id keep theirs, and repeated rows each keep a row;
eigenvalues that are zero next to the first (fewer distinct vectors than
components, constant or dependent dimensions) give no component, so that
a single distinct vector or an empty table gives no rows; a deviation that exceeds a long
is null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import finite_vectors, written

SCALE, OFFSET = 64, 1_000_000
LARGEST = 1 << 52
COMPONENTS = 16
BLOCK = 32
#: Blocks that a Rayleigh-Ritz step may combine.
KEPT = 8
RESIDUAL = 1e-12
#: An eigenvalue counts as zero below this part of the first.
ZERO = 1e-11
PASSES = 200

ROW = "vec_id long, v binary"
_ROW = pa.schema([("vec_id", pa.int64()), ("v", pa.binary())])
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_WHITENED = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


class NotConverged(RuntimeError):
    """The residuals didn't fall below the bound in ``PASSES`` passes."""


class Fitted(NamedTuple):
    n: int
    sums: list[int]  # of x without the offset
    components: np.ndarray  # columns
    eigenvalues: np.ndarray
    residuals: np.ndarray
    trace: float
    identity_error: float
    passes: int


def _packed(row: np.ndarray) -> bytes:
    """The integers in the fewest bytes that all of them fit in, after one byte that says how many: equal rows have equal bytes."""
    most = int(np.abs(row).max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - 1))
    return bytes([width]) + row.astype(f"<i{width}").tobytes()


def _unpacked(column: pa.Array, dims: int) -> np.ndarray:
    """The integers of all rows, as 64-bit numbers."""
    values = column.to_pylist()
    out = np.empty((len(values), dims), np.int64)
    widths = np.frombuffer(bytes(v[0] for v in values), np.uint8)
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        out[at] = np.frombuffer(b"".join(values[i][1:] for i in at.tolist()), f"<i{width}").reshape(len(at), dims)
    return out


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> tuple[DataFrame, int]:
    """``vec_id, v`` of the remaining rows, written; and the number of dimensions."""
    dims = max(1, vectors.agg(F.max(F.size(vector_col))).first()[0] or 0)

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, rows = finite_vectors(batch.column(1), dims)
            x = np.clip(np.floor(rows[ok] * scale), -LARGEST, LARGEST).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), pa.array([_packed(r) for r in x], pa.binary())], schema=_ROW)

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).filter("v is not null")
    return written(rows.mapInArrow(scaled, ROW), "integer-vectors"), dims


def _totals(fit: DataFrame, dims: int) -> tuple[int, list[int], int]:
    """Rows, sums by dimension, and the sum of all squares, exactly."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, squares, sums = 0, 0, [0] * dims
        for batch in batches:
            x = _unpacked(batch.column(0), dims)
            if int(np.abs(x).max(initial=0)) < 1 << 20:
                part, square = x.sum(axis=0).tolist(), int((x * x).sum())
            else:
                part, square = x.astype(object).sum(axis=0).tolist(), int((x.astype(object) ** 2).sum())
            n, squares, sums = n + len(x), squares + square, [a + b for a, b in zip(sums, part, strict=True)]
        if n:
            values = [n, squares, *sums]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))], names=["at", "value"])

    found = {r["at"]: int(r["value"]) for r in fit.mapInArrow(add, "at int, value decimal(38,0)").groupBy("at").agg(F.sum("value").alias("value")).collect()}
    return found.get(0, 0), [found.get(d + 2, 0) for d in range(dims)], found.get(1, 0)


def _summed(fit: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int], dims: int) -> np.ndarray:
    """The sum over all rows of ``part`` of a batch of vectors, a matrix of this shape; each task sends its own sum, row by row."""
    height, width = shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if len(batch):
                total += part(_unpacked(batch.column(0), dims))
        yield pa.RecordBatch.from_arrays([pa.array(range(height), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["at", "row"])

    rows = fit.mapInArrow(add, "at int, row array<double>").groupBy("at").agg(*(F.sum(F.get("row", F.lit(i))).alias(f"c{i}") for i in range(width)))
    out = np.zeros(shape)
    for r in rows.collect():  # dimensions by columns of the block
        out[r["at"]] = r[1:]
    return out


def fit_components(fit: DataFrame, dims: int, k: int = COMPONENTS, block: int = BLOCK, residual: float = RESIDUAL, seed: int = 1) -> Fitted | None:
    """The first components of the covariance of the distinct rows ``v``; None if there are no rows."""
    n, sums, squares = _totals(fit, dims)
    if not n:
        return None
    centre = np.array([s / n for s in sums])
    trace = (n * squares - sum(s * s for s in sums)) / (n * n)
    block = min(max(block, k), dims)
    rng = np.random.default_rng(seed)
    fresh = np.linalg.qr(rng.standard_normal((dims, block)))[0]
    basis, image = np.zeros((dims, 0)), np.zeros((dims, 0))
    for made in range(1, PASSES + 1):

        def product(x: np.ndarray, q: np.ndarray = fresh) -> np.ndarray:
            centred = x - centre
            return centred.T @ (centred @ q)

        basis, image = np.hstack([basis, fresh]), np.hstack([image, _summed(fit, product, fresh.shape, dims) / n])
        small = basis.T @ image
        values, turned = np.linalg.eigh((small + small.T) / 2)
        values, turned = values[::-1], turned[:, ::-1]
        ritz = basis @ turned
        left = image @ turned - ritz * values
        norms = np.linalg.norm(left, axis=0)
        if (norms[:k] <= residual * max(values[0], 0)).all():
            break
        if basis.shape[1] + block > KEPT * block:
            basis, image = ritz[:, : 2 * block], image @ turned[:, : 2 * block]
        fresh = _orthonormal(left[:, : min(block, dims - basis.shape[1])], basis)
        if not fresh.shape[1]:
            break
    else:
        raise NotConverged(f"residuals are {norms[:k].max()} after {PASSES} passes")
    kept = int((values[:k] > ZERO * max(values[0], 0)).sum()) if values[0] > 0 else 0
    components = np.linalg.qr(ritz[:, :kept])[0] if kept else ritz[:, :0]
    components *= np.sign(components[np.abs(components).argmax(axis=0), np.arange(kept)])
    return Fitted(n, sums, components, values[:kept], norms[:kept], trace, _identity_error(fit, dims, n, centre, components, values[:kept]), made)


def _orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the block adds to ``basis``; columns that add nothing but rounding are left out."""
    sizes = np.linalg.norm(block, axis=0)
    block = block[:, sizes > 0] / sizes[sizes > 0]
    out = np.zeros((len(basis), 0))
    for column in block.T:
        for _ in range(3):
            column = column - basis @ (basis.T @ column) - out @ (out.T @ column)
            size = np.linalg.norm(column)
            if size < 1e-10:
                break
            column = column / size
        else:
            out = np.hstack([out, column[:, None]])
    return out


def _identity_error(fit: DataFrame, dims: int, n: int, centre: np.ndarray, components: np.ndarray, values: np.ndarray) -> float:
    """The largest entry by which the covariance of the whitened fit list, measured in a pass, differs from the identity."""
    k = len(values)
    if not k:
        return 0.0
    turn = components / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = np.hstack([(x - centre) @ turn, np.ones((len(x), 1))])
        return w.T @ w

    both = _summed(fit, moments, (k + 1, k + 1), dims) / n
    covariance = both[:k, :k] - np.outer(both[:k, k], both[:k, k])
    return float(np.abs(covariance - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of (n x - S)^2; null beyond a long."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if len(sums) * most * most < 1 << 63:
        off = n * x - np.array(sums, np.int64)
        return (off * off).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1).tolist()
    return [d if d < 1 << 63 else None for d in exact]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """Per remaining row and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    rows, dims = integer_vectors(vectors, id_col, vector_col, scale)
    fitted = fit_components(written(rows.select("v").distinct(), "fit-list"), dims, min(k, dims), block)
    if fitted is None or not len(fitted.eigenvalues):
        return vectors.sparkSession.createDataFrame([], WHITENED)
    kept, centre = len(fitted.eigenvalues), np.array([s / fitted.n for s in fitted.sums])
    turn, explained = fitted.components / np.sqrt(fitted.eigenvalues), fitted.eigenvalues / fitted.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unpacked(batch.column(1), dims)
            m = len(x)
            each = np.repeat(np.arange(m), kept)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)), pa.array(np.full(m * kept, fitted.n)), pa.array(_deviations(x, fitted.n, fitted.sums), pa.int64()).take(pa.array(each)),
                pa.array(((x - centre) @ turn).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * kept, fitted.identity_error)),
            ], schema=_WHITENED)

    return rows.mapInArrow(project, WHITENED)
