"""Hard negatives and whitening against brute force and numpy, on odd, tied and skewed tables."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentria.llm import hard_negatives, queries, whitening
from sentria.llm._shared import table
from tests.oracle import SF

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_negatives(rows):
    """All results of the contract, row by row."""
    used = []
    for i, v, label in rows:
        if label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        used.append((i, [math.floor(256 * float(np.float32(c))) for c in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for at, (i, x, label) in enumerate(used):
        if i is None or i % 100:
            continue
        scores = [(dot(x, y), j, k) for n, (j, y, k) in enumerate(used) if n != at]
        for top, positive, _ in sorted((s for s in scores if s[2] == label), key=order)[:5]:
            inside = sorted((s for s in scores if s[2] != label and 80 * top <= 100 * s[0] <= 100 * top), key=order)[:5]
            out += [(i, positive, rank, j, top, score) for rank, (score, j, _) in enumerate(inside, 1)]
    return sorted(out, key=str)


def mined(spark, rows, extra="*"):
    vectors = spark.createDataFrame(rows, VECTORS).selectExpr(extra, "1 as row", "2 as x", "3 as g") if extra == "*" else spark.createDataFrame(rows, VECTORS)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.hard_negatives(vectors, moved, F.col("vec_id") % 100 == 0)
    return sorted((tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


def clustered(n, dims, seed, spread=0.2):
    """A third of the rows around one point, some equal to each other, labels at random."""
    rnd = random.Random(seed)
    middle = [rnd.gauss(0, 1) for _ in range(dims)]
    rows = []
    for i in range(n):
        v = [m + rnd.gauss(0, spread) for m in middle] if i % 3 == 0 else [rnd.gauss(0, 1) for _ in range(dims)]
        rows.append((i, middle if i % 10 == 0 else v, rnd.randrange(3)))
    return rows


@pytest.mark.parametrize(("n", "dims", "cells"), [(900, 8, 256), (700, 3, 4), (500, 5, 1)])
def test_negatives_by_brute_force(spark, monkeypatch, n, dims, cells):
    inner = hard_negatives.cut_points
    monkeypatch.setattr(hard_negatives, "cut_points", lambda rows, n, dims: inner(rows, n, dims, cells))
    rows = clustered(n, dims, cells)
    expected = plain_negatives(rows)
    assert len(expected) > 20 and mined(spark, rows) == expected


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [math.cos(i), math.sin(i), 0.5], i % 2) for i in range(0, 500, 5)]
    odd = [(1, None, 1), (2, [nan, 1.0, 1.0], 1), (3, [1.0, None, 1.0], 0), (4, [inf, 0.0, 0.0], 0), (6, [1.0, 0.0, 0.0], None), (None, [0.9, 0.1, 0.5], 0), (8, [], 1), (9, [0.5], 0), (100, [0.5, 0.5, 0.5], 1), (100, [0.5, 0.5, 0.5], 1)]
    assert mined(spark, good + odd) == plain_negatives(good + odd)
    assert mined(spark, odd[:6]) == [] and mined(spark, []) == []
    huge = [(0, [3e38, -3e38], 1), (1, [3e38, -3e38], 1), (2, [3e38, -2e38], 2)]
    top = 2 * hard_negatives.LARGEST**2
    assert mined(spark, huge) == [(0, 2, 1, 1, top, top)]


def test_bounds_hold_and_skip_most_rows():
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.standard_normal((4000, 16)) / 4).astype(np.int32)
    import pyarrow as pa

    from sentria.llm._shared import binary_rows

    cuts = np.ascontiguousarray(np.sort(x[:500], axis=0)[np.linspace(0, 500, 64, endpoint=False).astype(int)[1:]].T)
    cells = hard_negatives.coded(x, cuts)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(4000)), pa.array(np.arange(4000)), pa.array(np.zeros(4000, np.int64)), binary_rows(x), binary_rows(cells.T)], names=["row", "id", "label", "x", "cells"])
    group = hard_negatives.Group([batch], cuts)
    q = group.x[:20].astype(np.int64)
    lower, upper = group.bounds(q, 0, 4000)
    exact = q @ group.x.T.astype(np.int64)
    assert (lower <= exact).all() and (exact <= upper).all()
    scored = []
    group.scored = lambda at, one: scored.append(len(at)) or group.x[at].astype(np.int64) @ one
    found = list(hard_negatives.positives_in(group, group.row[:20], 0, q, 5))
    assert len(found) == 100 and max(scored) < 400, "bounds leave too many rows"
    wide = group.bounds(q << 30, 0, 10)[0]
    assert wide.dtype == np.int64 and (wide <= exact[:, :10] << 30).all()


def plain_whitening(rows, k=16):
    dims = max((len(v) for _, v, _ in rows if v), default=0)
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] + [1_000_000] * (dims - len(v))) for i, v, _ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[x - s / n for x, s in zip(row, sums, strict=True)] for row in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return kept, n, sums, values[::-1][:k], vectors[:, ::-1][:, :k], values.sum()


def held(got, rows, k=16):
    kept, n, sums, values, vectors, trace = plain_whitening(rows, k)
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(got) == len(kept) * len(values)
    for i, x in kept:
        off = np.array([a - s / n for a, s in zip(x, sums, strict=True)])
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        for c in range(len(values)):
            r = by_id[i][c + 1]
            assert r["n"] == n and r["deviation"] == deviation and math.isclose(r["explained"], values[c] / trace, rel_tol=1e-9)
            assert math.isclose(abs(r["whitened"]), abs(off @ vectors[:, c]) / math.sqrt(values[c]), abs_tol=1e-7) and r["identity_error"] < 1e-9
        # one sign for all rows
    for c in range(len(values)):
        signs = {np.sign(by_id[i][c + 1]["whitened"] * ((np.array(x) - np.array(sums) / n) @ vectors[:, c])) for i, x in kept if abs(by_id[i][c + 1]["whitened"]) > 1e-6}
        assert len(signs) == 1


def test_whitening_of_the_given_table(spark):
    rows = [tuple(r) for r in table(spark, SF, "embeddings").select("vec_id", "embedding", "label").collect()]
    held(queries.op12_whitening(spark, SF).collect(), rows)


def test_whitening_iterates_in_many_dimensions(spark):
    """More dimensions than the blocks span, with close eigenvalues at the edge of the wanted ones."""
    rng = np.random.default_rng(4)
    turn = np.linalg.qr(rng.standard_normal((400, 400)))[0]
    x = (rng.standard_normal((3000, 400)) * np.linspace(2, 1, 400)) @ turn.T
    x = np.vstack([x, x[:1000]])
    vectors = spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(x)], VECTORS)
    integers, dims = whitening.integer_vectors(vectors, "vec_id", "embedding", 64)
    fitted = whitening.fit_components(integers.select("v").distinct(), dims, 16, 32)
    whole = np.floor(64 * x[:3000].astype(np.float32).astype(float))
    whole -= whole.mean(axis=0)
    values, components = np.linalg.eigh(whole.T @ whole / 3000)
    assert fitted.n == 3000 and 2 < fitted.passes < 60 and (fitted.residuals <= 1e-12 * values[-1]).all()
    assert np.allclose(fitted.eigenvalues, values[::-1][:16], rtol=1e-12)
    assert np.abs(np.abs(fitted.components.T @ components[:, ::-1][:, :16]) - np.eye(16)).max() < 1e-9


def test_whitening_of_odd_rows(spark):
    nan = float("nan")
    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)], 0) for i in range(40)] + [(50, [0.25, 0.5], 0), (51, [], 0)]
    odd = [(60, None, 0), (61, [nan, 1.0, 1.0, 1.0], 0), (62, [1.0, None, 1.0, 1.0], 0)]
    copies = [(100 + i, rows[0][1], 0) for i in range(200)]
    vectors = spark.createDataFrame(rows + odd + copies, VECTORS).selectExpr("*", "1 as v", "2 as n", "3 as component")
    held(whitening.whiten(vectors).collect(), rows + copies, 4)
    assert whitening.whiten(vectors.limit(0)).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (None, [1.0, 2.0], 0)], VECTORS)
    assert whitening.whiten(one).count() == 0, "a single distinct vector has no variance"
    three = spark.createDataFrame([(1, [1.0, 2.0, 0.0, 0.0, 5.0], 0), (2, [2.0, 2.0, 1.0, 0.0, 5.0], 0), (None, [0.0, 7.0, 0.0, 1.0, 5.0], 0)], VECTORS)
    got = whitening.whiten(three).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == [(i, c) for i in (0, 1, 2) for c in (1, 2)] and all(r["identity_error"] < 1e-9 for r in got)
    huge = whitening.whiten(spark.createDataFrame([(1, [3e38, 0.0], 0), (2, [-3e38, 1.0], 0), (3, [0.0, 7.0], 0)], VECTORS)).collect()
    assert {(r["vec_id"], r["deviation"]) for r in huge} == {(1, None), (2, None), (3, 692224)}
