"""Joins by levels against all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sentria.functions import h3grid
from sentria.operators import lookups


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed", range(3))
def test_moments_in_intervals(spark, seed):
    rnd = random.Random(seed)
    span = 2**40
    moments = [(i, rnd.choice("ab"), None if i % 50 == 0 else rnd.randrange(-span, span)) for i in range(400)]
    intervals = []
    for j in range(150):
        start = rnd.randrange(-span, span)
        intervals.append((j, rnd.choice("ab"), start, start + rnd.choice([0, 1, 2**20 - 1, 2**20, rnd.randrange(2**30), rnd.randrange(2**40), -5])))
    # ends that fall on moments
    intervals += [(900 + i, k, t - 7, t) for i, k, t in moments[1:9]] + [(950 + i, k, t, t) for i, k, t in moments[1:9]] + [(999, "a", None, 5)]
    m, i = spark.createDataFrame(moments, "m long, k string, at long"), spark.createDataFrame(intervals, "i long, k string, first long, last long")
    got = lookups.at_times(m, i, "at", "first", "last", ("k",))
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)
    expected = sorted((a, b) for a, k, at in moments for b, j, first, last in intervals if at is not None and first is not None and k == j and first <= at <= last)
    assert sorted((r["m"], r["i"]) for r in got.collect()) == expected and len(expected) > 100
    assert lookups.at_times(m, i.limit(0), "at", "first", "last", ("k",)).count() == 0


def test_a_hot_key_of_long_intervals_stays_small(spark):
    """An interval is sent to two buckets at most, however long it is."""
    intervals = spark.range(200).select(F.lit("k").alias("k"), F.lit(0).cast("long").alias("first"), (F.lit(1).cast("long") * 2**41 + F.col("id")).alias("last"))
    got = lookups.at_times(spark.createDataFrame([("k", 5), ("k", 2**41 + 100)], "k string, at long"), intervals, "at", "first", "last", ("k",))
    assert got.count() == 200 + 100


def test_cells_in_covers(spark):
    rnd = random.Random(4)
    cells = [h3grid.cell_of(rnd.uniform(20, 40), rnd.uniform(44, 52), 7) for _ in range(300)]
    covers = [(i % 9, h3grid.parent_of(c, rnd.choice([2, 3, 4, 6, 7]))) for i, c in enumerate(cells[:60])]
    covers += covers[:10] + [(1, h3grid.children_of(cells[0], 8)[0]), (2, None)]
    points = spark.createDataFrame([(n, c) for n, c in enumerate(cells)] + [(999, None)], "n long, cell long")
    table = spark.createDataFrame(covers, "owner long, cover_cell long")
    outer = lookups.outermost(table.filter("cover_cell is not null"), ("owner",))
    held = lambda outer, inner: h3grid.resolution_of(outer) <= h3grid.resolution_of(inner) and h3grid.parent_of(inner, h3grid.resolution_of(outer)) == outer
    known = {(o, c) for o, c in covers if c is not None}
    known = {(o, c) for o, c in known if not any(o == p and c != d and held(d, c) for p, d in known)}
    assert {tuple(r) for r in outer.select("owner", "cover_cell").collect()} == known and outer.count() == len(known)
    got = lookups.in_covers(points, outer)
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)
    assert sorted((r["n"], r["owner"]) for r in got.collect()) == sorted((n, o) for n, c in enumerate(cells) for o, d in known if held(d, c))
    assert lookups.in_covers(points, table.limit(0)).count() == 0
    with pytest.raises(ValueError, match="both sides"):
        lookups.in_covers(points, table.withColumn("n", F.lit(1)))
