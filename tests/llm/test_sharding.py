"""The uniform shuffle: exact sizes, whole rows, and its law on small inputs."""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import accumulate, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentria.llm import queries, sharding
from sentria.llm._shared import table
from tests.llm.test_operators import ODD, docs
from tests.oracle import SF


def check_places(got, n, shards):
    counts = Counter(r["shard"] for r in got)
    assert sum(counts.values()) == n == len(got) and {counts.get(s, 0) for s in range(shards)} <= {n // shards, n // shards + (n % shards > 0)}
    for s in range(shards):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts.get(s, 0)))


def test_query_on_the_given_table(spark):
    got = queries.op13_sharding(spark, SF).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in table(spark, SF, "documents").collect()}
    check_places(got, len(texts), 16)
    assert {(r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in got} == {(i, len(t) + 1, zlib.crc32(t), "rows", None) for i, t in texts.items()}
    again = queries.op13_sharding(spark, SF).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in got}


@pytest.mark.parametrize(("part_bits", "bucket_rows"), [(18, 262_144), (3, 4), (0, 1)])
def test_small_parts_and_buckets(spark, part_bits, bucket_rows):
    rows = docs(spark, *[f"t{i % 7}" for i in range(203)]).repartition(5)
    got = sharding.sharded(rows, 16, 7, part_bits, bucket_rows)
    assert got.columns == [*rows.columns, "shard", "slot"]
    got = got.collect()
    check_places(got, 203, 16)
    assert sorted(r["doc_id"] for r in got) == list(range(203))


def test_odd_tables(spark):
    rows = docs(spark, *ODD, *ODD, ids=[None, *range(9), None, *range(9)]).selectExpr("*", "1 as shard", "2 as place", "3 as part", "4 as bucket")
    got = sharding.sharded(rows, 3, 1)
    assert got.columns == [*rows.columns, "_shard", "slot"]
    check_places([{"shard": r["_shard"], "slot": r["slot"]} for r in got.collect()], 20, 3)
    assert sorted(map(str, got.select(*rows.columns).collect())) == sorted(map(str, rows.collect()))
    assert sharding.sharded(rows.limit(0)).count() == 0 and sharding.sharded(docs(spark, "one")).count() == 1


def test_written_shards(spark, tmp_path):
    path = sharding.write_shards(table(spark, SF, "documents"), str(tmp_path / "s"), 4)
    got = spark.read.parquet(path)
    check_places(got.collect(), 200, 4)
    files = got.withColumn("file", F.input_file_name()).withColumn("at", F.monotonically_increasing_id()).orderBy("at").collect()
    for name in {r["file"] for r in files}:
        slots = [r["slot"] for r in files if r["file"] == name]
        assert slots == sorted(slots)


def placed(parts, shards, bucket_rows, seed):
    """The operator's own steps on a list of parts, as one order of all rows."""
    starts = [0, *accumulate(map(len, parts))]
    sizes = sharding.bucket_sizes(starts[-1], shards, bucket_rows)
    buckets = [[] for _ in sizes]
    for i, part in enumerate(parts):
        row = sharding.matrix_row(i, starts, sizes, seed)
        assert row.sum() == len(part) and (row >= 0).all()
        to = np.random.default_rng([seed, 1, i]).permutation(np.repeat(np.arange(len(sizes)), row))
        for item, b in zip(part, to.tolist(), strict=True):
            buckets[b].append(item)
    rng = np.random.default_rng([seed, 2])
    return tuple(x for b in buckets for x in rng.permutation(b).tolist())


@pytest.mark.parametrize(("parts", "bucket_rows"), [([[0, 1], [2, 3]], 9), ([[0], [1, 2], [3]], 1), ([[0, 1, 2], [3]], 2)])
def test_all_orders_are_equally_likely(parts, bucket_rows):
    n = 6000
    counts = Counter(placed(parts, 2, bucket_rows, seed) for seed in range(n))
    expected = n / 24
    assert set(counts) <= set(permutations(range(4)))
    chi2 = sum((counts.get(p, 0) - expected) ** 2 / expected for p in permutations(range(4)))
    assert chi2 < 50, f"{chi2} with 23 degrees of freedom"


def test_matrix_adds_up():
    starts = [0, *accumulate([5, 0, 17, 1, 300, 4])]
    places = sharding.bucket_sizes(starts[-1], 4, 30)
    rows = [sharding.matrix_row(i, starts, places, 9) for i in range(6)]
    assert (sum(rows) == places).all() and [int(r.sum()) for r in rows] == [5, 0, 17, 1, 300, 4]


def test_large_populations():
    rng = np.random.default_rng(1)
    good, bad, n = 40, 60, 30
    got = Counter(sharding._rejected(rng, good, bad, n) for _ in range(20_000))
    known = Counter(np.random.default_rng(2).hypergeometric(good, bad, n, 20_000).tolist())
    assert max(abs(got[k] - known[k]) for k in range(31)) < 320
    places = np.full(8, 2_000_000_000, np.int64)
    drawn = sharding.drawn(rng, places, 5_000_000_000)
    assert drawn.sum() == 5_000_000_000 and np.abs(drawn - 625_000_000).max() < 8 * 20_000 and len(set(drawn.tolist())) == 8
