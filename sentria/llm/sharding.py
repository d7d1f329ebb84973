"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

The law is ``rows``: counts of the shards differ by one at most. The places of the
shuffled order are cut into buckets of bounded size, each within one shard, and
the rows into parts of bounded size, each within one input partition. Of a uniform
permutation, the numbers of rows that go from each part to each bucket follow
a multivariate hypergeometric law, and given them, which rows go and where in
the bucket they end is uniform. So

1. the counts of this matrix are drawn. A part's own row of it is found by
   going down a tree over the parts: at each node the places left are divided
   between the two halves by one multivariate hypergeometric draw, seeded by the node.
   No task and no driver holds more than one row of the matrix.
2. each part is permuted locally, and the first rows of the permutation go to the
   first bucket, the next ones to the second, and so on.
3. rows are exchanged by bucket, and permuted again there.

Every draw is a function of the seed and of a place in the input, which is written
first: tasks that run again give the same rows. Rows that are equal, or share a text, are rows of
their own and are dealt as such; hot texts don't meet, since nothing is keyed by content.

Defined cases: null texts are empty; null and repeated ids are rows like
others; fewer rows than shards leave shards empty; an empty table gives no rows; all
columns are passed on, and those of the result get names that are not taken if
a column is called like them.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import fresh_dir, spare, written

SHARDS = 16
SEED = 20_250
#: Rows of a part and of a bucket at most: 2**PART_BITS, and BUCKET_ROWS.
PART_BITS, BUCKET_ROWS = 18, 262_144
#: From this population on, draws are made by ``_rejected``.
LARGE = 1_000_000_000


def _rejected(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric number for large populations, by rejection under the hat that bounds every log-concave law."""
    low, high = max(0, n - bad), min(n, good)
    log = lambda k: -sum(math.lgamma(x + 1) for x in (k, good - k, n - k, bad - n + k))
    whole = math.lgamma(good + 1) + math.lgamma(bad + 1) + math.lgamma(n + 1) + math.lgamma(good + bad - n + 1) - math.lgamma(good + bad + 1)
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), low), high)
    at_mode = log(mode)
    p = min(1.0, math.exp(whole + at_mode))
    w = 1 + p / 2
    while True:
        if rng.random() * (1 + w) <= w:
            y = rng.random() * w / p
        else:
            y = (w + rng.exponential()) / p
        k = mode + round(y if rng.random() < 0.5 else -y)
        if low <= k <= high and math.log(max(rng.random(), 1e-300)) + min(0.0, w - p * y) <= log(k) - at_mode:
            return k


def drawn(rng: np.random.Generator, colours: np.ndarray, n: int) -> np.ndarray:
    """How many of each colour are among ``n`` drawn without putting back."""
    left = int(colours.sum())
    if left < LARGE:
        return rng.multivariate_hypergeometric(colours, n, method="marginals")
    out = np.zeros_like(colours)
    for i, c in enumerate(colours.tolist()):
        if left - c == 0 or n == 0:
            out[i] = min(n, c)
        elif left < LARGE:
            out[i] = rng.hypergeometric(c, left - c, n)
        else:
            out[i] = _rejected(rng, c, left - c, n)
        n -= int(out[i])
        left -= c
    return out


def matrix_row(part: int, starts: list[int], places: np.ndarray, seed: int) -> np.ndarray:
    """Row ``part`` of the communication matrix: rows that this part sends to each bucket.

    ``starts`` holds the rows before each part and, last, of all; ``places`` the sizes of the buckets.
    """
    low, high, left = 0, len(starts) - 1, places
    while high - low > 1:
        middle = (low + high) // 2
        first = drawn(np.random.default_rng([seed, 0, low, high]), left, starts[middle] - starts[low])
        low, high, left = (low, middle, first) if part < middle else (middle, high, left - first)
    return left


def bucket_sizes(n: int, shards: int, most: int = BUCKET_ROWS) -> np.ndarray:
    """Sizes of all buckets, those of a shard side by side and as many in each; counts of shards differ by one at most."""
    each = max(1, -(-(-(-n // shards)) // most))
    sizes = [n // shards + (s < n % shards) for s in range(shards)]
    return np.array([size // each + (b < size % each) for size in sizes for b in range(each)], np.int64)


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, part_bits: int = PART_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``docs`` with ``shard`` (from 0) and ``slot``, its place in the shard (gapless from 0)."""
    shard, slot, place, part, at, bucket, order = (spare(docs, n) for n in ("shard", "slot", "place", "part", "row_at", "bucket", "order"))
    rows = written(docs.withColumn(place, F.monotonically_increasing_id()), "dealt-rows")
    place_ = F.col(place)
    # one entry for each part of 2**part_bits rows or each input partition, as the scheduler has one
    counts = sorted(rows.groupBy(F.shiftright(place_, part_bits).alias(part)).count().toPandas().itertuples(index=False, name=None))
    names, starts = [int(p) for p, _ in counts], [0, *accumulate(int(c) for _, c in counts)]
    places = bucket_sizes(starts[-1], shards, bucket_rows)
    each = len(places) // shards

    def destinations(i: int) -> np.ndarray:
        """The bucket of each row of a part, by its place there."""
        to = np.repeat(np.arange(len(places), dtype=np.int32), matrix_row(i, starts, places, seed))
        return np.random.default_rng([seed, 1, i]).permutation(to)

    @F.pandas_udf("int")
    def destination(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, held = -1, np.zeros(0, np.int32)
        for of in series:
            of = of.to_numpy()
            parts, out = of >> part_bits, np.zeros(len(of), np.int32)
            for name in pd.unique(parts).tolist():
                if name != known:
                    known, held = name, destinations(bisect_left(names, name))
                mine = parts == name
                out[mine] = held[of[mine] & ((1 << part_bits) - 1)]
            yield pd.Series(out)

    dealt = rows.withColumn(bucket, destination(place_)).withColumn(order, F.xxhash64(F.lit(seed), place_))
    window = Window.partitionBy(bucket).orderBy(order, place)
    size = _shard_size(starts[-1], shards, F.floor(F.col(bucket) / each))
    before = _before(size, each, F.col(bucket) % each)
    placed = dealt.withColumn(at, F.row_number().over(window) - 1)
    return placed.select(*docs.columns, F.floor(F.col(bucket) / each).cast("int").alias(shard), (F.col(at) + before).cast("long").alias(slot))


def _shard_size(n: int, shards: int, shard: Column) -> Column:
    return F.lit(n // shards) + F.when(shard < n % shards, 1).otherwise(0)


def _before(size: Column, each: int, bucket: Column) -> Column:
    """Rows of a shard's buckets before this one."""
    return bucket * F.floor(size / each) + F.least(bucket, size % each)


def with_digests(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32``: what the shards' readers check rows by."""
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


def write_shards(docs: DataFrame, path: str | None = None, shards: int = SHARDS, seed: int = SEED) -> str:
    """Writes whole rows as Parquet, one folder a shard (``shard=0`` and so on), each file in order of its slots; gives the path."""
    out = sharded(docs, shards, seed)
    shard, slot = out.columns[-2:]
    path = path or fresh_dir(docs.sparkSession, "shards")
    out.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
    return path
