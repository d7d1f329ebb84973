"""The chosen-path join where buckets are split: fresh coordinates, recall at the shipped sizes, blocks by shingles."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from sentria.llm import ngram_join
from tests.llm.test_operators import brute_groups, docs


def test_splits_take_unused_coordinates(spark):
    rng = random.Random(1)
    used = [sum(1 << c for c in rng.sample(range(64), k)) for k in (0, 1, 8, 40, 62) for _ in range(40)]
    used = [u - (1 << 64) if u >= 1 << 63 else u for u in used]
    rows = spark.createDataFrame(list(enumerate(used)), "path long, used long").select("used", ngram_join._fresh_coordinates(F.col("used"), 6).alias("c")).collect()
    for r in rows:
        assert len(set(r["c"])) == len(r["c"]) == min(6, 64 - (r["used"] & (1 << 64) - 1).bit_count()) and all(0 <= c < 64 and not r["used"] >> c & 1 for c in r["c"])


def planted(n_pairs, n_others, seed=3):
    """Texts that share half of their words, so that they meet in large buckets; pairs at a similarity of 0.8 to 0.87."""
    rnd = random.Random(seed)
    common = [f"c{i}" for i in range(70)]
    own = lambda: [f"r{rnd.randrange(10**9)}" for _ in range(70)]
    texts = []
    for _ in range(n_pairs):
        words = common + own()
        other = list(words)
        at = rnd.randrange(75, len(words) - 20)
        other[at : at + rnd.choice([4, 6, 8])] = own()[:5]
        texts += [" ".join(words), " ".join(other)]
    return texts + [" ".join(common + own()) for _ in range(n_others)]


def test_recall_where_shipped_buckets_split(spark, monkeypatch):
    made, inner = [], ngram_join._buckets
    monkeypatch.setattr(ngram_join, "_buckets", lambda classes, runs: made.append(inner(classes, runs)) or made[-1])
    texts = planted(400, 3600)
    sets = [set(ngram_join.shingles(t).tolist()) for t in texts[:800]]
    similar = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    linked = [i for i, s in enumerate(similar) if s >= 0.8]
    assert len(linked) > 300 and np.median(similar) < 0.88
    got = {r["doc_id"]: r for r in ngram_join.ngram_join(docs(spark, *texts)).collect()}
    assert max(splits for _, splits in made) >= 1, "the table is too small to split a bucket"
    found = sum(got[2 * i]["class_id"] == got[2 * i + 1]["class_id"] and got[2 * i]["n_links"] == 1 for i in linked)
    assert found >= 0.99 * len(linked)
    assert all(got[2 * i]["n_links"] == 0 for i, s in enumerate(similar) if s < 0.8)


def test_blocks_by_shingles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 300)
    rnd = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(f"n{n}" if i == n % 110 else w for i, w in enumerate(base)) for n in range(30)] + [" ".join(base[:20] + [f"r{rnd.randint(0, 10**6)}" for _ in range(90)]) for _ in range(20)]
    groups, links = brute_groups(texts)
    got = ngram_join.ngram_join(docs(spark, *texts)).orderBy("doc_id").collect()
    assert [r["class_id"] for r in got] == groups and [r["n_links"] for r in got] == links


def test_odd_tables(spark):
    texts = [None, "", "word", "x " * 200_000, "x " * 200_000 + "y", "word", "word"]
    rows = docs(spark, *texts, ids=[1, 2, 3, 4, 5, None, 3])
    clashing = rows.selectExpr("*", "1 as sig", "2 as path", "3 as members", "4 as class_id")
    got = ngram_join.ngram_join(clashing).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"], r["n_links"]) for r in got) == [(0, 3, 2), (1, 1, 1), (2, 1, 1), (3, 3, 2), (3, 3, 2), (4, 4, 0), (5, 5, 0)]
    kept = ngram_join.one_of_each(clashing, ngram_join.ngram_join(clashing))
    assert kept.columns == clashing.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5]
    assert ngram_join.ngram_join(clashing.limit(0)).count() == 0


def test_memory_of_a_comparison():
    rng = np.random.default_rng(5)
    path, n = 2**61, 512
    common = rng.integers(0, 2**64, 95, dtype=np.uint64)
    sets = [np.unique(np.concatenate([common, rng.integers(0, 2**64, 5, dtype=np.uint64)])) for _ in range(n)]
    # each set went down 400 paths of its own, and every eighth one down a path in common as well, where those have met
    paths = [[*rng.integers(-(2**62), 2**61, 400).tolist(), path, *([-7] if i % 8 == 0 else [])] for i in range(n)]
    large = [np.unique(rng.integers(0, 2**64, 200_000, dtype=np.uint64)) for _ in range(19)]
    large.append(np.unique(np.concatenate([large[0][: len(large[0]) * 19 // 20], large[1][:100]])))
    peaks, found = [], []
    for sets_, paths_ in ((sets, paths), (large, [[path]] * len(large))):
        tracemalloc.start()
        found.append(ngram_join.compared(path, [0] * len(sets_), (0, 0), sets_, [2] * len(sets_), paths_, 0.8))
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
    (texts, documents, root), (few, _, roots) = found
    assert texts.tolist() == [n - n // 8 if i % 8 == 0 else n - 1 for i in range(n)] and documents.tolist() == (2 * texts).tolist() and set(root) == {0}
    assert few.tolist() == [1] + [0] * 18 + [1] and roots == [*range(19), 0]
    assert max(peaks) < 100, f"{peaks} MB for 512 sets with 400 paths each, and for 4 million shingles"


def test_intersections_in_parts(monkeypatch):
    rng = np.random.default_rng(6)
    # small values, the ends of the range and empty sets beside hashes
    pool = np.concatenate([rng.integers(0, 2**64, 150, dtype=np.uint64), np.array([0, 1, 2, 2**63, 2**64 - 1], np.uint64)])
    sets = [np.unique(rng.choice(pool, k)) for k in (*rng.integers(1, 120, 70).tolist(), 0, 0)]
    shared = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    for numbered in (40, 1000, 10**6):
        monkeypatch.setattr(ngram_join, "NUMBERED", numbered)
        got = ngram_join._intersections(sets)
        off = ~np.eye(len(sets), dtype=bool)
        assert (got[off] == np.array(shared, float)[off]).all()
    assert (ngram_join._intersections([np.zeros(0, np.uint64)] * 2) == 0).all()
