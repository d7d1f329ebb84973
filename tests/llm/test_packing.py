"""The tree of the packing, and its ids over whole texts."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from sentria.llm import packing
from sentria.llm._shared import table
from tests.llm.test_operators import SF, docs


def levels(out):
    return Counter((r["sequence_id"] >> 56, (r["sequence_id"] >> 32) & 0xFFFFFF) for r in out.collect())


@pytest.mark.parametrize(("short", "joined"), [(0, 0), (1, 1), (12, 12)])
def test_lengths_that_do_not_combine_stay(spark, short, joined):
    texts = [" ".join(["word"] * 1200)] * 320 + [" ".join(["word"] * 600)] * short
    assert {len(packing.token_ids(t)) for t in texts} <= {600, 1200}
    out = packing.pack_documents(docs(spark, *texts).repartition(16)).cache()
    at = levels(out)
    assert sum(n for (level, _), n in at.items() if level) <= 8 * short < 320
    sequences = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).groupBy("n").count().collect()
    assert {r["n"]: r["count"] for r in sequences} == {k: v for k, v in {1201: 320 - joined, 1802: joined}.items() if v}


def test_tree_fills_what_fits(spark):
    """Long and short ones begin in different partitions and meet in the tree."""
    texts = [" ".join(["word"] * n) for n in [1500] * 40 + [500]]
    out = packing.pack_documents(docs(spark, *texts).repartitionByRange(41, "doc_id"), fan_in=2)
    assert out.select("sequence_id").distinct().count() == 40
    # of the long ones, one a partition is handed on at most
    assert sum(n for (level, _), n in levels(out).items() if level) <= 8


def test_wanted(spark):
    placed = spark.createDataFrame([(i, u) for i, u in enumerate([10, 10, 30, 60, 95])], "sequence_id long, used long")
    wanted = packing._wanted(placed, 100, 95)
    assert [wanted[s] for s in (10, 30, 60, 70, 71, 90, 91)] == [2, 2, 3, 3, 2, 2, 0]


def test_ids_of_all_documents():
    import duckdb
    import public_tokenizers

    slow = packing._slow(public_tokenizers.path(packing.TOKENIZER))
    texts = [t for t, in duckdb.sql(f"SELECT DISTINCT text FROM '{SF.replace('sf0.001', 'sf0.1')}/documents.parquet' WHERE text IS NOT NULL").fetchall()]
    fast = 0
    for at in range(0, len(texts), 500):
        for text, ids in zip(texts[at : at + 500], slow.encode_batch(texts[at : at + 500], add_special_tokens=False), strict=True):
            fast += not packing._OTHER.search(text)
            assert packing.token_ids(text) == ids.ids
    assert fast > len(texts) / 2


def test_vocabularies_are_compared(tmp_path):
    import public_tokenizers

    lines = open(public_tokenizers.path(packing.RANKS), "rb").read().splitlines()
    first, second = lines[1000].split(), lines[1001].split()
    lines[1000], lines[1001] = first[0] + b" " + second[1], second[0] + b" " + first[1]
    (tmp_path / "ranks").write_bytes(b"\n".join(lines))
    with pytest.raises(packing.DifferentVocabularies):
        packing._fast(str(tmp_path / "ranks"), public_tokenizers.PATTERN, public_tokenizers.path(packing.TOKENIZER))


def test_sequences_of_a_table(spark):
    out = packing.pack_documents(table(spark, SF.replace("sf0.001", "sf0.01"), "documents"))
    total, n = out.agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert n <= -(-total // packing.CAPACITY) * 1.01 + 2
