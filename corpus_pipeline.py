"""The corpus pipeline: quality, near duplicates, decontamination, secrets, packing.

``STAGES`` are (name, function) pairs; each function takes (spark, docs,
sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's ``docs``. All but the last return the columns of ``docs``.

Defined cases, for every stage: an empty table gives an empty result; a null
text is empty, and the classifier and the n-gram join treat it as such; rows are
judged by their own texts, so that rows which share an id or have none don't
take each other along; of repeated rows one stays; other columns, whatever their
names, are passed on (but by the last stage) and never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentria.llm import decontaminate, ngram_join, packing, quality_classifier, secrets
from sentria.llm._shared import content, fresh_dir, keyed_only, spare, table, written


def _without(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """``docs`` without the rows that are rejected; ``judged`` has ``doc_id, content, rejected`` of every row.

    Ids whose rows are all rejected go by id. Where only some are (rows that
    share an id or have none), these go by id and content.
    """
    rejected, every, of, own = (spare(docs, n) for n in ("rejected_id", "all_rejected", "rejected_content", "own_content"))
    judged = written(judged, "judged")
    some = judged.groupBy("doc_id").agg(F.max("rejected").alias("any"), F.min("rejected").alias("all")).filter("`any`")
    some = written(some.select(F.col("doc_id").alias(rejected), F.col("all").alias(every)), "rejected")
    of_id = F.col("doc_id").eqNullSafe(F.col(rejected))
    left = docs.join(keyed_only(some.filter(every).select(rejected)), of_id, "left_anti")
    mixed = some.filter(f"not {every}").select(rejected)
    if mixed.isEmpty():
        return left
    rows = judged.filter("rejected").join(keyed_only(mixed), of_id, "left_semi").select(F.col("doc_id").alias(rejected), F.col("content").alias(of)).distinct()
    rows = written(rows, "rejected-rows")
    return left.withColumn(own, content(F.col("text"))).join(keyed_only(rows), of_id & (F.col(own) == F.col(of)), "left_anti").drop(own)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as 0 go; each row is judged by its own text."""
    judged = quality_classifier.classify(docs, table(spark, sf_dir, "labels"), with_content=True)
    return _without(docs, judged.select("doc_id", "content", F.coalesce(F.col("predicted") == 0, F.lit(False)).alias("rejected")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of the smallest id."""
    return ngram_join.one_of_each(docs, ngram_join.ngram_join(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which any window of the benchmark occurs go; each row is judged by its own text.

    This is stricter than the operator's ``contaminated``, which asks for 5 % of
    the words: a long document that holds a whole test question leaks it as well.
    """
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), with_content=True)
    return _without(docs, found.select("doc_id", "content", (F.col("n_hit") > 0).alias("rejected")))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are marked out, and ``n_chars`` follows."""
    found = written(secrets.scan_secrets(docs, fresh_dir(spark, "ledger")), "secrets")
    return secrets.redacted(docs, found)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place."""
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secret_scans", secret_scans), ("packing", packed)]

#: The classifier's sums and the packing are not SQL; ``tests/llm/test_pipeline.py`` holds each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
