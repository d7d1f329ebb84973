"""Evidence and readings as lines of JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.role_reader import actionable
from ..schemas import EVIDENCE, EXTERNAL_ID, SOURCE_ID


def read_evidence(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """One JSON object a line; blank lines are skipped. Strict: a bad line fails the read; else it is in ``_corrupt_record``."""
    if strict:
        return spark.read.schema(EVIDENCE).option("mode", "FAILFAST").json(path)
    return spark.read.schema(f"{EVIDENCE}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def judged_lines(lines: DataFrame) -> DataFrame:
    """Lines (``value``) that aren't blank, with ``valid``: whether they are evidence with ids of the right form."""
    parsed = lines.filter(F.trim("value") != "").withColumn("e", F.from_json("value", EVIDENCE, {"mode": "PERMISSIVE"}))
    return parsed.withColumn("valid", F.col("e.source_id").isNotNull() & valid_ids(F.col("e.source_id"), F.col("e.external_id"))).drop("e")


def numbered_problems(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are no evidence: file, byte offset order and text. Each line is judged where it is read."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("n"), "value")
    return judged_lines(lines).filter(~F.col("valid")).drop("valid")


def valid_ids(source_id: Column, external_id: Column) -> Column:
    return F.coalesce(source_id.rlike(SOURCE_ID) & external_id.rlike(EXTERNAL_ID), F.lit(False))


def wire_time(column: Column | str) -> Column:
    """RFC 3339 in UTC with a Z, and a fraction only if there is one."""
    c = F.col(column) if isinstance(column, str) else column
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(c), F.lit(1_000_000))
    fraction = F.regexp_replace(F.format_string(".%06d", micros), "0+$", "")
    return F.concat(whole, F.when(micros > 0, fraction).otherwise(""), F.lit("Z"))


def as_json(df: DataFrame, *times: str) -> DataFrame:
    """One ``value`` column; nulls and empty lists are left out."""
    columns = {c: wire_time(c) for c in times} | {f.name: F.when(F.size(f.name) > 0, F.col(f.name)) for f in df.schema if f.dataType.typeName() == "array"}
    return df.withColumns(columns).select(F.to_json(F.struct("*")).alias("value"))


def write_evidence(df: DataFrame, path: str) -> None:
    as_json(df, "published_at").write.text(path)


def write_readings(df: DataFrame, path: str, only_actionable: bool = False) -> None:
    as_json(df.filter(actionable()) if only_actionable else df, "published_at").write.text(path)
