"""The driver's tables as the engine's rows. No clock: the evaluation time is a literal."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shapes

EVALUATION = "2024-01-25 00:00:00"
NOW = datetime(2024, 1, 25, tzinfo=timezone.utc)

#: Flat observations from ``events``, in SQL that both engines take; {k} is the JSON number.
FLAT = """
SELECT event_id, ts, 'telegram.channel:ch' || CAST(user_id % 4 AS VARCHAR(20)) AS source_id, CAST(user_id % 4 AS INT) AS source_no,
    'ch' || CAST(user_id % 4 AS VARCHAR(20)) || '/' || CAST(event_id AS VARCHAR(20)) AS evidence_id,
    CASE event_type WHEN 'view' THEN 'air.attack_drone' WHEN 'click' THEN 'air.jet_drone' WHEN 'purchase' THEN 'air.guided_bomb'
        WHEN 'signup' THEN 'air.missile' ELSE 'air.ballistic_missile' END AS kind,
    CASE event_type WHEN 'view' THEN 'drone' WHEN 'click' THEN 'drone' WHEN 'purchase' THEN 'bomb' ELSE 'missile' END AS class,
    CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 1 ELSE 0 END AS kind_rank,
    CASE WHEN {k} % 10 = 0 THEN 'clear' WHEN {k} % 10 = 1 THEN 'neutralized' ELSE 'threat' END AS stance,
    CASE WHEN event_id % 50 = 0 THEN 'ua-adm1:UA' || CAST(user_id % 3 AS VARCHAR(20)) ELSE 'geonames:' || CAST(user_id % 5 AS VARCHAR(20)) END AS place_id,
    CAST(user_id % 5 AS INT) AS place_no,
    CASE WHEN event_id % 7 = 0 THEN 'via' ELSE 'target' END AS place_role, NULLIF(CAST({k} % 4 AS INT), 0) AS count,
    CASE event_type WHEN 'view' THEN 10800 WHEN 'click' THEN 10800 WHEN 'purchase' THEN 5400 ELSE 7200 END AS ttl
FROM events
"""
#: Every 40th clear is also a threat by the same post.
WITH_TWINS = "SELECT * FROM ({flat}) UNION ALL SELECT * REPLACE ('threat' AS stance) FROM ({flat}) WHERE stance = 'clear' AND event_id % 40 = 0"
DUCK_OBS = WITH_TWINS.format(flat=FLAT.replace("{k}", "CAST(json_extract(props, '$.k') AS INT)"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def flat_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "CAST(get_json_object(props, '$.k') AS INT)"
    flat = spark.sql(FLAT.replace("{k}", k).replace("FROM events", "FROM {events}"), events=events(spark, sf_dir))
    return flat.unionByName(flat.filter("stance = 'clear' and event_id % 40 = 0").withColumn("stance", F.lit("threat")))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``OBSERVATION`` rows; places lie on a line across the map."""
    none = lambda t: F.lit(None).cast(t)
    at = F.array(22 + 0.7 * F.col("place_no"), 44 + 0.3 * F.col("place_no"))
    geometry = F.struct(F.lit("point").alias("type"), at.alias("coordinates"), none("array<array<array<double>>>").alias("rings"), none("int").alias("resolution"), none("array<string>").alias("cells"))
    provenance = F.struct(
        "evidence_id", F.concat(F.lit("https://t.me/"), "evidence_id").alias("evidence_url"), F.lit("events").alias("normalizer"), F.array().cast("array<string>").alias("matched"), "place_id",
        F.col("place_id").alias("place_name"), "place_role", F.lit(0).alias("statement"), F.lit(0).alias("place_order"),
    )
    return flat_observations(spark, sf_dir).select(
        "source_id", "kind", "stance", "count", F.col("ts").cast("timestamp").alias("observed_at"), geometry.alias("geometry"), "ttl", none("string").alias("confidence"), provenance.alias("provenance")
    )


def micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp, as the session's wall clock shows it."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))")


#: Cells of the one region of the paired view, and of observations that name no place.
REGION_CELLS = ("861e63bb7ffffff", "861e63b97ffffff")
LOOSE_CELLS = ("861e54b87ffffff", "861e54b97ffffff")
LOOSE_CELL_FIRST = min(shapes.texts(shapes.expanded({shapes.parsed(c)[1] for c in LOOSE_CELLS}, 1, 400), 6))
#: Events in pairs that make one statement of two places: points, squares, regions, cells without a place and broken geometries.
PAIRED = """
SELECT f.*, p.at AS ts, 'telegram.channel:ch' || CAST(p.pair % 4 AS VARCHAR(20)) AS source_id, 'ch' || CAST(p.pair % 4 AS VARCHAR(20)) || '/' || CAST(p.pair AS VARCHAR(20)) AS evidence_id, CAST(event_id % 2 AS INT) AS place_order, place_role = 'via' AS via,
    CASE WHEN event_id % 13 = 0 THEN 'region' WHEN event_id % 11 = 0 THEN 'polygon' WHEN event_id % 7 = 0 THEN 'cells' ELSE 'point' END AS shape, event_id % 17 = 0 AS broken,
    CASE WHEN event_id % 13 = 0 THEN 'ua-adm1:UA1' WHEN event_id % 11 = 0 OR event_id % 7 <> 0 THEN 'geonames:' || CAST(place_no AS VARCHAR(20)) END AS place_id
FROM (SELECT event_id, floor(event_id / 2) AS half, kind, class, kind_rank, stance, place_no, place_role, count, ttl FROM ({flat})) f JOIN (SELECT CAST(floor(event_id / 2) AS BIGINT) AS pair, min(ts) AS at FROM ({flat}) GROUP BY floor(event_id / 2)) p ON p.pair = f.half
"""
PAIRED_SQL = PAIRED.format(flat=FLAT.replace("{k}", "CAST(json_extract(props, '$.k') AS INT)"))


def paired_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``OBSERVATION`` rows of ``PAIRED``."""
    k = "CAST(get_json_object(props, '$.k') AS INT)"
    rows = spark.sql(PAIRED.format(flat=FLAT.replace("{k}", k).replace("FROM events", "FROM {events}")), events=events(spark, sf_dir))
    none = lambda t: F.lit(None).cast(t)
    x, y = 22 + 0.7 * F.col("place_no"), 44 + 0.3 * F.col("place_no")
    corner = lambda a, b: F.array((x + a).cast("double"), (y + b).cast("double"))
    square = F.array(F.array(corner(-0.1, -0.1), corner(0.1, -0.1), corner(0.1, 0.1), corner(-0.1, 0.1), corner(-0.1, -0.1)))
    is_ = lambda *shapes_: F.col("shape").isin(*shapes_) & ~F.col("broken")
    cells = F.when(is_("region"), F.array(*map(F.lit, REGION_CELLS))).when(is_("cells"), F.array(*map(F.lit, LOOSE_CELLS)))
    geometry = F.struct(
        F.when(F.col("shape") == "region", "cells").otherwise(F.col("shape")).alias("type"), F.when(is_("point"), F.array(x.cast("double"), y.cast("double"))).alias("coordinates"), F.when(is_("polygon"), square).alias("rings"),
        F.when(is_("region", "cells"), F.lit(6)).alias("resolution"), cells.alias("cells"),
    )
    provenance = F.struct(
        "evidence_id", F.concat(F.lit("https://t.me/"), "evidence_id").alias("evidence_url"), F.lit("events").alias("normalizer"), F.array().cast("array<string>").alias("matched"), "place_id",
        F.col("place_id").alias("place_name"), "place_role", F.lit(0).alias("statement"), "place_order",
    )
    return rows.select("source_id", "kind", "stance", "count", F.col("ts").cast("timestamp").alias("observed_at"), geometry.alias("geometry"), "ttl", none("string").alias("confidence"), provenance.alias("provenance"))
