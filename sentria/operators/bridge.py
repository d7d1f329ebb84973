"""Readings to observations, in expressions only: positions, twins, validity, geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sphere
from ..params import BRIDGE_TTL_MIN, CONTRACT_KIND, MAX_REGION_CELLS, REGION_PREFIX
from .role_reader import affected

NORMALIZER = "roles.v1"
#: Skip codes of readers and their names on the wire (fixed values).
WIRE_CODES = {"forwarded": "forwarded", "unlocated_clear": "unlocated_clear", "ambiguous": "ambiguous_place", "unlocated": "unlocated", "invalid_geometry": "invalid_geometry", "unknown_region": "invalid_geometry"}


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def wire_code(code: Column | str) -> Column:
    code = F.col(code) if isinstance(code, str) else code
    return F.element_at(_map(WIRE_CODES), code)


def skipped(readings: DataFrame) -> DataFrame:
    """Forwarded posts once each, and all-clears without a kind or an affected place."""
    forwarded = readings.filter("forwarded").select(F.col("external_id").alias("evidence_id"), F.lit("forwarded").alias("code")).distinct()
    unlocated = readings.filter((~F.col("forwarded")) & (F.col("phase") == "cleared") & (F.col("kind").isNull() | (F.size(affected()) == 0)))
    return forwarded.unionByName(unlocated.select(F.col("external_id").alias("evidence_id"), F.lit("unlocated_clear").alias("code")))


def positions(readings: DataFrame) -> DataFrame:
    """A row for each affected place of a reading with a kind, with its place among these."""
    kept = readings.filter((~F.col("forwarded")) & F.col("kind").isNotNull())
    return kept.select("*", F.posexplode(affected()).alias("place_order", "place"))


def twinned(rows: DataFrame) -> DataFrame:
    """An interception is a threat without a count, and then a neutralization."""
    stance = F.when(F.col("phase") == "cleared", F.lit("clear")).when(F.col("phase") == "intercepted", F.lit("neutralized")).otherwise("threat")
    alone = F.array(F.struct(stance.alias("stance"), F.col("count").alias("of_count")))
    twin = F.concat(F.array(F.struct(F.lit("threat").alias("stance"), F.lit(None).cast("int").alias("of_count"))), alone)
    return rows.withColumn("said", F.explode(F.when(F.col("phase") == "intercepted", twin).otherwise(alone)))


def ttl_seconds(kind: Column, stance: Column) -> Column:
    return F.when(stance == "threat", F.element_at(_map(BRIDGE_TTL_MIN), kind)).otherwise(BRIDGE_TTL_MIN["clear"]) * 60


def geometry(place: Column, region: Column, vertices: int = 48) -> Column:
    """A region's cells, null for a region nobody knows; a disc around any other place."""
    none = lambda t: F.lit(None).cast(t)
    ring = F.transform(sphere.disc(sphere.position(place["lon"], place["lat"]), place["reach_km"].cast("double"), vertices), lambda p: F.array(p["lon"], p["lat"]))
    polygon = F.struct(F.lit("polygon").alias("type"), none("array<double>").alias("coordinates"), F.array(ring).alias("rings"), none("int").alias("resolution"), none("array<string>").alias("cells"))
    cells = F.struct(F.lit("cells").alias("type"), none("array<double>").alias("coordinates"), none("array<array<array<double>>>").alias("rings"), region["resolution"].alias("resolution"), region["cells"].alias("cells"))
    return F.when(place["place_id"].startswith(REGION_PREFIX), F.when(region.isNotNull(), cells)).otherwise(polygon)


def problem(place: Column, shape: Column) -> Column:
    """Why a place has no geometry: a position that is none, a region that is not listed, or one of too many cells."""
    return (
        F.when(~F.coalesce(sphere.valid_position(sphere.position(place["lon"], place["lat"])), F.lit(False)), "invalid_geometry").when(shape.isNull(), "unknown_region")
        .when(~sphere.valid_geometry(shape), "invalid_geometry").when(F.size(shape["cells"]) > MAX_REGION_CELLS, "cover_too_large")
    )


def bridge_all(readings: DataFrame, regions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``OBSERVATION`` rows, and ``evidence_id, code`` of the places that have no geometry, once for each position of a reading.

    ``regions`` has ``id, resolution, cells`` with uncompacted cells.
    """
    rows = positions(readings)
    if regions is None:
        rows = rows.withColumn("region", F.lit(None).cast("struct<resolution:int,cells:array<string>>"))
    else:
        known = regions.select(F.col("id").alias("r_id"), F.struct("resolution", "cells").alias("region"))
        rows = rows.join(known, F.col("place.place_id") == F.col("r_id"), "left")
    shaped = rows.withColumn("shape", geometry(F.col("place"), F.col("region"))).withColumn("problem", problem(F.col("place"), F.col("shape")))
    provenance = F.struct(
        F.col("external_id").alias("evidence_id"), F.col("url").alias("evidence_url"), F.lit(NORMALIZER).alias("normalizer"),
        F.when(F.col("kind_inherited"), F.array(F.lit("kind_inherited"))).otherwise(F.array().cast("array<string>")).alias("matched"), F.col("place.place_id").alias("place_id"),
        F.col("place.name").alias("place_name"), F.when(F.col("place.role") == "via", "via").otherwise("target").alias("place_role"), "statement", F.col("place_order").cast("int").alias("place_order"),
    )
    observations = twinned(shaped.filter("problem is null")).select(
        "source_id", F.element_at(_map(CONTRACT_KIND), F.col("kind")).alias("kind"), F.col("said.stance").alias("stance"), F.col("said.of_count").alias("count"), F.col("published_at").alias("observed_at"),
        F.col("shape").alias("geometry"), ttl_seconds(F.col("kind"), F.col("said.stance")).alias("ttl"), F.lit(None).cast("string").alias("confidence"), provenance.alias("provenance"),
    )
    return observations, shaped.filter("problem is not null").select(F.col("external_id").alias("evidence_id"), F.col("problem").alias("code"))


def bridge(readings: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """The observations of ``bridge_all``."""
    return bridge_all(readings, regions)[0]
