"""Covers of geometries and the cells an observation speaks for."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import shapes
from ..params import FusionPolicy
from .runs import map_rows

OUTCOME = "cells array<string>, error string"


def outcome(make) -> dict:  # noqa: ANN001
    """Sorted ids, or the code of what went wrong; a job never fails on a shape."""
    try:
        return {"cells": make(), "error": None}
    except shapes.Refused as why:
        return {"cells": None, "error": str(why)}


def cover_geometries(df: DataFrame, resolution: int, max_cells: int, rings: int = 0, point_km: float | None = None, vertices: int = 48, column: str = "geometry") -> DataFrame:
    """Distinct geometries of ``df`` with ``cells`` and ``error``."""

    def one(row: dict) -> Iterator[dict]:
        def make() -> list[str]:
            if row["g"] is None:
                raise shapes.Refused("invalid_geometry")
            cells = shapes.covered(row["g"], resolution, max_cells, point_km, vertices)
            return shapes.texts(shapes.expanded(cells, rings, max_cells) if rings else cells, resolution)

        yield row | outcome(make)

    distinct = df.select(F.col(column).alias("g")).distinct()
    return map_rows(distinct, one, f"g {distinct.schema['g'].dataType.simpleString()}, {OUTCOME}").withColumnRenamed("g", column)


NO_FIELDS = {"type": "", "coordinates": None, "rings": None, "cells": None}


def footprint_of(geometry: dict, policy: FusionPolicy) -> dict:
    """Cells and error of what an observation speaks for: its geometry, or the disc around its point, and some rings."""
    make = lambda: shapes.texts(shapes.expanded(shapes.covered(NO_FIELDS | geometry, policy.resolution, policy.max_cells, policy.point_radius_km, policy.disc_vertices), policy.edge_rings, policy.max_cells), policy.resolution)
    return outcome(make)


def _cached(policy: FusionPolicy):
    @lru_cache(maxsize=100_000)
    def one(text: str | None) -> dict:
        return {"cells": None, "error": None} if text is None else footprint_of(json.loads(text), policy)

    return one


def with_footprint(observations: DataFrame, policy: FusionPolicy) -> DataFrame:
    """Adds ``footprint`` (struct<cells, error>) without a shuffle: each batch of rows covers each of its geometries once."""

    @F.pandas_udf(StructType([StructField("cells", ArrayType(StringType())), StructField("error", StringType())]))
    def footprint(geometry: pd.Series) -> pd.DataFrame:
        one = _cached(policy)
        return pd.DataFrame([one(g) for g in geometry], columns=["cells", "error"])

    return observations.withColumn("footprint", footprint(F.coalesce(F.to_json("geometry"), F.lit("{}"))))


def with_problem(observations: DataFrame, policy: FusionPolicy) -> DataFrame:
    """Adds ``error`` and ``first_cell`` of the footprint.

    The disc around a valid point always has a cover, so that points with a
    place (which names them) send a null to Python, and no row carries its cells.
    """

    @F.pandas_udf(StructType([StructField("first", StringType()), StructField("error", StringType())]))
    def problem(geometry: pd.Series) -> pd.DataFrame:
        one = _cached(policy)
        found = [one(g) for g in geometry]
        return pd.DataFrame([((f["cells"] or [None])[0], f["error"]) for f in found], columns=["first", "error"])

    simple = (F.col("geometry.type") == "point") & F.col("provenance.place_id").isNotNull()
    checked = observations.withColumn("checked", problem(F.when(simple, F.lit(None).cast("string")).otherwise(F.coalesce(F.to_json("geometry"), F.lit("{}")))))
    return checked.select(*observations.columns, F.col("checked.first").alias("first_cell"), F.col("checked.error").alias("error"))
