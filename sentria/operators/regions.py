"""Regions as cell sets: compacting, uncompacting, loading and building them."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import h3bits, shapes
from ..params import MAX_REGION_CELLS
from .runs import map_rows

REGION = "id string, name string, lat double, lon double, reach_km int, resolution int, cells array<string>"


def compacted(cells: DataFrame, key: str, levels: int) -> DataFrame:
    """``key, cell`` with all children of a cell replaced by it where all are there, ``levels`` times.

    Each level, from the finest of a key's cells on, is one aggregation by (key, parent) of the digits that are there;
    cells of other levels stay. Cells that are dealt by ``key`` already are not shuffled again.
    """
    # a key is one region: the window holds its cells
    finest = F.max(h3bits.resolution(F.col("cell"))).over(Window.partitionBy(key))
    rows = cells.select(key, "cell").withColumn("finest", finest)
    for level in range(levels):
        resolution = h3bits.resolution(F.col("cell"))
        marked = rows.withColumn("joins", (resolution == F.col("finest") - level) & (resolution > 0))
        bit = F.call_function("shiftleft", F.lit(1), F.when(F.col("joins"), h3bits.last_digit(F.col("cell"))).otherwise(0))
        grouped = marked.groupBy(key, "finest", F.when(F.col("joins"), h3bits.up(F.col("cell"))).otherwise(F.col("cell")).alias("parent"), "joins").agg(F.bit_or(bit).alias("own"))
        kept = F.filter(h3bits.split(F.col("parent")), lambda c: F.call_function("shiftright", F.col("own"), h3bits.last_digit(c)).bitwiseAND(F.lit(1)) == 1)
        whole = ~F.col("joins") | (F.bit_count("own") == F.when(h3bits.is_pentagon(F.col("parent")), 6).otherwise(7))
        rows = grouped.select(key, "finest", F.explode(F.when(whole, F.array("parent")).otherwise(kept)).alias("cell"))
    return rows.drop("finest")


def uncompacted(cells: DataFrame, resolution: Column | int, levels: int = 8) -> DataFrame:
    """Rows with ``cell`` replaced by its descendants at ``resolution``, at most ``levels`` below. Finer ones, and what is coarser still, stay as they are."""
    target = F.lit(resolution) if isinstance(resolution, int) else resolution
    for _ in range(levels):
        coarse = h3bits.resolution(F.col("cell")) < target
        cells = cells.withColumn("cell", F.explode(F.when(coarse, h3bits.split(F.col("cell"))).otherwise(F.array("cell"))))
    return cells


def load_regions(spark: SparkSession, path: str, max_cells: int = MAX_REGION_CELLS) -> tuple[DataFrame, DataFrame]:
    """Regions of a JSON document with uncompacted cells, each at its own resolution, and ``problems`` (id, problem)."""
    doc = spark.read.option("multiLine", "true").schema(f"version string, attribution string, regions array<struct<{REGION}>>").json(path)
    rows = doc.select("version", F.explode("regions").alias("r")).select("version", "r.*")
    one = rows.select("id", "resolution", F.explode("cells").alias("text")).withColumn("cell", h3bits.parse(F.col("text")))
    wrong = one.groupBy("id").agg(F.max(~h3bits.is_cell(F.col("cell")) | (h3bits.resolution(F.col("cell")) > F.col("resolution"))).alias("wrong"))
    fine = uncompacted(one.filter(h3bits.is_cell(F.col("cell"))).select("id", "resolution", "cell"), F.col("resolution")).groupBy("id").agg(F.array_sort(F.collect_set(h3bits.to_text(F.col("cell")))).alias("cells"), F.min(h3bits.resolution(F.col("cell"))).alias("coarsest"))
    whole = rows.drop("cells").join(wrong, "id", "left").join(fine, "id", "left")
    problem = (
        F.when(~F.col("version").eqNullSafe("regions.v1"), "unsupported version").when(F.col("wrong"), "no h3 cell, or finer than the region's resolution").when(F.col("cells").isNull(), "no cells")
        .when(F.col("coarsest") < F.col("resolution"), "a cell is too coarse").when(F.size("cells") > max_cells, "too many cells")
    )
    judged = whole.withColumn("problem", problem)
    return judged.filter("problem is null").drop("problem", "version", "wrong", "coarsest"), judged.filter("problem is not null").select("id", "problem")


def build_regions(boundaries: DataFrame, resolution: int = 6, max_cells: int = MAX_REGION_CELLS) -> DataFrame:
    """``REGION`` rows with ``error`` from ``id, name, polygons`` (arrays of rings of [lon, lat]): union of the covers, its middle and its reach."""

    def one(row: dict) -> Iterator[dict]:
        out = {"id": row["id"], "name": row["name"], "resolution": resolution}
        try:
            cells: shapes.Cells = set()
            for rings in row["polygons"] or []:
                cells |= shapes.polygon([[tuple(p) for p in ring] for ring in rings], resolution, max_cells)
            if not cells or len(cells) > max_cells:
                raise shapes.Refused("cover_too_large" if cells else "invalid_geometry")
            lon, lat, radius = shapes.centroid(cells, resolution)
            yield out | {"lat": round(lat, 4), "lon": round(lon, 4), "reach_km": math.ceil(radius), "cells": shapes.texts(cells, resolution)}
        except (shapes.Refused, TypeError, IndexError, ValueError) as why:
            yield out | {"error": str(why) if isinstance(why, shapes.Refused) else "invalid_geometry"}

    return map_rows(boundaries.select("id", "name", "polygons"), one, f"{REGION}, error string")


_CELL = "cell long, inside boolean, segments array<struct<x1:double,y1:double,x2:double,y2:double>>"
_NAMES = ("x1", "y1", "x2", "y2")


def cover_polygons(polygons: DataFrame, resolution: int, levels: int = 4) -> DataFrame:
    """``id, cell``: the cells of ``resolution`` whose middles are inside of ``rings`` ([lon, lat] pairs, closed), of polygons of any size.

    From cells ``levels`` coarser, cells near the boundary are split, level by level; those that are
    wholly inside keep all of their descendants, which only bit arithmetic makes. A cell is a row with the
    segments near it, so that one country is the work of many tasks, in proportion to
    its boundary. A polygon so small that it holds no middle has no rows here (see ``shapes.polygon``); invalid rings have none.
    """
    segments = lambda near: [dict(zip(_NAMES, s, strict=True)) for s in near]
    rows_of = lambda id_, found: ({"id": id_, "cell": c, "inside": i, "segments": segments(near)} for c, i, near in found)

    def begin(row: dict) -> Iterator[dict]:
        try:
            rings = shapes.rings_of({"rings": row["rings"]})
        except (shapes.Refused, TypeError):
            return
        yield from rows_of(row["id"], shapes.coarse_cells(rings, max(0, resolution - levels)))

    def split(row: dict) -> Iterator[dict]:
        yield from rows_of(row["id"], shapes.split_cell(row["cell"], row["inside"], [tuple(s[n] for n in _NAMES) for s in row["segments"]]))

    kind = polygons.schema["id"].dataType.simpleString()
    level = map_rows(polygons.select("id", "rings"), begin, f"id {kind}, {_CELL}")
    whole = []
    for _ in range(resolution - max(0, resolution - levels)):
        # children of one cell go on by themselves
        level = level.repartition("id", "cell")
        whole.append(level.filter((F.size("segments") == 0) & F.col("inside")).select("id", "cell"))
        level = map_rows(level.filter(F.size("segments") > 0), split, f"id {kind}, {_CELL}")
    found = level.filter("inside").select("id", "cell")
    for n, part in enumerate(whole):
        found = found.unionByName(uncompacted(part, resolution, resolution - max(0, resolution - levels) - n))
    return found
