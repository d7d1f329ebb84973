"""Registered queries of the joins by levels (J): cells in covers, and reports among what was valid at their time, with DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import h3bits, h3cells
from ..operators import episodes, lookups, regions
from ..operators.shared import written
from . import fusion_queries as fusion
from .grid_queries import _AT_6, _cells, _up
from .views import NOW, micros, observations


def j01_cells_in_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which customers lie in which nation's cover: cells of three resolutions around some of its customers, some within others."""
    cells = _cells(spark, sf_dir)
    level = (F.floor(F.col("c_custkey") / 10) % 3 + 1).cast("int")
    around = F.coalesce(*(F.when(level == r, h3bits.parent(F.col("cell"), r)) for r in (1, 2, 3)))
    nation = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    covers = cells.filter("c_custkey % 10 = 0").join(nation, "c_custkey").select("c_nationkey", around.alias("cover_cell"))
    found = lookups.in_covers(cells.select("c_custkey", "cell"), lookups.outermost(covers, ("c_nationkey",)))
    return found.select("c_custkey", "c_nationkey", h3bits.to_text("cover_cell").alias("cover"))


def j01_positions_in_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscribers near the places of the events, and the assessments whose compacted cells hold them."""
    c, n = spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("c_custkey") % 7
    near = (F.col("c_custkey") % 50 - 25) / 1000.0
    positions = c.select("c_custkey", h3cells.cell_of((22 + 0.7 * n).cast("double"), (44 + 0.3 * n + near).cast("double"), F.lit(8)).alias("cell"))
    assessed = episodes.assess(observations(spark, sf_dir), fusion.POLICY, NOW).assessments
    # a place's cover is compacted once, not once an assessment
    places = written(assessed.select("class", F.col("place.id").alias("place_id"), "status", F.col("cells.cells").alias("cells")), "places")
    fine = places.dropDuplicates(["place_id"]).select("place_id", F.explode("cells").alias("text")).select("place_id", h3bits.parse(F.col("text")).alias("cell"))
    covers = regions.compacted(fine, "place_id", 2).withColumnRenamed("cell", "cover_cell")
    counts = places.groupBy("place_id", "class").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "active").alias("n_active"))
    return lookups.in_covers(positions, covers).join(counts, "place_id").select("c_custkey", "place_id", "class", "n", "n_active")


def j02_valid_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many assessments of its class were valid when a report was made, and the first of them by id."""
    # read twice, for the levels and for the join
    assessed = written(fusion.f10_f17_assessments(spark, sf_dir).select("class", "assessment_id", "from_us", "until_us"), "assessments")
    found = lookups.at_times(_reports(spark, sf_dir), assessed, "at_us", "from_us", "until_us", ("class",))
    return found.groupBy("evidence_id", "class", "stance").agg(F.count(F.lit(1)).alias("n_valid"), F.min("assessment_id").alias("first_id"))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).filter(F.col("observed_at") <= F.lit(NOW))
    return rows.select(episodes.hazard_class(F.col("kind")).alias("class"), F.col("provenance.evidence_id").alias("evidence_id"), "stance", micros("observed_at").alias("at_us"))


_holds = lambda outer, inner: "(" + " OR ".join(f"({outer} >> 52) & 15 = {r} AND {_up(inner, r)} = {outer} AND ({inner} >> 52) & 15 >= {r}" for r in (1, 2, 3)) + ")"

SQL: dict[str, str] = {
    "J01_cells_in_covers": f"""WITH {_AT_6}, c AS (SELECT DISTINCT c_nationkey, CASE c_custkey // 10 % 3 WHEN 0 THEN {_up('cell', 1)} WHEN 1 THEN {_up('cell', 2)} ELSE {_up('cell', 3)} END AS cover FROM cells JOIN customer ON c_custkey = id WHERE c_custkey % 10 = 0),
        o AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.c_nationkey = c.c_nationkey AND d.cover <> c.cover AND {_holds('d.cover', 'c.cover')}))
        SELECT id AS c_custkey, c_nationkey, printf('%x', cover) AS cover FROM cells JOIN o ON {_holds('cover', 'cell')}""",
    "J01_positions_in_assessments": fusion.EPISODES + """SELECT c_custkey, place_id, class, count(*) AS n, count(*) FILTER (status = 'active') AS n_active FROM customer JOIN assessments ON place_id = 'geonames:' || (c_custkey % 7) GROUP BY ALL""",
    "J02_valid_at": fusion.EPISODES + """SELECT evidence_id, o.class, stance, count(*) AS n_valid, min(assessment_id) AS first_id FROM obs o JOIN assessments a ON a.class = o.class AND o.us BETWEEN a.from_us AND a.until_us GROUP BY ALL""",
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"J01_cells_in_covers": j01_cells_in_covers, "J01_positions_in_assessments": j01_positions_in_assessments, "J02_valid_at": j02_valid_at}
