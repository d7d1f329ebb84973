"""Registered queries of fusion (F) and tracks (K) over the ``events`` table, with DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shapes
from ..operators import episodes, tracks
from ..operators.footprint import with_footprint
from ..operators.runs import map_rows
from ..params import policy
from .cover_sql import FOOTPRINTS, track_cells_sql
from .views import DUCK_OBS, EVALUATION, LOOSE_CELL_FIRST, NOW, PAIRED_SQL, REGION_CELLS, flat_observations, micros, observations, paired_observations

POLICY = policy("fusion.v1")
#: Radius of the region of the paired view, as the grid's areas give it.
_REGION_KM = round(shapes.centroid({shapes.parsed(c)[1] for c in REGION_CELLS}, 6)[2], 6)
_CORNER = "2 * 6371.0088 * asin(sqrt(pow(sin(radians(0.1) / 2), 2) + cos(radians(44 + 0.3 * place_no)) * cos(radians(44 + 0.3 * place_no {s} 0.1)) * pow(sin(radians(0.1) / 2), 2)))"
_SQUARE_KM = f"(({_CORNER.format(s='+')}) + ({_CORNER.format(s='-')})) / 2"
US = f"epoch_us(TIMESTAMP '{EVALUATION}')"


def _usable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.usable(observations(spark, sf_dir), POLICY, NOW)[0]


def f01_future_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).filter(F.col("observed_at") <= F.lit(NOW)).groupBy("stance").agg(F.count(F.lit(1)).alias("n"))


def f02_f03_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.usable(observations(spark, sf_dir), POLICY, NOW)[1].groupBy("code", "evidence_id").agg(F.count(F.lit(1)).alias("n"))


def f05_place_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usable_rows(spark, sf_dir).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def f06_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy(episodes.hazard_class(F.col("kind")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def f07_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of each (class, place), numbered in fold order."""
    from pyspark.sql import Window

    w = Window.partitionBy("class", "key").orderBy(*episodes.ORDER)
    return _usable_rows(spark, sf_dir).withColumn("n", F.row_number().over(w)).select("class", "key", "n", "evidence_id", "stance")


def f09_contradicted_clears(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usable_rows(spark, sf_dir).filter("contradicted").select("evidence_id", "class", "key")


def f15_neutralized_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usable_rows(spark, sf_dir).filter("stance <> 'neutralized'").groupBy("class", "stance").agg(F.count(F.lit(1)).alias("n"))


def f13_episode_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threats alone, by gaps and islands: a new episode after the latest expiry so far."""
    return spark.sql(ISLANDS.replace("FROM obs", "FROM {obs}").replace("epoch_us(ts)", "us"), obs=flat_observations(spark, sf_dir).withColumn("us", micros("ts")).filter(F.col("us") <= _now_us()))


def f11_session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bombs alone have one ttl, so their episodes are session windows; a row at the very end of a gap still belongs."""
    threats = flat_observations(spark, sf_dir).filter("stance = 'threat' and class = 'bomb' and place_id like 'geonames:%'").withColumn("us", micros("ts")).filter(F.col("us") <= _now_us())
    by = threats.groupBy("class", "place_id", F.session_window(F.col("ts").cast("timestamp"), "5400 seconds"))
    return by.agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("n")).select("class", "place_id", "first_us", "last_us", "n")


def _now_us() -> int:
    return int(NOW.timestamp()) * 1_000_000


def _assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.assess(observations(spark, sf_dir), POLICY, NOW).assessments


def f10_f17_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assessments(spark, sf_dir).select(
        "assessment_id", "class", F.col("place.id").alias("place_id"), F.array_join("kinds", ",").alias("kinds"), "proximity", micros("valid_from").alias("from_us"), micros("valid_until").alias("until_us"),
        "status", "revision", "likelihood", "corroboration_count", F.array_join("active_sources", ",").alias("active_sources"),
    )


def f14_retractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = episodes.assess(observations(spark, sf_dir), POLICY, NOW).events.filter("kind = 'retracted'")
    return events.select("assessment_id", "seq", micros("effective_at").alias("at_us"), F.col("evidence.evidence_id").alias("evidence_id"), "reason")


def f16_status_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assessments(spark, sf_dir).groupBy("class", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("revision").alias("revisions"))


def f17_corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assessments(spark, sf_dir).groupBy("status", "likelihood", "corroboration_count").agg(F.count(F.lit(1)).alias("n"))


def f19_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.assess(observations(spark, sf_dir), POLICY, NOW).events.select("assessment_id", "seq", "kind", micros("effective_at").alias("at_us"), F.col("evidence.evidence_id").alias("evidence_id"), "reason")


def f04_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of each place's footprint: a disc of 10 km and one ring."""
    covered = with_footprint(_usable_rows(spark, sf_dir).select("key", "geometry").distinct(), POLICY)
    return covered.select("key", F.explode("footprint.cells").alias("cell")).distinct()


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.reports(observations(spark, sf_dir).filter(F.col("observed_at") <= F.lit(NOW)), POLICY)


def k01_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    spotted = observations(spark, sf_dir).withColumn("spot", tracks.spot(POLICY)).select(F.col("provenance.place_id").alias("place_id"), "spot.*").distinct()
    return spotted.select("place_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "radius_km")


def k02_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reports(spark, sf_dir).select("source_id", "evidence_id", "class", "stance", "kind", "count", F.size("places").alias("n_places"))


def k03_k04_report_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    aimed = F.filter("places", lambda p: ~p["via"])
    return _reports(spark, sf_dir).select("evidence_id", "class", "stance", F.element_at("places", 1)["id"].alias("position"), F.when(F.size(aimed) > 0, F.element_at(aimed, -1)["id"]).alias("target"))


def _grouped_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.reports(paired_observations(spark, sf_dir).filter(F.col("observed_at") <= F.lit(NOW)), POLICY)


def k01_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spots of points, polygons and regions; what has no place, or no valid geometry, has none."""
    spotted = paired_observations(spark, sf_dir).withColumn("spot", tracks.spot(POLICY)).withColumn("shape", F.col("geometry.type"))
    return spotted.groupBy("shape", F.col("provenance.place_id").alias("place_id")).agg(F.count(F.lit(1)).alias("n"), F.count("spot").alias("n_spots"), F.round(F.max("spot.radius_km"), 6).alias("radius_km"))


def k02_k05_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements with several hazards and places: the specific kind, the largest count, places in their order."""
    r = _grouped_reports(spark, sf_dir)
    return r.select("source_id", "evidence_id", "class", "stance", "kind", "count", F.array_join(F.transform("places", lambda p: p["id"]), ",").alias("places"))


def k04_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    aimed = F.filter("places", lambda p: ~p["via"])
    return _grouped_reports(spark, sf_dir).select("evidence_id", "class", "stance", F.element_at("places", 1)["id"].alias("position"), F.when(F.size(aimed) > 0, F.element_at(aimed, -1)["id"]).alias("target"))


def f02_f05_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left out and why, and the keys of the rest, of points, polygons, regions, cells without a place and broken geometries."""
    rows, skipped = episodes.usable(paired_observations(spark, sf_dir), POLICY, NOW)
    return skipped.select(F.col("code").alias("what")).unionByName(rows.select(F.col("key").alias("what"))).groupBy("what").agg(F.count(F.lit(1)).alias("n"))


def k06_quiet_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When tracks went quiet and stale."""
    return k18_track_events(spark, sf_dir).filter("kind in ('quiet', 'stale')").drop("evidence_id")


def k07_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kilometres that an object of each kind may have come after 0 to 5 hours; null for those matched in place only."""
    kinds = flat_observations(spark, sf_dir).select("kind").distinct().withColumn("hours", F.explode(F.sequence(F.lit(0), F.lit(5))))
    return map_rows(kinds, lambda r: [r | {"reach_km": tracks.range_km(POLICY.tracks, r["kind"], 3600.0 * r["hours"])}], "kind string, hours int, reach_km double")


def k08_fit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a drone at one place fits a report of another an hour later: at the same place or within reach, and whole metres."""
    pairs = flat_observations(spark, sf_dir).select(F.col("place_no").alias("a")).distinct().withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(4))))

    def fit(row: dict) -> list[dict]:
        place = lambda n: {"id": f"geonames:{n}", "via": False, "spot": {"lon": 22 + 0.7 * n, "lat": 44 + 0.3 * n, "radius_km": 10.0}}
        report = {"stance": "threat", "source_id": "s", "evidence_id": "e", "observed_at": NOW, "kind": "air.attack_drone", "places": [place(row["b"])]}
        before = NOW - timedelta(hours=1)
        track = tracks.Track(1, "t", "drone", "air.attack_drone", False, before, place(row["a"]), before, None, None, ("s", "f"), ("s",), None)
        return [row | {"how": int(away), "meters": meters} for _, away, meters, _, _ in tracks.fits([track], report, POLICY.tracks)]

    return map_rows(pairs, fit, "a int, b int, how int, meters long")


def k14_contradicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.with_contradictions(_reports(spark, sf_dir)).filter("contradicted").select("evidence_id", "class")


def k09_k13_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tracks.ended(observations(spark, sf_dir), POLICY, NOW)
    return found.select("track_id", "class", "kind", "count_unknown", F.col("position.id").alias("position"), F.col("target.id").alias("target"), "motion", "steps", "status", micros("first_at").alias("first_us"), micros("last_seen_at").alias("last_us"))


def k15_k17_track_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tracks.ended(observations(spark, sf_dir), POLICY, NOW)
    return tracks.with_cells(found, POLICY, NOW).select("track_id", "status", F.size("cells.cells").alias("n_cells"), F.size("region_cells.cells").alias("n_region_cells"))


def wide_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observations of towns, with these some 2,000 km apart, so that bombs of one town never are those of another."""
    n = F.substring_index("provenance.place_id", ":", -1).cast("int")
    rows = observations(spark, sf_dir).filter(F.col("provenance.place_id").startswith("geonames:"))
    return rows.withColumn("geometry", F.col("geometry").withField("coordinates", F.array((30.0 * n - 60).cast("double"), (3.0 * n + 44).cast("double"))))


def k09_k13_wide_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks over places that fall into several clusters."""
    found = tracks.ended(wide_observations(spark, sf_dir), POLICY, NOW)
    return found.select("track_id", "class", "kind", "count_unknown", F.col("position.id").alias("position"), F.col("target.id").alias("target"), "steps", "status", micros("first_at").alias("first_us"), micros("last_seen_at").alias("last_us"))


def k09_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters and islands in which these are walked: reports of each, and from when to when."""
    dealt = tracks.dealt(wide_observations(spark, sf_dir).filter(F.col("observed_at") <= F.lit(NOW)), POLICY)
    return dealt.groupBy("class", "cluster", "island").agg(F.count(F.lit(1)).alias("n"), F.min(micros("observed_at")).alias("first_us"), F.max(micros("observed_at")).alias("last_us"))


def k18_track_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.follow(observations(spark, sf_dir), POLICY, NOW)[1].select("track_id", "seq", "kind", micros("effective_at").alias("at_us"), F.col("evidence.evidence_id").alias("evidence_id"))


ISLANDS = """
WITH t AS (SELECT class, place_id, evidence_id, epoch_us(ts) AS us, epoch_us(ts) + ttl * CAST(1000000 AS BIGINT) AS until_us, kind_rank, source_id FROM obs
    WHERE stance = 'threat' AND place_id LIKE 'geonames:%'),
g AS (SELECT *, MAX(until_us) OVER (PARTITION BY class, place_id ORDER BY us, source_id, evidence_id, kind_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_us FROM t),
i AS (SELECT *, SUM(CASE WHEN before_us IS NULL OR us > before_us THEN 1 ELSE 0 END) OVER (PARTITION BY class, place_id ORDER BY us, source_id, evidence_id, kind_rank ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT class, place_id, CAST(island AS BIGINT) AS island, MIN(us) AS first_us, MAX(until_us) AS until_us, COUNT(*) AS n FROM i GROUP BY class, place_id, island
"""

_OBS = f"obs0 AS ({DUCK_OBS}), obs AS (SELECT *, epoch_us(ts) AS us, count AS n_objects FROM obs0 WHERE ts <= TIMESTAMP '{EVALUATION}')"
_KM = "2 * 6371.0088 * asin(sqrt(pow(sin(radians(0.3 * (b - a)) / 2), 2) + cos(radians(44 + 0.3 * a)) * cos(radians(44 + 0.3 * b)) * pow(sin(radians(0.7 * (b - a)) / 2), 2)))"
_QUIET = "(CASE class WHEN 'drone' THEN 3600 ELSE 1800 END * 1000000::BIGINT)"
# A place as a number: 0 to 4, or of a region 100 and ten for each, and where it lies.
_SPOT = "(CASE WHEN place_id LIKE 'geonames:%' THEN place_no ELSE 100 + 10 * substr(place_id, 11)::INT + place_no END)"
_same = lambda c: f"(CASE WHEN {c} >= 100 THEN {c} // 10 ELSE {c} END)"
_place_id = lambda c: f"CASE WHEN {c} >= 100 THEN 'ua-adm1:UA' || ({c} // 10 - 10) ELSE 'geonames:' || {c} END"
_STATE = "STRUCT(class VARCHAR, rn BIGINT, what VARCHAR, track_id VARCHAR, kind VARCHAR, unknown BOOLEAN, position INT, target INT, first_us BIGINT, last_us BIGINT, steps BIGINT, post VARCHAR, sources VARCHAR[], status VARCHAR, seq INT, happened VARCHAR, at_us BIGINT, evidence_id VARCHAR)[]"
_NEW_ID = "'fusion.v1/track/' || class || '/' || r_evidence || '#0#' || i"
_LIVE = ", ".join(f"was AND coalesce(e.u{i} >= r.us, false) AS l{i}" for i in range(4))
_NEXT = ", ".join(f"CASE WHEN stance = 'threat' THEN CASE WHEN s = {i} THEN us + ttl * CAST(1000000 AS BIGINT) WHEN l{i} THEN u{i} END WHEN hit THEN CASE WHEN s <> {i} AND l{i} THEN u{i} END ELSE u{i} END AS n{i}" for i in range(4))
#: The fold over each (class, place) as a recursion; four sources make four columns of expiry.
EPISODES = f"""
WITH RECURSIVE {_OBS},
x AS (SELECT class, place_id AS key, source_no AS s, evidence_id, stance, us, ttl, kind_rank, place_role <> 'via' AS aimed,
    CASE stance WHEN 'threat' THEN 0 ELSE 1 END AS stance_rank, source_id,
    stance = 'clear' AND bool_or(stance = 'threat') OVER (PARTITION BY source_id, evidence_id, class, place_id) AS contradicted
    FROM obs WHERE place_id LIKE 'geonames:%'),
r AS (SELECT *, row_number() OVER (PARTITION BY class, key ORDER BY us, source_id, evidence_id, stance_rank, kind_rank, ttl, aimed) AS rn FROM x WHERE stance <> 'neutralized'),
e(class, key, rn, open, first_id, first_us, until_us, u0, u1, u2, u3, rev, kinds, aimed, happened, at_us, evidence_id, old_id, old_first, old_until, old_rev, old_kinds, old_aimed, lapsed) AS (
    SELECT DISTINCT class, key, 0::BIGINT, false, NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, 0::BIGINT, 0::BIGINT, false,
        ''::VARCHAR, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT, 0::BIGINT, 0::BIGINT, false, false FROM r
    UNION ALL
    SELECT class, key, rn, CASE WHEN stance = 'threat' THEN true WHEN hit THEN coalesce(n0, n1, n2, n3) IS NOT NULL ELSE open END,
        CASE WHEN stance = 'threat' AND NOT was THEN evidence_id ELSE first_id END, CASE WHEN stance = 'threat' AND NOT was THEN us ELSE first_us END,
        CASE WHEN (stance = 'threat' OR hit) AND coalesce(n0, n1, n2, n3) IS NOT NULL THEN greatest(coalesce(n0, 0), coalesce(n1, 0), coalesce(n2, 0), coalesce(n3, 0)) ELSE until_us END,
        n0, n1, n2, n3, CASE WHEN stance <> 'threat' THEN rev WHEN was THEN rev + 1 ELSE 1 END,
        CASE WHEN stance <> 'threat' THEN kinds WHEN was THEN kinds | (1::BIGINT << kind_rank) ELSE 1::BIGINT << kind_rank END,
        CASE WHEN stance <> 'threat' THEN old_aimed WHEN was THEN old_aimed OR row_aimed ELSE row_aimed END,
        CASE WHEN stance = 'threat' THEN CASE WHEN was THEN 'superseded' ELSE 'issued' END WHEN hit AND coalesce(n0, n1, n2, n3) IS NULL THEN 'retracted' ELSE '' END,
        us, evidence_id, first_id, first_us, until_us, rev, kinds, old_aimed, stance = 'threat' AND open AND NOT was
    FROM (SELECT *, stance = 'clear' AND NOT contradicted AND CASE s WHEN 0 THEN l0 WHEN 1 THEN l1 WHEN 2 THEN l2 ELSE l3 END AS hit, {_NEXT} FROM (
        SELECT r.class, r.key, r.rn, r.s, r.evidence_id, r.stance, r.us, r.ttl, r.kind_rank, r.aimed AS row_aimed, r.contradicted,
            e.open, e.first_id, e.first_us, e.until_us, e.u0, e.u1, e.u2, e.u3, e.rev, e.kinds, e.aimed AS old_aimed, e.open AND r.us <= e.until_us AS was, {_LIVE}
        FROM e JOIN r ON r.class = e.class AND r.key = e.key AND r.rn = e.rn + 1))),
last AS (SELECT *, row_number() OVER (PARTITION BY class, key ORDER BY rn DESC) AS back FROM e WHERE rn > 0),
done AS (
    SELECT class, key, old_id AS first_id, old_first AS first_us, old_until AS until_us, old_rev AS rev, old_kinds AS kinds, old_aimed AS aimed, 'expired' AS status, NULL::BIGINT AS u0, NULL::BIGINT AS u1, NULL::BIGINT AS u2, NULL::BIGINT AS u3 FROM e WHERE lapsed
    UNION ALL SELECT class, key, first_id, first_us, until_us, rev, kinds, aimed, 'retracted', NULL, NULL, NULL, NULL FROM e WHERE happened = 'retracted'
    UNION ALL SELECT class, key, first_id, first_us, until_us, rev, kinds, aimed, CASE WHEN until_us <= {US} THEN 'expired' ELSE 'active' END, u0, u1, u2, u3 FROM last WHERE back = 1 AND open),
src AS (SELECT *, list_filter([CASE WHEN u0 > {US} THEN 'telegram.channel:ch0' END, CASE WHEN u1 > {US} THEN 'telegram.channel:ch1' END, CASE WHEN u2 > {US} THEN 'telegram.channel:ch2' END, CASE WHEN u3 > {US} THEN 'telegram.channel:ch3' END], lambda x: x IS NOT NULL) AS active FROM done),
assessments AS (SELECT 'fusion.v1/' || class || '/' || key || '/' || first_id AS assessment_id, class, key AS place_id,
    array_to_string(list_filter([CASE WHEN kinds & 1 > 0 THEN 'air.ballistic_missile' END, CASE WHEN kinds & 2 > 0 THEN 'air.missile' END, CASE WHEN kinds & 4 > 0 THEN 'air.attack_drone' END, CASE WHEN kinds & 8 > 0 THEN 'air.jet_drone' END, CASE WHEN kinds & 16 > 0 THEN 'air.guided_bomb' END], lambda x: x IS NOT NULL), ',') AS kinds,
    CASE WHEN aimed THEN 'target' ELSE 'nearby' END AS proximity, first_us AS from_us, until_us, status, rev::INT AS revision, CASE WHEN len(active) >= 2 THEN 'high' ELSE 'moderate' END AS likelihood,
    len(active)::INT AS corroboration_count, array_to_string(active, ',') AS active_sources FROM src),
log AS (
    SELECT 'fusion.v1/' || class || '/' || key || '/' || old_id AS assessment_id, (old_rev + 1)::INT AS seq, 'expired' AS kind, old_until AS at_us, NULL::VARCHAR AS evidence_id, NULL::VARCHAR AS reason FROM e WHERE lapsed
    UNION ALL SELECT 'fusion.v1/' || class || '/' || key || '/' || first_id, (rev + (happened = 'retracted')::INT)::INT, happened, at_us, evidence_id, CASE WHEN happened = 'retracted' THEN 'source_all_clear' END FROM e WHERE happened <> ''
    UNION ALL SELECT 'fusion.v1/' || class || '/' || key || '/' || first_id, (rev + 1)::INT, 'expired', until_us, NULL, NULL FROM last WHERE back = 1 AND open AND until_us <= {US})
"""
#: The walk over each class's reports as a recursion: a row for each live track and one that begins new ones.
TRACKS = f"""
WITH RECURSIVE {_OBS},
rep AS (SELECT us, source_id, evidence_id, class, stance, min(kind) AS kind, max(n_objects) AS n, any_value({_SPOT}) AS place, any_value(CASE WHEN place_role <> 'via' THEN {_SPOT} END) AS aim FROM obs GROUP BY us, source_id, evidence_id, class, stance),
threats AS (SELECT DISTINCT source_id, evidence_id, class, {_same('place')} AS place FROM rep WHERE stance = 'threat'),
r AS (SELECT rep.*, stance = 'clear' AND EXISTS (SELECT 1 FROM threats t WHERE t.source_id = rep.source_id AND t.evidence_id = rep.evidence_id AND t.class = rep.class AND t.place = {_same('rep.place')}) AS contradicted,
    row_number() OVER (PARTITION BY class ORDER BY us, source_id, evidence_id, CASE stance WHEN 'threat' THEN 0 WHEN 'neutralized' THEN 1 ELSE 2 END) AS rn FROM rep),
km AS (SELECT a::INT AS a, b::INT AS b, {_KM} AS km FROM range(0, 5) s(a), range(0, 5) t(b)),
w(class, rn, what, track_id, kind, unknown, position, target, first_us, last_us, steps, post, sources, status, seq, happened, at_us, evidence_id) AS (
    SELECT DISTINCT class, 0::BIGINT, 'start', NULL::VARCHAR, NULL::VARCHAR, false, NULL::INT, NULL::INT, NULL::BIGINT, NULL::BIGINT, 0::BIGINT, NULL::VARCHAR, []::VARCHAR[], NULL::VARCHAR, 0::INT, NULL::VARCHAR, NULL::BIGINT, NULL::VARCHAR FROM r
    UNION ALL
    SELECT unnest(out, max_depth := 2) FROM (
        SELECT CAST(list_filter([
            CASE WHEN what = 'start' THEN row(class, rn, 'start', NULL, NULL, false, NULL, NULL, NULL, NULL, 0, NULL, [], NULL, 0, NULL, NULL, NULL) END,
            CASE WHEN grows_quiet THEN row(class, rn, 'event', track_id, NULL, false, NULL, NULL, NULL, NULL, 0, NULL, [], NULL, seq + 1, 'quiet', last_us + quiet_us, NULL) END,
            CASE WHEN stale THEN row(class, rn, 'event', track_id, NULL, false, NULL, NULL, NULL, NULL, 0, NULL, [], NULL, aged_seq, 'stale', last_us + 21600000000, NULL) END,
            CASE WHEN taken AND stance <> 'clear' OR ends THEN row(class, rn, 'event', track_id, NULL, false, NULL, NULL, NULL, NULL, 0, NULL, [], NULL, aged_seq + 1, CASE stance WHEN 'threat' THEN 'moved' WHEN 'clear' THEN 'cleared' ELSE 'neutralized' END, us, r_evidence) END,
            CASE WHEN what = 'track' THEN row(class, rn, CASE WHEN stale OR ends OR taken AND stance = 'neutralized' THEN 'done' ELSE 'track' END, track_id,
                CASE WHEN taken AND stance = 'threat' AND r_kind IN ('air.jet_drone', 'air.ballistic_missile') AND kind NOT IN ('air.jet_drone', 'air.ballistic_missile') THEN r_kind ELSE kind END, unknown,
                CASE WHEN taken AND stance = 'threat' THEN r_place ELSE position END, CASE WHEN taken AND stance = 'threat' THEN coalesce(aim, target) ELSE target END, first_us, CASE WHEN taken AND stance = 'threat' THEN us ELSE last_us END,
                steps + (taken AND stance = 'threat')::INT, CASE WHEN taken AND stance = 'threat' THEN r_post ELSE post END,
                CASE WHEN withdraws THEN list_filter(sources, lambda x: x <> r_source) WHEN taken AND stance = 'threat' AND NOT list_contains(sources, r_source) THEN list_append(sources, r_source) ELSE sources END,
                CASE WHEN stale THEN 'stale' WHEN ends THEN 'cleared' WHEN taken AND stance = 'neutralized' THEN 'neutralized' WHEN taken AND stance = 'threat' THEN 'active' WHEN grows_quiet THEN 'quiet' ELSE status END,
                aged_seq + (taken AND stance <> 'clear' OR ends)::INT, NULL, NULL, NULL) END], lambda x: x IS NOT NULL)
            || CASE WHEN what = 'start' AND stance = 'threat' THEN flatten(list_transform(range(1, 1 + CASE WHEN n IS NULL THEN (n_taken = 0)::BIGINT ELSE n - n_taken END), lambda i: [
                row(class, rn, 'track', {_NEW_ID}, r_kind, n IS NULL, r_place, aim, us, us, 1, r_post, [r_source], 'active', 1, NULL, NULL, NULL),
                row(class, rn, 'event', {_NEW_ID}, NULL, false, NULL, NULL, NULL, NULL, 0, NULL, [], NULL, 1, 'started', us, r_evidence)])) ELSE [] END AS {_STATE}) AS out
        FROM (SELECT *, coalesce(withdraws AND len(sources) = 1, false) AS ends, count(*) FILTER (taken) OVER (PARTITION BY class) AS n_taken FROM (
            SELECT *, coalesce(fit AND CASE stance WHEN 'threat' THEN CASE WHEN n IS NOT NULL THEN nth <= n WHEN n_same > 0 THEN same ELSE nth = 1 END WHEN 'neutralized' THEN nth <= coalesce(n, 1) ELSE false END, false) AS taken,
                coalesce(what = 'track' AND NOT stale AND stance = 'clear' AND NOT contradicted AND list_contains(sources, r_source) AND ({_same('r_place')} = {_same('position')} OR {_same('r_place')} = {_same('target')}), false) AS withdraws FROM (
                SELECT *, row_number() OVER (PARTITION BY class, fit ORDER BY CASE WHEN stance = 'neutralized' THEN kind <> r_kind ELSE false END, NOT same, meters, track_id) AS nth, count(*) FILTER (fit AND same) OVER (PARTITION BY class) AS n_same FROM (
                    SELECT *, coalesce(what = 'track' AND NOT stale AND CASE stance WHEN 'threat' THEN post <> r_post WHEN 'neutralized' THEN NOT unknown ELSE false END AND (same OR km <= reach + 20), false) AS fit, seq + grows_quiet::INT + stale::INT AS aged_seq FROM (
                        SELECT w.class, r.rn, w.what, w.track_id, w.kind, w.unknown, w.position, w.target, w.first_us, w.last_us, w.steps, w.post, w.sources, w.status, w.seq, r.us, r.stance, r.n, r.aim, r.contradicted, r.kind AS r_kind, r.place AS r_place,
                            r.source_id AS r_source, r.evidence_id AS r_evidence, r.source_id || ' ' || r.evidence_id AS r_post, km.km, floor(km.km * 1000)::BIGINT AS meters,
                            coalesce(w.what = 'track' AND w.status = 'active' AND w.last_us + {_QUIET.replace('class', 'w.class')} <= r.us, false) AS grows_quiet, {_QUIET.replace('class', 'w.class')} AS quiet_us, coalesce(w.what = 'track' AND w.last_us + 21600000000 <= r.us, false) AS stale,
                            coalesce({_same('r.place')} = {_same('w.position')}, false) OR coalesce({_same('r.place')} = {_same('w.target')}, false) OR r.stance = 'threat' AND coalesce({_same('r.aim')} = {_same('w.target')}, false) AS same,
                            CASE w.kind WHEN 'air.guided_bomb' THEN 80.0 WHEN 'air.attack_drone' THEN 200.0 * (r.us - w.last_us) / 3.6e9 + 10 WHEN 'air.jet_drone' THEN 700.0 * (r.us - w.last_us) / 3.6e9 + 10 WHEN 'air.missile' THEN 1000.0 * (r.us - w.last_us) / 3.6e9 + 10 END AS reach
                        FROM w JOIN r ON r.class = w.class AND r.rn = w.rn + 1 AND w.what IN ('track', 'start') LEFT JOIN km ON km.a = w.position % 10 AND km.b = r.place % 10))))))),
final AS (SELECT *, {_QUIET} AS quiet_us FROM w WHERE what = 'track' AND rn = (SELECT max(rn) FROM r WHERE r.class = w.class)),
tracks AS (SELECT track_id, class, kind, unknown, position, target, steps, status, first_us, last_us FROM w WHERE what = 'done'
    UNION ALL SELECT track_id, class, kind, unknown, position, target, steps, CASE WHEN last_us + 21600000000 <= {US} THEN 'stale' WHEN last_us + quiet_us <= {US} THEN 'quiet' ELSE status END, first_us, last_us FROM final),
events AS (SELECT track_id, seq, happened, at_us, evidence_id FROM w WHERE what = 'event'
    UNION ALL SELECT track_id, seq + 1, 'quiet', last_us + quiet_us, NULL FROM final WHERE status = 'active' AND last_us + quiet_us <= {US}
    UNION ALL SELECT track_id, seq + 1 + (status = 'active')::INT, 'stale', last_us + 21600000000, NULL FROM final WHERE last_us + 21600000000 <= {US})
"""
#: The same walk over towns that lie far apart.
_WIDE_KM = "2 * 6371.0088 * asin(sqrt(pow(sin(radians(3.0 * (b - a)) / 2), 2) + cos(radians(44 + 3.0 * a)) * cos(radians(44 + 3.0 * b)) * pow(sin(radians(30.0 * (b - a)) / 2), 2)))"
_WIDE_OBS = _OBS + ", towns AS (SELECT * FROM obs WHERE place_id LIKE 'geonames:%')"
WIDE_TRACKS = TRACKS.replace(_OBS, _WIDE_OBS).replace(_KM, _WIDE_KM).replace("FROM obs GROUP BY us", "FROM towns GROUP BY us")
#: Reports of the paired view.
GROUPED = f"""
WITH p AS ({PAIRED_SQL}),
seen AS (SELECT * FROM p WHERE place_id IS NOT NULL AND NOT broken AND shape IN ('point', 'polygon', 'region') AND ts <= TIMESTAMP '{EVALUATION}'),
named AS (SELECT ts, source_id, evidence_id, class, stance, place_id AS id, min(place_order) AS nth, arg_min(via, place_order * 2 + via::INT) AS via FROM seen GROUP BY ALL),
lists AS (SELECT ts, source_id, evidence_id, class, stance, list({{'id': id, 'via': via}} ORDER BY nth, id) AS places FROM named GROUP BY ALL),
grouped AS (SELECT s.ts, s.source_id, s.evidence_id, s.class, s.stance, arg_min(s.kind, (CASE WHEN s.kind IN ('air.jet_drone', 'air.ballistic_missile') THEN 0 ELSE 10 END) + s.kind_rank) AS kind, max(s.count) AS count, any_value(l.places) AS places
    FROM seen s JOIN lists l USING (ts, source_id, evidence_id, class, stance) GROUP BY s.ts, s.source_id, s.evidence_id, s.class, s.stance)
"""
_CLASS_KM = "2 * 6371.0088 * asin(sqrt(pow(sin(radians(0.3 * (b - a)) / 2), 2) + cos(radians(44 + 0.3 * a)) * cos(radians(44 + 0.3 * b)) * pow(sin(radians(0.7 * (b - a)) / 2), 2)))"

SQL: dict[str, str] = {
    "F01_future_filter": f"WITH {_OBS} SELECT stance, count(*) AS n FROM obs GROUP BY stance",
    "F02_F03_skipped": f"WITH {_OBS} SELECT 'region' AS code, evidence_id, count(*) AS n FROM obs WHERE place_id LIKE 'ua-adm1:%' GROUP BY evidence_id",
    "F05_place_keys": f"WITH {_OBS} SELECT place_id AS key, count(*) AS n FROM obs WHERE place_id LIKE 'geonames:%' GROUP BY place_id",
    "F04_footprints": f"WITH {_OBS}, {FOOTPRINTS}",
    "F06_class_counts": f"SELECT class, count(*) AS n FROM ({DUCK_OBS}) GROUP BY class",
    "F07_order": f"""WITH {_OBS} SELECT class, key, n, evidence_id, stance FROM (SELECT class, place_id AS key, evidence_id, stance, row_number() OVER (PARTITION BY class, place_id
        ORDER BY us, source_id, evidence_id, CASE stance WHEN 'threat' THEN 0 WHEN 'clear' THEN 1 ELSE 2 END, kind_rank, ttl)::INT AS n FROM obs WHERE place_id LIKE 'geonames:%')""",
    "F09_contradicted_clears": f"WITH {_OBS} SELECT evidence_id, class, place_id AS key FROM obs a WHERE stance = 'clear' AND place_id LIKE 'geonames:%' AND EXISTS (SELECT 1 FROM obs b WHERE b.stance = 'threat' AND b.evidence_id = a.evidence_id AND b.source_id = a.source_id AND b.class = a.class AND b.place_id = a.place_id)",
    "F15_neutralized_ignored": f"WITH {_OBS} SELECT class, stance, count(*) AS n FROM obs WHERE place_id LIKE 'geonames:%' AND stance <> 'neutralized' GROUP BY class, stance",
    "F13_episode_islands": f"WITH {_OBS} SELECT * FROM ({ISLANDS})",
    "F11_session_windows": f"""WITH {_OBS} SELECT class, place_id, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM (SELECT *, sum(CASE WHEN us - before > 5400000000 OR before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY place_id ORDER BY us, evidence_id ROWS UNBOUNDED PRECEDING) AS g
        FROM (SELECT *, lag(us) OVER (PARTITION BY place_id ORDER BY us, evidence_id) AS before FROM obs WHERE stance = 'threat' AND class = 'bomb' AND place_id LIKE 'geonames:%')) GROUP BY class, place_id, g""",
    "F10_F17_assessments": EPISODES + "SELECT * FROM assessments",
    "F14_retractions": EPISODES + "SELECT assessment_id, seq, at_us, evidence_id, reason FROM log WHERE kind = 'retracted'",
    "F16_status_by_class": EPISODES + "SELECT class, status, count(*) AS n, sum(revision)::BIGINT AS revisions FROM assessments GROUP BY class, status",
    "F17_corroboration": EPISODES + "SELECT status, likelihood, corroboration_count, count(*) AS n FROM assessments GROUP BY ALL",
    "F19_event_log": EPISODES + "SELECT * FROM log",
    "K01_spots": f"SELECT DISTINCT place_id, round((22 + 0.7 * place_no)::DOUBLE, 6) AS lon, round((44 + 0.3 * place_no)::DOUBLE, 6) AS lat, 10.0::DOUBLE AS radius_km FROM ({DUCK_OBS})",
    "K02_reports": f"WITH {_OBS} SELECT source_id, evidence_id, class, stance, min(kind) AS kind, max(n_objects) AS count, 1 AS n_places FROM obs GROUP BY us, source_id, evidence_id, class, stance",
    "K03_K04_report_places": f"WITH {_OBS} SELECT DISTINCT evidence_id, class, stance, place_id AS position, CASE WHEN place_role <> 'via' THEN place_id END AS target FROM obs",
    "K07_reach": f"SELECT kind, hours::INT AS hours, (CASE kind WHEN 'air.guided_bomb' THEN 80.0 WHEN 'air.attack_drone' THEN 200.0 * hours + 10 WHEN 'air.jet_drone' THEN 700.0 * hours + 10 WHEN 'air.missile' THEN 1000.0 * hours + 10 END)::DOUBLE AS reach_km FROM (SELECT DISTINCT kind FROM ({DUCK_OBS})), range(0, 6) t(hours)",
    "K08_fit_scores": f"SELECT a::INT AS a, b::INT AS b, (a <> b)::INT AS how, floor({_CLASS_KM} * 1000)::BIGINT AS meters FROM (SELECT DISTINCT place_no AS a FROM ({DUCK_OBS})), range(0, 5) t(b) WHERE a = b OR {_CLASS_KM} <= 230",
    "K06_quiet_stale": TRACKS + "SELECT track_id, seq, happened AS kind, at_us FROM events WHERE happened IN ('quiet', 'stale')",
    "K09_K13_tracks": TRACKS + f"SELECT track_id, class, kind, unknown AS count_unknown, {_place_id('position')} AS position, {_place_id('target')} AS target, CASE WHEN target IS NULL THEN 'unknown' ELSE 'heading' END AS motion, steps::INT AS steps, status, first_us, last_us FROM tracks",
    "K09_K13_wide_tracks": WIDE_TRACKS + f"SELECT track_id, class, kind, unknown AS count_unknown, {_place_id('position')} AS position, {_place_id('target')} AS target, steps::INT AS steps, status, first_us, last_us FROM tracks",
    "K09_clusters": f"""WITH {_WIDE_OBS}, r AS (SELECT DISTINCT us, source_id, evidence_id, class, stance, CASE class WHEN 'bomb' THEN place_id ELSE (SELECT min(place_id) FROM towns t WHERE t.class = towns.class) END AS cluster FROM towns),
        g AS (SELECT *, us - lag(us) OVER (PARTITION BY class, cluster ORDER BY us) >= 21600000000 AS silent FROM r), i AS (SELECT *, coalesce(sum(silent::INT) OVER (PARTITION BY class, cluster ORDER BY us), 0)::BIGINT AS island FROM g)
        SELECT class, cluster, island, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM i GROUP BY ALL""",
    "K15_K17_track_cells": TRACKS + f", {track_cells_sql(US)}",
    "K18_track_events": TRACKS + "SELECT track_id, seq, happened AS kind, at_us, evidence_id FROM events",
    "K01_shapes": f"WITH p AS ({PAIRED_SQL}) SELECT shape, place_id, count(*) AS n, count(*) FILTER (place_id IS NOT NULL AND NOT broken AND shape IN ('point', 'polygon', 'region')) AS n_spots, round(max(CASE WHEN place_id IS NULL OR broken THEN NULL WHEN shape = 'point' THEN 10.0 WHEN shape = 'polygon' THEN {_SQUARE_KM} WHEN shape = 'region' THEN {_REGION_KM!r} END)::DOUBLE, 6) AS radius_km FROM p GROUP BY ALL".replace("SELECT shape, place_id", "SELECT CASE shape WHEN 'region' THEN 'cells' ELSE shape END AS shape, place_id").replace("GROUP BY ALL", "GROUP BY CASE shape WHEN 'region' THEN 'cells' ELSE shape END, place_id"),
    "K02_K05_grouped": GROUPED + "SELECT source_id, evidence_id, class, stance, kind, count, array_to_string(list_transform(places, lambda p: p.id), ',') AS places FROM grouped",
    "K04_targets": GROUPED + "SELECT evidence_id, class, stance, places[1].id AS position, list_filter(places, lambda p: NOT p.via)[-1].id AS target FROM grouped",
    "F02_F05_paired": f"WITH p AS ({PAIRED_SQL}) SELECT CASE WHEN broken THEN 'invalid_geometry' WHEN shape = 'region' THEN 'region' WHEN place_id IS NULL THEN 'cells:{LOOSE_CELL_FIRST}' ELSE place_id END AS what, count(*) AS n FROM p WHERE ts <= TIMESTAMP '{EVALUATION}' GROUP BY ALL",
    "K14_contradicted": f"WITH {_OBS} SELECT DISTINCT evidence_id, class FROM obs a WHERE stance = 'clear' AND EXISTS (SELECT 1 FROM obs b WHERE b.stance = 'threat' AND b.evidence_id = a.evidence_id AND b.class = a.class AND b.place_id = a.place_id)",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "F01_future_filter": f01_future_filter, "F02_F03_skipped": f02_f03_skipped, "F04_footprints": f04_footprints, "F05_place_keys": f05_place_keys, "F06_class_counts": f06_class_counts, "F07_order": f07_order,
    "F09_contradicted_clears": f09_contradicted_clears, "F10_F17_assessments": f10_f17_assessments, "F11_session_windows": f11_session_windows, "F13_episode_islands": f13_episode_islands,
    "F14_retractions": f14_retractions, "F15_neutralized_ignored": f15_neutralized_ignored, "F16_status_by_class": f16_status_by_class, "F17_corroboration": f17_corroboration, "F19_event_log": f19_event_log,
    "K01_spots": k01_spots, "K02_reports": k02_reports, "K03_K04_report_places": k03_k04_report_places, "K01_shapes": k01_shapes, "K02_K05_grouped": k02_k05_grouped, "K04_targets": k04_targets, "F02_F05_paired": f02_f05_paired, "K06_quiet_stale": k06_quiet_stale, "K07_reach": k07_reach,
    "K08_fit_scores": k08_fit_scores, "K09_K13_tracks": k09_k13_tracks, "K14_contradicted": k14_contradicted, "K15_K17_track_cells": k15_k17_track_cells, "K09_K13_wide_tracks": k09_k13_wide_tracks, "K09_clusters": k09_clusters, "K18_track_events": k18_track_events,
}
