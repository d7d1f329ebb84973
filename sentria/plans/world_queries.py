"""Registered queries of the bridge's expressions (B), the sphere (G), sources (S) and the protocol (R), with DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sphere
from ..operators import bridge
from ..operators.vocabulary import reach_km, wanted_place
from ..params import EARTH_KM, policy
from ..sources import ndjson, preview
from . import point_queries, runtime
from . import reader_queries as R

def _stand_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings made from orders, to hold the bridge's expressions against SQL."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    kind = F.element_at(F.array(*map(F.lit, ("drone", "guided_bomb", "cruise_missile", "ballistic_missile", "missile"))), (F.col("o_custkey") % 5 + 1).cast("int"))
    phase = F.when(F.col("o_orderstatus") == "F", "cleared").when(F.col("o_orderstatus") == "P", "intercepted").otherwise("threat")
    return o.select("o_orderkey", F.when(F.col("o_custkey") % 7 > 0, kind).alias("kind"), phase.alias("phase"), (F.col("o_custkey") % 4).cast("int").alias("count"))


def b05_b07_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bridge.twinned(_stand_in(spark, sf_dir).filter("kind is not null"))
    return rows.select("o_orderkey", F.element_at(bridge._map(bridge.CONTRACT_KIND), F.col("kind")).alias("kind"), F.col("said.stance").alias("stance"), F.col("said.of_count").alias("count"), bridge.ttl_seconds(F.col("kind"), F.col("said.stance")).alias("ttl"))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", (22 + 0.7 * n).cast("double").alias("lon"), (44 + 0.3 * n).cast("double").alias("lat"))


def g02_disc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = _nations(spark, sf_dir).select("n_nationkey", F.posexplode(sphere.disc(sphere.position(F.col("lon"), F.col("lat")), 12.0)).alias("corner", "p"))
    return ring.select("n_nationkey", "corner", F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"))


def g11_haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _nations(spark, sf_dir)
    other = sphere.position(22 + 0.7 * F.col("b"), 44 + 0.3 * F.col("b"))
    pairs = a.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(24))))
    return pairs.select("n_nationkey", "b", F.round(sphere.haversine_km(sphere.position(F.col("lon"), F.col("lat")), other), 6).alias("km"))


def g14_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return p.select("s_suppkey", sphere.valid_position(sphere.position(F.col("s_acctbal") / 40, F.col("s_acctbal") / 100)).alias("valid"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def s09_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", F.md5(preview.plain_text("html").cast("binary")).alias("text"))


def s11_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    style = F.concat(F.lit("width:10px;background-image:url('"), F.regexp_replace("url", "^http:", "https:"), F.lit("')"))
    return _pages(spark, sf_dir).select("page_id", preview.background_image_url(style).alias("url"))


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select((F.col("event_id") % 3000).alias("post_id"), F.concat(F.lit("telegram.channel:ch"), (F.col("user_id") % 4).cast("string")).alias("source_id"), F.concat(F.lit("ch/"), (F.col("event_id") % 3000).cast("string")).alias("external_id"), F.lit(None).cast("string").alias("code"), (F.col("event_id") % 50).alias("older"))


def s13_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview.deduplicated(_posts(spark, sf_dir)).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.min("post_id").alias("oldest"), F.max("post_id").alias("newest"))


def s14_s15_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview.windowed(_posts(spark, sf_dir), before=2000, after=40).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.min("older").alias("older"))


def s17_channel_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("https://t.me/s/Chan_"), F.col("c_custkey").cast("string"), F.lit("/"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("@X"), F.col("c_custkey").cast("string"))).otherwise(F.col("c_name"))
    return c.select("c_custkey", preview.channel_name(raw).alias("channel"))


def s30_s33_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as rows of a place dump: what is kept, and how far it reaches."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    code = F.element_at(F.array(*map(F.lit, ("PPL", "PPLX", "PPLA", "PPLW", "PPLC"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    dump = s.select("s_suppkey", F.when(F.col("s_suppkey") % 9 == 0, "A").otherwise("P").alias("class"), code.alias("code"), F.floor(F.abs("s_acctbal") * 40).alias("population"))
    return dump.filter(wanted_place()).select("s_suppkey", "code", "population", reach_km("population").alias("reach_km"))


def s01_wire_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", ndjson.wire_time(F.timestamp_micros(F.lit(1704067200000000) + F.col("event_id") * 250000)).alias("wire"))


def r02_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = runtime.capabilities()
    return spark.createDataFrame([(",".join(c["operations"]), ",".join(c["readers"]), ",".join(c["policies"]), *(c["limits"][k] for k in ("evidence", "observations", "cells")))], "operations string, readers string, policies string, evidence int, observations int, cells int")


def r01_r07_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests made from nations: covers, unknown operations, wrong versions, broken JSON."""
    n = _nations(spark, sf_dir)
    body = F.concat(F.lit('{"protocol_version":"signal.v1","request_id":"r'), F.col("n_nationkey").cast("string"), F.lit('","operation":"cover","payload":{"geometry":{"type":"point","coordinates":['), F.col("lon").cast("string"), F.lit(","), F.col("lat").cast("string"), F.lit(']},"rings":1}}'))
    text = F.when(F.col("n_nationkey") % 5 == 1, F.replace(body, F.lit('"cover"'), F.lit('"dance"'))).when(F.col("n_nationkey") % 5 == 2, F.replace(body, F.lit("signal.v1"), F.lit("signal.v0"))).when(F.col("n_nationkey") % 5 == 3, F.lit("{")).otherwise(body)
    answers = runtime.handle_stream(n.select(text.alias("value")))
    return answers.select(F.get_json_object("value", "$.request_id").alias("request_id"), F.get_json_object("value", "$.failure.code").alias("code"), F.size(F.from_json(F.get_json_object("value", "$.result.cells"), "array<string>")).alias("n_cells"))


def r03_r05_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to assess and to read bounded windows: valid ones, too large ones, unknown policies, missing fields."""
    n, key = F.col("n_nationkey"), F.col("n_nationkey").cast("string")
    place = F.concat(F.lit('{"type":"point","coordinates":['), F.col("lon").cast("string"), F.lit(","), F.col("lat").cast("string"), F.lit("]}"))
    proof = F.concat(F.lit('{"evidence_id":"n/'), key, F.lit('","evidence_url":"u","normalizer":"x","matched":[],"place_id":"geonames:'), key, F.lit('","place_name":"N","statement":0,"place_order":0}'))
    report = lambda source, minute, stance: F.concat(F.lit(f'{{"source_id":"{source}","kind":"air.attack_drone","stance":"{stance}","observed_at":"2024-01-01T10:{minute:02d}:00+02:00","geometry":'), place, F.lit(',"ttl":1800,"provenance":'), proof, F.lit("}"))
    told = F.when(n % 3 == 0, F.concat_ws(",", report("s:a", 0, "threat"), report("s:b", 5, "threat"))).when(n % 3 == 1, report("s:a", 0, "threat")).otherwise(F.concat_ws(",", report("s:a", 0, "threat"), report("s:b", 9, "clear")))
    version = F.when(n % 7 == 6, "fusion.v0").otherwise("fusion.v1")
    at = F.when(n % 2 == 0, "2024-01-01T08:20:00Z").otherwise("2024-01-01T09:20:00Z")
    assess = F.concat(F.lit('{"policy_version":"'), version, F.lit('","evaluation_time":"'), at, F.lit('","observations":['), told, F.lit("]}"))
    post = F.concat(F.lit('{"source_id":"s:a","external_id":"n/'), key, F.lit('","published_at":"2024-01-01T10:00:00Z","provenance":{"url":"u","collector":"c"},"text":"2 шахеда на Киев, ракета, Новое Село"}'))
    posts = F.when(n % 8 == 3, F.array_join(F.array_repeat(post, 501), ",")).otherwise(post)
    read = F.concat(F.lit('{"reader":"observe","evidence":['), posts, F.lit("]}"))
    is_read = n % 4 == 3
    envelope = F.concat(F.lit('{"protocol_version":"signal.v1","request_id":"r'), key, F.lit('","operation":"'), F.when(is_read, "normalize").otherwise("assess"), F.lit('","payload":'), F.when(is_read, read).otherwise(assess), F.lit("}"))
    vocabulary = runtime.Vocabulary(R.LEX, R.gazetteer(), point_queries.names(spark), {})
    answers = runtime.handle_stream(_nations(spark, sf_dir).select(envelope.alias("value")), vocabulary)
    at_path = lambda path: F.get_json_object("value", path)
    return answers.select(
        at_path("$.request_id").alias("request_id"), at_path("$.failure.code").alias("code"), at_path("$.result.assessments[0].status").alias("status"), at_path("$.result.assessments[0].corroboration_count").alias("sources"),
        at_path("$.result.assessments[0].valid_until").alias("until"), at_path("$.result.observations[0].provenance.place_id").alias("place_id"), at_path("$.result.observations[0].count").alias("count"), at_path("$.result.skipped[0].code").alias("skipped"),
    )


POLICY = policy("fusion.v1")
_KM = f"2 * {EARTH_KM} * asin(sqrt(pow(sin(radians(0.3 * (b - n_nationkey)) / 2), 2) + cos(radians(44 + 0.3 * n_nationkey)) * cos(radians(44 + 0.3 * b)) * pow(sin(radians(0.7 * (b - n_nationkey)) / 2), 2)))"
_D = f"(12.0::DOUBLE / {EARTH_KM})"
_T = "(corner % 48 * (2 * pi() / 48))"

SQL: dict[str, str] = {
    "B05_B07_twins": """WITH o AS (SELECT o_orderkey, CASE o_custkey % 5 WHEN 0 THEN 'air.attack_drone' WHEN 1 THEN 'air.guided_bomb' WHEN 2 THEN 'air.missile' WHEN 3 THEN 'air.ballistic_missile' ELSE 'air.missile' END AS kind,
        CASE o_custkey % 5 WHEN 0 THEN 1800 WHEN 1 THEN 900 ELSE 1200 END AS threat_ttl, CASE o_orderstatus WHEN 'F' THEN 'clear' WHEN 'P' THEN 'neutralized' ELSE 'threat' END AS stance, (o_custkey % 4)::INT AS count FROM orders WHERE o_custkey % 7 > 0)
        SELECT o_orderkey, kind, stance, count, (CASE WHEN stance = 'threat' THEN threat_ttl ELSE 600 END)::INT AS ttl FROM o UNION ALL SELECT o_orderkey, kind, 'threat', NULL, threat_ttl::INT FROM o WHERE stance = 'neutralized'""",
    "G02_disc": f"""WITH g AS (SELECT n_nationkey, radians(44 + 0.3 * n_nationkey) AS p, (22 + 0.7 * n_nationkey)::DOUBLE AS lon, unnest(range(0, 49)) AS corner FROM nation),
        s AS (SELECT *, sin(p) * cos({_D}) + cos(p) * sin({_D}) * cos({_T}) AS sine FROM g)
        SELECT n_nationkey, corner::INT AS corner, round(lon + degrees(atan2(sin({_T}) * sin({_D}) * cos(p), cos({_D}) - sin(p) * sine)), 6) AS lon, round(degrees(asin(sine)), 6) AS lat FROM s""",
    "G11_haversine": f"SELECT n_nationkey, b::INT AS b, round({_KM}, 6) AS km FROM nation, range(0, 25) t(b)",
    "G14_valid": "SELECT s_suppkey, abs(s_acctbal / 40) <= 180 AND abs(s_acctbal / 100) <= 90 AS valid FROM supplier",
    "S09_plain_text": r"SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<br\s*/?>', chr(10), 'g'), '<[^>]*>', '', 'g'), '(?m)[ \t]+$', '', 'g'), '^\s+|\s+$', '', 'g')) AS text FROM pages",
    "S11_background": "SELECT page_id, regexp_replace(url, '^http:', 'https:') AS url FROM pages",
    "S13_dedup": "SELECT 'telegram.channel:ch' || (user_id % 4) AS source_id, count(DISTINCT event_id % 3000) AS n, min(event_id % 3000) AS oldest, max(event_id % 3000) AS newest FROM events GROUP BY user_id % 4",
    "S14_S15_windows": "SELECT 'telegram.channel:ch' || (user_id % 4) AS source_id, count(*) AS n, min(event_id % 50) AS older FROM events WHERE event_id % 3000 < 2000 AND event_id % 3000 > 40 GROUP BY user_id % 4",
    "S17_channel_names": "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'chan_' || c_custkey WHEN 1 THEN CASE WHEN length('x' || c_custkey) >= 5 THEN 'x' || c_custkey END END AS channel FROM customer",
    "S30_S33_gazetteer": """WITH d AS (SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN 'A' ELSE 'P' END AS class, ['PPL', 'PPLX', 'PPLA', 'PPLW', 'PPLC'][s_suppkey % 5 + 1] AS code, floor(abs(s_acctbal) * 40)::BIGINT AS population FROM supplier)
        SELECT s_suppkey, code, population, (CASE WHEN population >= 200000 THEN 20 WHEN population >= 50000 THEN 12 WHEN population >= 10000 THEN 8 ELSE 5 END)::INT AS reach_km FROM d WHERE class = 'P' AND code NOT IN ('PPLX', 'PPLW') AND (population >= 1000 OR code IN ('PPLA', 'PPLC'))""",
    "S01_wire_times": "SELECT event_id, strftime(make_timestamp(1704067200000000 + event_id * 250000), '%Y-%m-%dT%H:%M:%S') || CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '.25' WHEN 2 THEN '.5' ELSE '.75' END || 'Z' AS wire FROM events",
    "R03_R05_windows": """WITH n AS (SELECT n_nationkey AS n, n_nationkey % 4 = 3 AS reads FROM nation),
        c AS (SELECT *, CASE WHEN reads THEN CASE WHEN n % 8 = 3 THEN 'window_too_large' END WHEN n % 7 = 6 THEN 'unknown_policy' END AS code, CASE WHEN n % 3 = 0 THEN '2024-01-01T08:35:00Z' ELSE '2024-01-01T08:30:00Z' END AS until FROM n)
        SELECT 'r' || n AS request_id, code, CASE WHEN NOT reads AND code IS NULL THEN CASE WHEN n % 2 = 0 THEN 'active' ELSE 'expired' END END AS status, CASE WHEN NOT reads AND code IS NULL THEN CASE WHEN n % 2 = 1 THEN '0' WHEN n % 3 = 0 THEN '2' ELSE '1' END END AS sources,
        CASE WHEN NOT reads AND code IS NULL THEN until END AS until, CASE WHEN reads AND code IS NULL THEN 'g:1' END AS place_id, CASE WHEN reads AND code IS NULL THEN '2' END AS count, CASE WHEN reads AND code IS NULL THEN 'ambiguous_place' END AS skipped FROM c""",
    "R02_capabilities": "SELECT 'capabilities,normalize,cover,assess' AS operations, 'normalize,observe' AS readers, 'fusion.v1' AS policies, 500::INT AS evidence, 5000::INT AS observations, 400::INT AS cells",
    "R01_R07_protocol": "SELECT CASE WHEN n_nationkey % 5 <> 3 THEN 'r' || n_nationkey END AS request_id, CASE n_nationkey % 5 WHEN 1 THEN 'unknown_operation' WHEN 2 THEN 'unsupported_version' WHEN 3 THEN 'invalid_request' END AS code, CASE WHEN n_nationkey % 5 IN (0, 4) THEN 7 END::INT AS n_cells FROM nation",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "B05_B07_twins": b05_b07_twins, "G02_disc": g02_disc,
    "G11_haversine": g11_haversine, "G14_valid": g14_valid,
    "S01_wire_times": s01_wire_times, "S09_plain_text": s09_plain_text, "S11_background": s11_background, "S13_dedup": s13_dedup, "S14_S15_windows": s14_s15_windows, "S17_channel_names": s17_channel_names,
    "S30_S33_gazetteer": s30_s33_gazetteer, "R01_R07_protocol": r01_r07_protocol, "R03_R05_windows": r03_r05_windows, "R02_capabilities": r02_capabilities,
}
