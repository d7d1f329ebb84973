"""Registered queries of the sources and sinks (S): preview pages made of events, and lines of JSON, with DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import role_reader, vocabulary
from ..operators.shared import written
from ..sources import ndjson, preview
from . import reader_queries as R

#: Posts of a page.
PAGE = 20


def preview_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``channel, html``: pages of posts, with services, edits, media, forwards, a repeated post, pages without a history and foreign posts.

    Some posts have end tags that nothing opened, styles that cross or aren't closed, and parts that only the post's own end closes.
    """
    n = F.col("event_id")
    when = lambda k, html: F.when(n % k == 0, html).otherwise(F.lit(""))
    stamp = F.date_format(F.timestamp_seconds(F.lit(1704067200) + n * 61), "yyyy-MM-dd'T'HH:mm:ss")
    owner = F.when((n % 340 == 5), "other").otherwise(F.concat(F.lit("Channel"), (F.floor(n / PAGE) % 3).cast("string")))
    post = F.concat(
        F.lit(f'<div class="js-x {preview.MESSAGE} '), when(10, F.lit(preview.SERVICE)), F.lit('" data-post="'), owner, F.lit("/"), n.cast("string"), F.lit('">'),
        when(5, F.concat(F.lit('<a class="tgme_widget_message_photo_wrap" style="width:9px;background-image:url(\'https://x/'), n.cast("string"), F.lit(".jpg')\"></a>"))),
        when(11, F.lit(f'<div class="{preview.UNSUPPORTED}">no</div>')), when(6, F.concat(F.lit(f'<a class="{preview.FORWARDED}"><span> Some  name </span>'), n.cast("string"), F.lit("</a>"))),
        F.when(n % 13 == 0, "").otherwise(F.concat(F.lit(f'<div class="{preview.BODY}"> Seen &amp; <b>'), "event_type", F.lit("</b>  <br/>next "),
            F.when(n % 17 == 3, "<i>line</b></span></i>").when(n % 17 == 8, "<b><i>li</b>ne</i></em>").when(n % 17 == 12, "<s><u>line</p2>").otherwise("<i>line</i>"), n.cast("string"), F.lit(" <br>"), F.when(n % 17 == 14, "</section2></div></b>").otherwise("</div>"))),
        F.lit(f'<span class="{preview.META}">'), when(7, F.lit("edited ")), F.lit('<time datetime="'), stamp, F.when(n % 19 == 4, '+03:00"></div>').otherwise('+03:00"></time></span></div>'),
    )
    posts = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.floor(n / PAGE).alias("page"), n.alias("n"), post.alias("post"))
    pages = posts.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("n", "post"))).alias("posts"))
    joined = F.array_join(F.transform("posts", lambda p: p["post"]), "\n")
    more = F.concat(F.lit(f'<a class="{preview.MORE}" data-before="'), F.element_at("posts", 1)["n"].cast("string"), F.lit('"></a>'))
    history = F.when(F.col("page") % 9 == 4, "elsewhere").otherwise(F.lit(preview.HISTORY))
    html = F.concat(F.lit("<body>"), more, F.lit('<section class="'), history, F.lit('">'), joined, F.element_at("posts", 1)["post"], F.lit("</section></body>"))
    return pages.select(F.concat(F.lit("channel"), (F.col("page") % 3).cast("string")).alias("channel"), html.alias("html"))


def s05_s16_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of pages as evidence; a page that can't be read is a row with its code."""
    media = F.array_join(F.transform("media", lambda m: F.concat(m["kind"], F.lit("="), F.coalesce(m["url"], F.lit("")))), ",")
    parsed = preview.parse_pages(preview_pages(spark, sf_dir))
    return parsed.select(
        "source_id", "external_id", F.unix_seconds("published_at").alias("seconds"), "edited", F.replace("text", F.lit("\n"), F.lit("|")).alias("text"), media.alias("media"), "forwarded_from", F.col("provenance.url").alias("url"), "post_id", "older", "code"
    )


def s06_s15_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a walk backwards from a post and one forwards keep of the pages."""
    # both walks read the same pages: these are parsed once
    parsed = written(preview.parse_pages(preview_pages(spark, sf_dir)).filter("code is null").select("source_id", "post_id", "older"), "walk")
    back, on = preview.windowed(parsed, before=400), preview.windowed(parsed, after=400)
    side = lambda rows, name: rows.groupBy("source_id").agg(F.lit(name).alias("side"), F.count(F.lit(1)).alias("n"), F.min("post_id").alias("oldest"), F.max("post_id").alias("newest"), F.max("older").alias("older"))
    return side(back, "before").unionByName(side(on, "after"))


def _fields(lines: DataFrame, *names: str) -> DataFrame:
    return lines.select(*(F.get_json_object("value", f"$.{n}").alias(n) for n in names))


def s03_evidence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence as lines of JSON, read as JSON again; nulls and empty lists are left out."""
    lines = ndjson.as_json(R.evidence(spark, sf_dir), "published_at")
    text = F.md5(F.get_json_object("value", "$.text").cast("binary"))
    return lines.select(*(F.get_json_object("value", f"$.{n}").alias(n) for n in ("source_id", "external_id", "published_at", "edited", "forwarded_from", "media")), text.alias("text"), F.get_json_object("value", "$.provenance.url").alias("url"))


def s02_reading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actionable readings as lines of JSON."""
    read = role_reader.read(R.evidence(spark, sf_dir), R.LEX, R.gazetteer()).filter(role_reader.actionable())
    return _fields(ndjson.as_json(read, "published_at"), "external_id", "published_at", "statement", "kind", "phase", "unresolved[0]").withColumnRenamed("unresolved[0]", "first_unresolved")


def s01_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines are evidence: some of these are cut off, and some have ids that are none."""
    lines = ndjson.as_json(R.evidence(spark, sf_dir), "published_at")
    n = F.regexp_extract("value", r'"external_id":"c/(\d+)', 1).cast("int")
    broken = lines.select(n.alias("n"), F.when(n % 7 == 0, F.left("value", F.lit(40))).when(n % 7 == 1, F.replace("value", F.lit('"external_id":"c/'), F.lit('"external_id":"c /'))).when(n % 7 == 2, F.lit("  ")).otherwise(F.col("value")).alias("value"))
    judged = ndjson.judged_lines(broken)
    return judged.groupBy("n").agg(F.count(F.lit(1)).alias("lines"), F.count_if("valid").alias("valid"))


def _dump(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as lines of a place dump, every tenth of them cut off."""
    n = F.col("s_suppkey")
    code = F.element_at(F.array(*map(F.lit, ("PPL", "PPLX", "PPLA", "PPLW", "PPLC"))), (n % 5 + 1).cast("int"))
    alternates = F.concat(F.lit("Ки\u0301ев"), (n % 3).cast("string"), F.lit(",Kiev,, Town"), n.cast("string"), F.lit(",Київ"), (n % 3).cast("string"), F.lit(",Киев"), (n % 3).cast("string"))
    fields = [n.cast("string"), "s_name", F.concat(F.lit("Town"), n.cast("string")), alternates, F.format_string("%.5f", 44 + n / 7), F.format_string("%.5f", 22 + n / 9), F.when(n % 9 == 0, "A").otherwise("P"), code, F.when(n % 4 == 0, "PL").otherwise("UA")]
    more = [*[F.lit("")] * 5, F.when(n % 6 == 0, "").otherwise(F.floor(F.abs("s_acctbal") * 40).cast("string")), *[F.lit("")] * 3, F.lit("2024-01-01")]
    columns = [F.col(c) if isinstance(c, str) else c for c in [*fields, *more]]
    whole = F.concat_ws("\t", *columns)
    lines = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.when(n % 10 == 3, F.concat_ws("\t", *columns[:5])).otherwise(whole).alias("value"))
    return vocabulary.dump_rows(lines)


def s29_s31_point_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point reader's places from a dump: who is kept, under which aliases."""
    return vocabulary.build_point_gazetteer(_dump(spark, sf_dir)[0])


def s29_short_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dump(spark, sf_dir)[1].select(F.substring_index("value", "\t", 1).alias("id"), "problem")


def _role_spec(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations as a curated list: places of the dump, regions, unknown ones, repeated ones."""
    n = F.col("n_nationkey")
    spec = spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        F.when(n % 5 > 0, F.when(n == 24, 1).otherwise(n)).cast("long").alias("geonames_id"), F.when(n % 5 == 0, F.concat(F.lit("UA"), (n % 15).cast("string"))).alias("region"), F.col("n_name").alias("name"),
        F.when(n % 7 == 0, F.lit(33)).alias("reach_km"), F.when(n % 8 == 1, n + 1).cast("long").alias("within"),
    )
    regions = spark.createDataFrame([("ua-adm1:UA0", 50.5, 30.25, 90), ("ua-adm1:UA5", 48.0, 37.0, 95)], "id string, lat double, lon double, reach_km int")
    return vocabulary.build_role_gazetteer(spec, _dump(spark, sf_dir)[0], regions)


def s32_role_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _role_spec(spark, sf_dir)[0]


def s32_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _role_spec(spark, sf_dir)[1]


_media = "CASE WHEN n % 5 = 0 THEN 'photo=https://x/' || n || '.jpg' WHEN n % 11 = 0 THEN 'other=' ELSE '' END"
PARSED_SQL = f"""
WITH e AS (SELECT event_id AS n, event_type, event_id // {PAGE} AS page FROM events),
pages AS (SELECT page, page % 9 <> 4 AS history, min(n) AS older, bool_or(n % 340 = 5 AND n % 10 <> 0) AS alien FROM e GROUP BY page),
posts AS (SELECT e.*, older FROM e JOIN pages USING (page) WHERE history AND NOT alien AND n % 10 <> 0),
parsed AS (SELECT 'telegram.channel:channel' || (page % 3) AS source_id, 'channel' || (page % 3) || '/' || n AS external_id, 1704067200 + n * 61 - 10800 AS seconds, n % 7 = 0 AS edited,
    CASE WHEN n % 13 <> 0 THEN 'Seen & ' || event_type || '|next line' || n END AS text, {_media} AS media, CASE WHEN n % 6 = 0 THEN 'Some name ' || n END AS forwarded_from, 'https://t.me/channel' || (page % 3) || '/' || n AS url, n AS post_id, older, NULL AS code FROM posts
    UNION ALL SELECT 'telegram.channel:channel' || (page % 3), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN history THEN 'malformed' ELSE 'not_found' END FROM pages WHERE NOT history OR alien)
"""
_AT = "strftime(to_timestamp(1704067200 + conv_id * 60 + turn) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ')"

_CODE = "['PPL', 'PPLX', 'PPLA', 'PPLW', 'PPLC'][s_suppkey % 5 + 1]"
_DUMP_SQL = f"""
WITH d AS (SELECT s_suppkey AS n, s_name AS name, {_CODE} AS code, printf('%.5f', 44 + s_suppkey / 7)::DOUBLE AS lat, printf('%.5f', 22 + s_suppkey / 9)::DOUBLE AS lon, s_suppkey % 9 <> 0 AS populated, s_suppkey % 4 <> 0 AS ua,
    CASE WHEN s_suppkey % 6 = 0 THEN 0 ELSE floor(abs(s_acctbal) * 40)::BIGINT END AS population FROM supplier WHERE s_suppkey % 10 <> 3)
"""
_SPEC_SQL = _DUMP_SQL + """, spec AS (SELECT CASE WHEN n_nationkey = 24 THEN 1 WHEN n_nationkey % 5 > 0 THEN n_nationkey END AS gid, CASE WHEN n_nationkey % 5 = 0 THEN 'ua-adm1:UA' || (n_nationkey % 15) END AS rid, n_name AS name, CASE WHEN n_nationkey % 7 = 0 THEN 33 END AS given, CASE WHEN n_nationkey % 8 = 1 THEN n_nationkey + 1 END AS within FROM nation),
regions(id, lat, lon, reach) AS (VALUES ('ua-adm1:UA0', 50.5, 30.25, 90), ('ua-adm1:UA5', 48.0, 37.0, 95)),
rows_ AS (SELECT 'geonames:' || gid AS id, s.name, round(d.lat, 4) AS lat, round(d.lon, 4) AS lon, coalesce(given, CASE WHEN population >= 200000 THEN 20 WHEN population >= 50000 THEN 12 WHEN population >= 10000 THEN 8 ELSE 5 END)::INT AS reach_km, 'geonames:' || within AS within
    FROM spec s JOIN d ON d.n = s.gid AND populated AND ua UNION ALL SELECT rid, s.name, r.lat::DOUBLE, r.lon::DOUBLE, reach::INT, NULL FROM spec s JOIN regions r ON r.id = rid)
"""

SQL: dict[str, str] = {
    "S05_S16_preview": PARSED_SQL + "SELECT * FROM parsed",
    "S06_S15_walk": PARSED_SQL + """SELECT source_id, 'before' AS side, count(*) AS n, min(post_id) AS oldest, max(post_id) AS newest, max(CASE WHEN older < 400 THEN older END) AS older FROM parsed WHERE code IS NULL AND post_id < 400 GROUP BY source_id
        UNION ALL SELECT source_id, 'after', count(*), min(post_id), max(post_id), max(older) FROM parsed WHERE code IS NULL AND post_id > 400 GROUP BY source_id""",
    "S03_evidence_lines": f"SELECT 'telegram.channel:' || role AS source_id, 'c/' || conv_id || '-' || turn AS external_id, {_AT} AS published_at, 'false' AS edited, CASE WHEN conv_id % 10 = 0 THEN 'other' END AS forwarded_from, NULL::VARCHAR AS media, md5({R.spelled_sql('text', R.TOWNS)}) AS text, 'https://t.me/c/' || conv_id || '-' || turn AS url FROM conversations",
    "S02_reading_lines": f"{R.READER} SELECT external_id, {_AT} AS published_at, statement::VARCHAR AS statement, kind, phase, unresolved[1] AS first_unresolved FROM readings JOIN conversations c ON 'c/' || c.conv_id || '-' || c.turn = external_id WHERE {R._actionable}",
    "S29_S31_point_gazetteer": _DUMP_SQL + """SELECT 'geonames:' || n AS id, name, lat, lon, code AS feature_code, population, array_to_string(list_sort(['Town' || n, 'Киев' || (n % 3), 'Київ' || (n % 3)]), ',') AS aliases
        FROM d WHERE populated AND code NOT IN ('PPLX', 'PPLW') AND (population >= 1000 OR code IN ('PPLA', 'PPLC'))""",
    "S29_short_lines": "SELECT s_suppkey::VARCHAR AS id, 'expected 19 tab-separated fields, found 5' AS problem FROM supplier WHERE s_suppkey % 10 = 3",
    "S32_role_gazetteer": _SPEC_SQL + "SELECT * FROM rows_",
    "S32_problems": _SPEC_SQL + """SELECT 'geonames:' || gid AS id, 'not a populated place of the dump' AS problem FROM spec WHERE gid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d WHERE d.n = gid AND populated AND ua)
        UNION ALL SELECT rid, 'not a region that is listed' FROM spec WHERE rid IS NOT NULL AND rid NOT IN (SELECT id FROM regions)
        UNION ALL SELECT id, 'listed more than once' FROM rows_ GROUP BY id HAVING count(*) > 1
        UNION ALL SELECT id, 'lies within a place that is not listed' FROM rows_ WHERE within IS NOT NULL AND within NOT IN (SELECT id FROM rows_)""",
    "S01_bad_lines": "SELECT conv_id::INT AS n, count(*) AS lines, count(*) FILTER (conv_id % 7 > 2) AS valid FROM conversations WHERE conv_id % 7 <> 2 GROUP BY conv_id",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "S05_S16_preview": s05_s16_preview, "S06_S15_walk": s06_s15_walk, "S03_evidence_lines": s03_evidence_lines, "S02_reading_lines": s02_reading_lines, "S01_bad_lines": s01_bad_lines, "S29_S31_point_gazetteer": s29_s31_point_gazetteer,
    "S29_short_lines": s29_short_lines, "S32_role_gazetteer": s32_role_gazetteer, "S32_problems": s32_problems,
}
