"""The corpus queries ``opN_<name>`` and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hard_negatives, main_text, ngram_join, packing, personal_data, quality_classifier, quality_rules, secrets, sharding, url_reputation, warc_zip, whitening
from ._shared import fresh_dir, table

URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the pages to packages in the shared folder and reads these back."""
    manifest = warc_zip.write_packages(table(spark, sf_dir, "pages"), fresh_dir(spark, "warc"))
    return warc_zip.read_packages(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans all documents against a ledger that is empty at first."""
    return secrets.scan_secrets(table(spark, sf_dir, "documents"), fresh_dir(spark, "ledger")).drop("blob")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("item_ids", "spans")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_main_text(table(spark, sf_dir, "pages"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents")).drop("sig")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables label documents only: a page's outcome is the quality label of the document of its id, 0 being bad.

    These are two kinds of things, so that hosts differ by chance only, and hardly
    any posterior reaches the bound; ``tests/llm/test_urls.py`` has hosts that do.
    """
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).cast("int").alias("bad"))
    return url_reputation.url_filter(table(spark, sf_dir, "pages"), outcomes, URL_RULES).drop("rate")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of ids divisible by 7 go on to the next of ten; anchors are ids divisible by 100."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), moved, F.col("vec_id") % 100 == 0)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and checksums are taken before the exchange, so that texts stay where they are."""
    out = sharding.sharded(sharding.with_digests(table(spark, sf_dir, "documents")))
    return out.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_secret_scans, op3_decontamination, op4_html_extraction, op5_ngram_join, op6_quality_rules, op7_personal_data, op8_quality_classifier, op9_best_fit_packing, op10_url_filters, op11_hard_negatives, op12_whitening, op13_sharding)}


#: One group's rates around m: the prior's strength by the method of moments.
_STRENGTH = """least(10000.0, greatest(1.0, coalesce(m * (1 - m) / nullif(greatest(
    (sq_k - all_n * m * m - (groups - 1) * m * (1 - m)) / nullif(all_n - sq_n / all_n, 0.0), 0.0), 0.0) - 1, 10000.0)))"""
_TOTALS = """sum(k)::DOUBLE AS all_k, sum(n)::DOUBLE AS all_n, count(*) AS groups, sum(n * n)::DOUBLE AS sq_n,
    sum(k * k / n::DOUBLE) AS sq_k, sum(k)::DOUBLE / nullif(sum(n), 0) AS m"""

OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
r AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM r WHERE payload_bytes >= 100 GROUP BY payload_digest HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM r LEFT JOIN f USING (payload_digest)
"""

OP3_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT item_id, words, least(13, len(words)) AS k, unnest(range(1, greatest(1, len(words) - 12) + 1)) AS i FROM b WHERE len(words) > 0),
bg AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(words, i, i + k - 1), ' ') AS gram FROM bw),
dw AS (SELECT rid, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, (SELECT DISTINCT k FROM bg) WHERE len(words) >= k),
dg AS (SELECT rid, i, k, array_to_string(list_slice(words, i, i + k - 1), ' ') AS gram FROM dw),
hits AS (SELECT rid, i, k, item_id FROM dg JOIN bg USING (k, gram)),
n AS (SELECT rid, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*)::BIGINT AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM hits) GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM w LEFT JOIN n USING (rid) LEFT JOIN items USING (rid)
"""

OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
g AS (SELECT rid, words, unnest(range(1, greatest(1, len(words) - 4) + 1)) AS i FROM w WHERE len(words) > 0),
s AS (SELECT DISTINCT rid, array_to_string(list_slice(words, i, i + 4), ' ') AS gram FROM g),
n AS (SELECT w.rid, w.doc_id, count(s.gram) AS n FROM w LEFT JOIN s USING (rid) GROUP BY ALL),
shared AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.rid <> b.rid GROUP BY ALL),
links AS (SELECT a, b, c = na.n AND c = nb.n AS equal FROM shared JOIN n na ON na.rid = a JOIN n nb ON nb.rid = b WHERE 5 * c >= 4 * (na.n + nb.n - c)
    UNION ALL SELECT x.rid, y.rid, true FROM n x JOIN n y ON x.n = 0 AND y.n = 0 AND x.rid <> y.rid),
copies AS (SELECT n.rid, least(n.doc_id, min(m.doc_id)) AS copy_id FROM n LEFT JOIN links ON a = n.rid AND equal LEFT JOIN n m ON m.rid = b GROUP BY n.rid, n.doc_id),
reach(a, b) AS (SELECT rid, rid FROM n UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
classes AS (SELECT reach.a AS rid, min(n.doc_id) AS class_id FROM reach JOIN n ON n.rid = reach.b GROUP BY reach.a),
counts AS (SELECT a AS rid, count(*) AS n_links, count(DISTINCT copy_id) FILTER (NOT equal) AS n_texts FROM links JOIN copies ON copies.rid = b GROUP BY a)
SELECT doc_id, class_id, copy_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(n_texts, 0)::BIGINT AS n_texts, doc_id = class_id AS is_first
FROM n JOIN classes USING (rid) JOIN copies USING (rid) LEFT JOIN counts USING (rid)
"""

OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, source, t, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines FROM d),
g AS (SELECT rid, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) > 8),
h AS (SELECT rid, i, array_to_string(list_slice(words, i, i + 7), ' ') AS gram FROM g),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM h) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY rid),
m AS (SELECT doc_id, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
    FROM w LEFT JOIN rep USING (rid)),
r AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
hosts AS (SELECT source, sum(base_failed::INT) AS k, count(*) AS n FROM r GROUP BY source),
totals AS (SELECT {_TOTALS} FROM hosts),
prior AS (SELECT m, {_STRENGTH} AS s FROM totals),
rated AS (SELECT source, n, s, (k + m * s) / (n + s) AS rate FROM hosts, prior),
ok AS (SELECT source, rate - 3 * sqrt(rate * (1 - rate) / (n + s + 1)) <= 0.5 AS host_ok FROM rated)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_ok AS kept
FROM r JOIN ok ON r.source IS NOT DISTINCT FROM ok.source
"""

OP10_SQL = rf"""
WITH a AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*', 0) AS h FROM a),
parts AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(h) + 1), '^[^?#]*', 0) AS path FROM b),
rules(rule, kind, host, prefix) AS (VALUES ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'),
    ('example.org/en/1', 'block', 'example.org', '/en/1'), ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/')),
labelled AS (SELECT doc_id, avg((quality = 0)::INT) >= 0.5 AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
hosts AS (SELECT host, coalesce(sum(bad::INT), 0) AS k, count(bad) AS n, regexp_extract(host, '([^.]*\.)?[^.]*$', 0) AS domain,
    regexp_extract(host, '[^.]*$', 0) AS suffix FROM parts LEFT JOIN labelled ON page_id = doc_id GROUP BY host),
domains AS (SELECT suffix, domain, sum(k) AS k, sum(n) AS n FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(k) AS k, sum(n) AS n FROM domains GROUP BY ALL),
p1 AS (SELECT coalesce(m, 0) AS m1, {_STRENGTH} AS s1 FROM (SELECT {_TOTALS} FROM suffixes WHERE n > 0)),
p2 AS (SELECT {_STRENGTH} AS s2 FROM (SELECT {_TOTALS} FROM domains WHERE n > 0)),
p3 AS (SELECT {_STRENGTH} AS s3 FROM (SELECT {_TOTALS} FROM hosts WHERE n > 0)),
r1 AS (SELECT suffix, (k + m1 * s1) / (n + s1) AS rate1 FROM suffixes, p1),
r2 AS (SELECT domain, (k + rate1 * s2) / (n + s2) AS rate2 FROM domains JOIN r1 USING (suffix), p2),
r3 AS (SELECT host, n, s3, (k + rate2 * s3) / (n + s3) AS rate FROM hosts JOIN r2 USING (domain), p3),
rep AS (SELECT host, CASE WHEN rate - 2 * sqrt(rate * (1 - rate) / (n + s3 + 1)) > 0.5 THEN 'block' ELSE 'allow' END AS reputation FROM r3)
SELECT page_id, host, path,
    (SELECT max_by(r.rule, length(r.rule)) FROM rules r WHERE (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.prefix)) AS rule,
    coalesce((SELECT max_by(r.kind, length(r.rule)) FROM rules r WHERE (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.prefix)), reputation) AS verdict
FROM parts p JOIN rep USING (host)
"""

OP11_SQL = """
WITH r AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.rid AS a, a.vec_id AS anchor_id, b.rid AS b, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
    FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.rid <> b.rid),
p AS (SELECT a, anchor_id, b, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST, b) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY score DESC, vec_id NULLS LAST, s.b)::INTEGER AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op3_decontamination": OP3_SQL, "op5_ngram_join": OP5_SQL, "op6_quality_rules": OP6_SQL, "op10_url_filters": OP10_SQL, "op11_hard_negatives": OP11_SQL}
