"""Registered queries of the point reader (O) over ``conversations``, with DuckDB counterparts.

Common words of the prose are spelled as hazards, towns and units of the reader's
own vocabulary, in the same way in both engines. Every query calls the operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import point_reader as P
from ..operators import vocabulary
from ..params import POINT_TTL_MIN
from . import reader_queries as R

WORDS = {
    " the ": " шахеды ", " of ": " минус ", " and ": " ракета ", " in ": " на Киев, ", " is ": " Баллистика ", " for ": " Новое Село ", " to ": " реактивный ", " with ": " Сумского района ", " a ": " 3 ", " it ": " Киев, Сумами: ",
    " that ": " каб ", " an ": " минут ", " as ": " шахед-136 ", " la ": " отбой ", ". ": ".\n", " de ": " Село ", " or ": " +12 ", " not ": " обл ",
}
PLACES = [
    ("g:1", "Киев", 50.45, 30.52, "PPLC", 2797553, "Київ"), ("g:2", "Сумы", 50.91, 34.8, "PPLA", 250000, ""), ("g:3", "Новое Село", 49.5, 25.9, "PPL", 900, ""), ("g:4", "Новое Село", 48.1, 29.0, "PPL", 1200, ""),
    ("g:5", "Село", 47.2, 31.1, "PPL", 20000, ""), ("g:6", "Село", 46.9, 33.3, "PPL", 900, ""), ("g:7", "Erin", 50.0, 30.0, "PPL", 10, "Eran,Onin"),
]
#: What the names stand for: the larger of two namesakes if it is ten times as large, or else neither.
_STANDS_FOR = {"Киев": "g:1", "Київ": "g:1", "Сумы": "g:2", "Новое Село": None, "Село": "g:5", "Erin": "g:7", "Eran": "g:7", "Onin": "g:7"}


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.col("text").alias("said"))
    name = F.concat(F.lit("c/"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    return R.evidence(spark, sf_dir).drop("text").join(plain.select(name.alias("external_id"), R.spelled(F.col("said"), WORDS).alias("text")), "external_id")


def names(spark: SparkSession) -> dict[tuple[str, ...], dict]:
    """The vocabulary, made by the operators that build it; a few keys."""
    found = vocabulary.resolved_names(vocabulary.point_names(spark.createDataFrame(PLACES, vocabulary.POINT_COLUMNS)))
    return {tuple(r["key"].split(" ")): {"place": r["place"].asDict() if r["place"] else None} for r in found.collect()}


def o01_o02_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forwarded posts, and lines whose names or hazards can't be placed."""
    return P.observe(evidence(spark, sf_dir), names(spark))[1]


def o03_o06_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hazard words with their kinds, and counts before them."""
    hazards = lambda words: [{"pos": i, "clause": c, "kind": P.kind_of(w), "count": P.count_before(words, i)} for i, (_, w, c) in enumerate(words) if P.kind_of(w)]
    return P.of_lines(evidence(spark, sf_dir), hazards, "pos int, clause int, kind string, count int")


def o05_cleared_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.of_lines(evidence(spark, sf_dir), lambda words: [{"cleared": c} for c in sorted(P.cleared_clauses(words))], "cleared int")


def o04_o07_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.of_lines(evidence(spark, sf_dir), lambda words: [m | {"words": " ".join(m["words"])} for m in P.mentions_of(words)], "clause int, kind string, stance string, count int, words string")


def o08_absorbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions that stay after generic missiles were absorbed."""
    named = names(spark)
    kept = lambda words: P.absorbed(P.mentions_of(words), {p["clause"] for p in P.places_of(words, named)[0]})
    return P.of_lines(evidence(spark, sf_dir), kept, "clause int, kind string, stance string")


def o09_o12_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = names(spark)
    return P.of_lines(evidence(spark, sf_dir), lambda words: [{"clause": p["clause"], "place_id": p["id"], "lat": p["lat"]} for p in P.places_of(words, named)[0]], "clause int, place_id string, lat double")


def o13_o14_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("provenance")
    seen = P.observe(evidence(spark, sf_dir), names(spark))[0]
    return seen.select(p["evidence_id"].alias("evidence_id"), "kind", "stance", "count", p["place_id"].alias("place_id"), F.array_join(p["matched"], " ").alias("matched"), "ttl", F.get("geometry.coordinates", F.lit(0)).alias("lon"))


def o15_unlocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.observe(evidence(spark, sf_dir), names(spark))[1].filter("code = 'unlocated'").select("evidence_id", "line", "detail")


def o16_ttls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long observations of each kind and stance stay valid."""
    return P.observe(evidence(spark, sf_dir), names(spark))[0].groupBy("kind", "stance", "ttl").agg(F.count(F.lit(1)).alias("n"))


# The same in SQL
_list = R._list
_starts = lambda column, prefixes: "(" + " OR ".join(f"starts_with({column}, '{p}')" for p in prefixes) + ")"
_NORM = f"translate(lower(part), '{R._q(T.NORM_FROM)}', '{T.NORM_TO}')"
_KIND = (
    f"CASE WHEN list_contains({_list(P.GUIDED_BOMBS)}, norm) OR starts_with(norm, '{P.GUIDED_BOMB_PREFIX}') THEN 'air.guided_bomb' "
    + " ".join(f"WHEN list_contains({_list([s + e for s in stems for e in endings])}, norm) THEN '{kind}'" for kind, endings, stems in P.KIND_WORDS)
    + " "
    + " ".join(f"WHEN {_starts('norm', [s + '-' for s in stems])} THEN '{kind}'" for kind, _, stems in P.KIND_WORDS)
    + " END"
)
_UNIT = lambda c: f"(list_contains({_list(P.UNIT_WORDS)}, {c}) OR {_starts(c, P.UNIT_STEMS)})"
_NUMBER = lambda c: f"CASE WHEN regexp_matches({c}, '^\\+?[0-9]{{1,9}}$') AND CAST({c} AS INT) BETWEEN 1 AND 1000 THEN CAST({c} AS INT) END"
_AREA = lambda c: f"(list_contains({_list([s + e for s in P.AREA_STEMS for e in T.NOUN_ENDINGS] + [P.AREA_WORD])}, {c}) OR {_starts(c, [s + '-' for s in P.AREA_STEMS])})"
_STEM = lambda c: "coalesce(" + ", ".join(f"CASE WHEN ends_with({c}, '{e}') AND length({c}) - {len(e)} >= 3 THEN left({c}, length({c}) - {len(e)}) END" for e in T.ENDINGS) + f", {c})"
_BARE = lambda c: f"translate({_STEM(c)}, '{T.VOWELS}', '')"
_KEYS = [_STEM("ahead[1]"), f"{_STEM('ahead[1]')} || ' ' || {_BARE('ahead[2]')}", f"{_STEM('ahead[1]')} || ' ' || {_BARE('ahead[2]')} || ' ' || {_BARE('ahead[3]')}"]
_PLACE = {p[0]: p for p in PLACES}
_NAMES = ", ".join(
    f"('{' '.join(T.keyed([T.normalized(w) for w in name.split()]))}', {len(name.split())}, " + (f"'{i}', {_PLACE[i][2]}, {_PLACE[i][3]})" if i else "NULL, NULL, NULL)") for name, i in _STANDS_FOR.items()
)
_TTL = "CASE WHEN stance = 'clear' THEN " + str(60 * POINT_TTL_MIN["clear"]) + " " + " ".join(f"WHEN kind = '{k}' THEN {60 * m}" for k, m in POINT_TTL_MIN.items() if k != "clear") + " END"

READER = rf"""
WITH RECURSIVE ev AS (SELECT 'c/' || conv_id || '-' || turn AS post, conv_id % 10 = 0 AS forwarded, {R.spelled_sql('text', WORDS).replace(chr(10), "' || chr(10) || '")} AS text FROM conversations),
l0 AS (SELECT post, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS value FROM ev WHERE NOT forwarded),
q1 AS (SELECT post, line, regexp_extract_all(value, '{R._q(T.POINT_PARTS)}') AS parts FROM l0),
q2 AS (SELECT post, line, unnest(range(1, len(parts) + 1)) AS idx, unnest(parts) AS part FROM q1),
q3 AS (SELECT *, (sum((NOT {R._IS_WORD})::INT) OVER (PARTITION BY post, line ORDER BY idx ROWS UNBOUNDED PRECEDING))::INT AS clause FROM q2),
q4 AS (SELECT post, line, clause, (row_number() OVER (PARTITION BY post, line ORDER BY idx) - 1)::INT AS pos, part AS raw, {_NORM} AS norm FROM q3 WHERE {R._IS_WORD}),
q5 AS (SELECT *, {_KIND} AS word_kind, {_starts('norm', P.CLEAR_PREFIXES)} AS clears, starts_with(norm, '{P.JET_PREFIX}') AS jet, list(norm) OVER n AS ahead, list(raw) OVER n AS spelled,
    lag(norm) OVER c AS one, lag(norm, 2) OVER c AS two FROM q4 WINDOW c AS (PARTITION BY post, line, clause ORDER BY pos), n AS (PARTITION BY post, line, clause ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
words AS (SELECT *, CASE WHEN NOT {_UNIT('norm')} AND {_NUMBER('one')} IS NOT NULL THEN {_NUMBER('one')} WHEN NOT {_UNIT('one')} THEN {_NUMBER('two')} END AS before FROM q5),
cl AS (SELECT post, line, clause, count(word_kind) > 0 AS named, bool_or(clears) AS marked, bool_or(jet) AS jet FROM words GROUP BY ALL),
cleared AS (SELECT a.post, a.line, a.clause FROM cl a LEFT JOIN cl b ON b.post = a.post AND b.line = a.line AND b.clause = a.clause + 1 WHERE a.named AND (a.marked OR coalesce(b.marked AND NOT b.named, false))),
hazards AS (SELECT w.*, CASE WHEN word_kind = 'air.attack_drone' AND cl.jet THEN 'air.jet_drone' ELSE word_kind END AS kind, CASE WHEN cleared.clause IS NOT NULL THEN 'clear' ELSE 'threat' END AS stance
    FROM words w JOIN cl USING (post, line, clause) LEFT JOIN cleared USING (post, line, clause) WHERE word_kind IS NOT NULL),
mentions AS (SELECT post, line, clause, kind, stance, arg_min(before, pos) FILTER (before IS NOT NULL) AS count, string_agg(raw, ' ' ORDER BY pos) AS words, min(pos) AS first FROM hazards GROUP BY ALL),
names(key, n, place_id, lat, lon) AS (VALUES {_NAMES}),
n0 AS (SELECT w.post, w.line, w.clause, w.pos, w.spelled, k.n, k.place_id, k.lat, k.lon FROM words w JOIN names k ON len(ahead) >= k.n AND k.key = CASE k.n WHEN 1 THEN {_KEYS[0]} WHEN 2 THEN {_KEYS[1]} ELSE {_KEYS[2]} END WHERE regexp_matches(raw, '^\p{{Lu}}')),
n1 AS (SELECT *, row_number() OVER (PARTITION BY post, line ORDER BY pos, n DESC) AS rn FROM n0),
g(post, line, rn, free, kept) AS (SELECT DISTINCT post, line, 0::BIGINT, 0::INT, false FROM n1 UNION ALL SELECT g.post, g.line, n1.rn, CASE WHEN n1.pos >= free THEN n1.pos + n1.n ELSE free END, n1.pos >= free FROM g JOIN n1 ON n1.post = g.post AND n1.line = g.line AND n1.rn = g.rn + 1),
n2 AS (SELECT n1.* FROM n1 JOIN g USING (post, line, rn) LEFT JOIN words w ON w.post = n1.post AND w.line = n1.line AND w.pos = n1.pos + n1.n AND w.clause = n1.clause WHERE kept AND NOT coalesce({_AREA('w.norm')}, false)),
places AS (SELECT post, line, clause, place_id, any_value(lat) AS lat, any_value(lon) AS lon FROM n2 WHERE place_id IS NOT NULL GROUP BY ALL),
left_ AS (SELECT m.* FROM mentions m WHERE kind <> 'air.missile' OR NOT EXISTS (SELECT 1 FROM mentions b WHERE b.post = m.post AND b.line = m.line AND b.kind = 'air.ballistic_missile' AND b.stance = m.stance
    AND (b.clause = m.clause OR NOT EXISTS (SELECT 1 FROM places p WHERE p.post = m.post AND p.line = m.line AND p.clause = m.clause)))),
owned AS (SELECT p.*, coalesce((SELECT max(clause) FROM left_ m WHERE m.post = p.post AND m.line = p.line AND m.clause <= p.clause), (SELECT min(clause) FROM left_ m WHERE m.post = p.post AND m.line = p.line)) AS owner FROM places p),
pairs AS (SELECT m.*, o.place_id, o.lat, o.lon FROM left_ m JOIN owned o ON o.post = m.post AND o.line = m.line AND o.owner = m.clause),
problems AS (
    SELECT post, 0::INT AS line, 'forwarded' AS code, NULL AS detail FROM ev WHERE forwarded
    UNION ALL SELECT post, line::INT, 'ambiguous', array_to_string(spelled[1:n], ' ') FROM n2 WHERE place_id IS NULL AND EXISTS (SELECT 1 FROM mentions m WHERE m.post = n2.post AND m.line = n2.line)
    UNION ALL SELECT post, line::INT, 'unlocated', string_agg(kind, ',' ORDER BY first) FROM (SELECT post, line, kind, min(first) AS first FROM left_ GROUP BY ALL) u WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.post = u.post AND p.line = u.line) GROUP BY post, line)
"""

SQL: dict[str, str] = {
    "O01_O02_lines": f"{READER} SELECT post AS evidence_id, line, code, detail FROM problems",
    "O03_O06_words": f"{READER} SELECT post AS evidence_id, line::INT AS line, pos, clause, word_kind AS kind, before AS count FROM words WHERE word_kind IS NOT NULL",
    "O05_cleared_clauses": f"{READER} SELECT post AS evidence_id, line::INT AS line, clause AS cleared FROM cleared",
    "O04_O07_mentions": f"{READER} SELECT post AS evidence_id, line::INT AS line, clause, kind, stance, count, words FROM mentions",
    "O08_absorbed": f"{READER} SELECT post AS evidence_id, line::INT AS line, clause, kind, stance FROM left_",
    "O09_O12_places": f"{READER} SELECT post AS evidence_id, line::INT AS line, clause, place_id, lat::DOUBLE AS lat FROM places",
    "O13_O14_observations": f"{READER} SELECT post AS evidence_id, kind, stance, count, place_id, words AS matched, ({_TTL})::INT AS ttl, lon::DOUBLE AS lon FROM pairs",
    "O15_unlocated": f"{READER} SELECT post AS evidence_id, line, detail FROM problems WHERE code = 'unlocated'",
    "O16_ttls": f"{READER} SELECT kind, stance, ({_TTL})::INT AS ttl, count(*) AS n FROM pairs GROUP BY ALL",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "O01_O02_lines": o01_o02_lines, "O03_O06_words": o03_o06_words, "O04_O07_mentions": o04_o07_mentions, "O05_cleared_clauses": o05_cleared_clauses, "O08_absorbed": o08_absorbed, "O09_O12_places": o09_o12_places,
    "O13_O14_observations": o13_o14_observations, "O15_unlocated": o15_unlocated, "O16_ttls": o16_ttls,
}
