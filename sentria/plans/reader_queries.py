"""Registered queries of the role reader (N) and the bridge (B) over ``conversations``, with DuckDB counterparts.

The tables hold invented prose, so the vocabulary is one of common function
words and syllables in place of hazards and towns. Every query calls the
operators; the SQL reads the same vocabulary.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bridge, role_reader
from ..operators.role_reader import ROLES
from ..operators.vocabulary import READER_KINDS, SOURCE_WORDS, RoleGazetteer, Words, parse_lexicon, parse_role_gazetteer
from ..params import BRIDGE_TTL_MIN, CONTRACT_KIND, MAX_TEXT_CHARS, REGION_PREFIX

LEXICON = json.dumps({
    "version": "lexicon.v1",
    "kinds": {"drone": {"stems": ["thin", "tion"], "forms": ["one"]}, "guided_bomb": {"forms": ["la"]}, "cruise_missile": {"forms": ["der"]}, "ballistic_missile": {"forms": ["is"]}, "missile": {"forms": ["and", "y"]}},
    "cleared": {"forms": ["of", "des"], "phrases": ["in of", "it the"], "negated_by": ["to", "que"], "negated_after": ["on"]}, "intercepted": {"forms": ["was", "est"], "negated_by": ["a"]},
    "cues": {"target": ["in", "en", "zu", "on"], "via": ["for", "par", "von"], "origin": ["with", "con"]}, "conjunctions": ["or", "et", "und", "that"], "fillers": ["a", "un", "ein"], "continuation": {"leads": ["it", "the", "in"], "marks": ["ha"]},
})


def _place(i: int, word: str, **more: object) -> dict:
    match = {"stems": [word], "max_suffix": 3} | {k: v for k, v in more.items() if k in ("stems", "forms", "not", "max_suffix", "capitalized")}
    return {"id": f"geonames:{i}", "name": word, "lat": round(44 + 0.3 * i, 6), "lon": round(22 + 0.7 * i, 6), "reach_km": (5, 8, 12, 20)[i % 4], "match": match} | {k: v for k, v in more.items() if k in ("within", "id", "lat")}


GAZETTEER = json.dumps({"version": "gazetteer.v1", "attribution": "none", "places": [
    *(_place(i, word) for i, word in enumerate(("er", "an", "on", "re", "ti", "sh", "que", "ch", "ge", "os"))),
    _place(10, "th", max_suffix=2, capitalized=True), _place(11, "ed", **{"not": ["edes", "eden"]}), _place(12, "anan", stems=["an an", "er on"], forms=["in the"], max_suffix=4),
    _place(13, "en", within="geonames:1"), _place(14, "at", within="geonames:99"), _place(15, "ou", id=f"{REGION_PREFIX}UA1"), _place(16, "ly", id=f"{REGION_PREFIX}UA2"), _place(17, "ing", lat=95.0),
]})
LEX = parse_lexicon(LEXICON)
#: Cells of the regions that are known; the other one is not.
REGIONS = [(f"{REGION_PREFIX}UA1", 6, ["861e63bb7ffffff", "861e63b97ffffff"])]


def gazetteer() -> RoleGazetteer:
    return parse_role_gazetteer(GAZETTEER)


#: Words of the prose and what stands in their place: unknown towns after cues, and numbers and units.
TOWNS = {" in ": " in Qua", " for ": " for Xi or Er", " with ": " with Er Zeta-", " und ": ", und Ge "}
NUMBERS = {" a ": " 3 ", " to ": " две ", " as ": " 101 ", " of ": " км ", " not ": " 9999999999 ", ". ": ". 2 "}


def spelled(text: Column, words: dict[str, str]) -> Column:
    for old, new in words.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def spelled_sql(text: str, words: dict[str, str]) -> str:
    for old, new in words.items():
        text = f"replace({text}, '{old}', '{new}')"
    return text


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    name = F.concat(F.lit("c/"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn"))
    return c.select(
        F.concat(F.lit("telegram.channel:"), "role").alias("source_id"), name.alias("external_id"), at.alias("published_at"), F.lit(False).alias("edited"), spelled(F.col("text"), TOWNS).alias("text"), F.array().cast("array<struct<kind:string,url:string>>").alias("media"),
        F.when(F.col("conv_id") % 10 == 0, "other").alias("forwarded_from"), F.struct(F.concat(F.lit("https://t.me/"), name).alias("url"), F.lit("table").alias("collector")).alias("provenance"),
    )


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_reader.marked_words(role_reader.split_words(evidence(spark, sf_dir)), LEX)


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_reader.placed_words(_marked(spark, sf_dir), gazetteer())


def _clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_reader.clauses(_placed(spark, sf_dir), LEX)


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_reader.read(evidence(spark, sf_dir), LEX, gazetteer())


_NAME = "external_id"
_roles = lambda places: F.array_join(F.transform(places, lambda p: F.concat(p["place_id"], F.lit("="), p["role"])), ",")


def n01_length_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts that are read, and how many words they have."""
    return role_reader.split_words(evidence(spark, sf_dir)).groupBy(_NAME).agg(F.count(F.lit(1)).alias("n_words"))


def n02_comma_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).groupBy(_NAME, "clause").agg(F.count(F.lit(1)).alias("n_words"), F.min("pos").alias("first"))


def n03_n04_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = _marked(spark, sf_dir)
    names = marked.filter("pos = 1").select("post", _NAME)
    found = role_reader.found_places(marked, gazetteer()).select("post", F.explode("places").alias("p"))
    return found.join(names, "post").select("external_id", "p.pos", "p.n", "p.place.place_id")


def n05_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).filter("kind is not null").select(_NAME, "pos", "kind")


def n06_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before hazards; every tenth word of the prose reads as a number here."""
    numbered = evidence(spark, sf_dir).withColumn("text", spelled(F.col("text"), NUMBERS))
    return role_reader.marked_words(role_reader.split_words(numbered), LEX).filter("count is not null").select(_NAME, "pos", "kind", "count")


def n07_clause_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = evidence(spark, sf_dir).withColumn("text", spelled(F.col("text"), NUMBERS))
    found = role_reader.clauses(role_reader.placed_words(role_reader.marked_words(role_reader.split_words(numbered), LEX), gazetteer()), LEX)
    return found.select(_NAME, "clause", F.posexplode("counts").alias("rank", "count")).filter("count is not null").select("external_id", "clause", F.get(F.array(*map(F.lit, READER_KINDS)), F.col("rank")).alias("kind"), "count")


def n08_n10_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).filter("clears or hit").select(_NAME, "pos", "clears", "hit")


def n11_n12_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).filter("role is not null").select(_NAME, "pos", "role", "before_cue", "unknown")


def n14_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clauses(spark, sf_dir).filter(F.size("unresolved") > 0).select(_NAME, "clause", F.array_join("unresolved", ",").alias("unresolved"))


def n15_merged_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clauses(spark, sf_dir).select(_NAME, "clause", F.posexplode("places").alias("nth", "p")).select("external_id", "clause", "nth", "p.place_id", "p.role", "p.reach_km")


def n16_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clauses(spark, sf_dir).filter("inherited").select(_NAME, "clause", F.array_join("kinds", ",").alias("kinds"))


def n09_n18_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clauses(spark, sf_dir).select(_NAME, "clause", "phase", "clear_word", F.array_join("kinds", ",").alias("kinds"))


def n13_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _readings(spark, sf_dir).select("external_id", "statement", "kind", "kind_inherited", "phase", "count", _roles("places").alias("places"), F.array_join("unresolved", ",").alias("unresolved"), "forwarded", "url")


def n21_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _readings(spark, sf_dir).select("external_id", "statement", _roles(role_reader.affected()).alias("affected"), F.coalesce(role_reader.actionable(), F.lit(False)).alias("actionable"))


def n22_actionable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_reader.coverage(_readings(spark, sf_dir))[0]


def n23_unresolved_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_reader.coverage(_readings(spark, sf_dir))[1]


def n24_other_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same posts with a longer limit and without places."""
    none = RoleGazetteer([])
    return role_reader.read(evidence(spark, sf_dir), LEX, none, 2000).groupBy("kind", "phase").agg(F.count(F.lit(1)).alias("n"))


def b01_b03_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.skipped(_readings(spark, sf_dir)).withColumn("wire", bridge.wire_code("code"))


def _bridged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return bridge.bridge_all(_readings(spark, sf_dir), spark.createDataFrame(REGIONS, "id string, resolution int, cells array<string>"))


def b04_b09_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("provenance")
    return _bridged(spark, sf_dir)[0].select(
        p["evidence_id"].alias("evidence_id"), "kind", "stance", "count", "ttl", p["place_id"].alias("place_id"), p["place_role"].alias("place_role"), p["statement"].alias("statement"), p["place_order"].alias("place_order"),
        F.array_join(p["matched"], ",").alias("matched"), F.col("geometry.type").alias("shape"), F.coalesce(F.size(F.get("geometry.rings", F.lit(0))), F.size("geometry.cells")).alias("corners"),
    )


def b08_b10_unplaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bridged(spark, sf_dir)[1].withColumn("wire", bridge.wire_code("code")).groupBy("evidence_id", "code", "wire").agg(F.count(F.lit(1)).alias("n"))


# The same in SQL
_q = lambda s: s.replace("'", "''")
_list = lambda values: "[" + ", ".join(f"'{_q(v)}'" for v in values) + "]"
_IS_WORD = r"regexp_matches(part, '^[\p{L}\p{N}\x{300}\x{301}]')"
_BREAK = f"regexp_matches(part, '^{T.ROLE_BREAK}$')"
_FOLD_SQL = f"translate(lower({{}}), '{_q(T.FOLD_FROM)}', '{T.FOLD_TO}')"


def _any(column: str, words: Words) -> str:
    tests = [f"list_contains({_list(sorted(words.forms))}, {column})"] * bool(words.forms) + [f"starts_with({column}, '{_q(s)}')" for s in words.stems]
    return f"coalesce({' OR '.join(tests) or 'false'}, false)"


def _clear(window: str) -> str:
    return f"{_any('plain', LEX.cleared)} AND NOT {_any(f'lag(plain) OVER {window}', LEX.negated_by)} AND NOT {_any(f'lead(plain) OVER {window}', LEX.negated_after)} AND NOT {_any(f'lead(plain, 2) OVER {window}', LEX.negated_after)}"


_KIND = "CASE " + " ".join(f"WHEN {_any('plain', w)} THEN '{k}'" for k, w in LEX.kinds.items()) + " " + " ".join(f"WHEN plain = '{w}' AND source_id = '{s}' THEN '{k}'" for (s, w), k in SOURCE_WORDS.items()) + " END"
_CUE = "CASE " + " ".join(f"WHEN {_any('plain', LEX.cues[r])} THEN {ROLES.index(r)}" for r in ("target", "via", "origin")) + " END"
_NUMBER = "CASE WHEN regexp_matches({0}, '^[0-9]+$') THEN coalesce(TRY_CAST({0} AS INT), 0) " + " ".join(f"WHEN {{0}} = '{w}' THEN {n}" for w, n in T.NUMBER_WORDS.items()) + " END"
_near = lambda number, unit: f"CASE WHEN {number} BETWEEN 1 AND 100 AND NOT list_contains({_list(sorted(T.UNITS))}, {unit}) THEN {number} END"
_PATTERNS = ",\n    ".join(
    f"({n}, {len(pattern)}, {_list([w for w, _ in pattern])}, [{', '.join(str(e).lower() for _, e in pattern)}], {_list(sorted(place.vetoed)) if len(pattern) == 1 and place.vetoed else '[]::VARCHAR[]'}, {place.max_suffix}, {str(place.capitalized).lower()}, "
    f"{repr(place.within) if place.within else 'NULL'}, '{place.id}', {place.reach_km}, {place.lat})"
    for n, (place, pattern) in enumerate((place, pattern) for place in gazetteer().places for pattern in place.patterns)
)
_fits = lambda i: f"(n < {i} OR ahead[{i}] = spelled[{i}] OR NOT exact[{i}] AND starts_with(ahead[{i}], spelled[{i}]) AND length(ahead[{i}]) - length(spelled[{i}]) <= max_suffix)"
_ROLE_NAME = f"{_list(ROLES)}[{{}} + 1]"
_PHRASE = " OR ".join(f"ahead[1:{len(p)}] = {_list(p)}" for p in LEX.phrases)


def reader_sql(text: str = spelled_sql("text", TOWNS), limit: int = MAX_TEXT_CHARS, places: bool = True) -> str:
    """The reader as common table expressions, up to ``readings``."""
    return rf"""
WITH RECURSIVE ev AS (SELECT 'c/' || conv_id || '-' || turn AS post, 'telegram.channel:' || role AS source_id, conv_id % 10 = 0 AS forwarded, {text} AS text FROM conversations WHERE text IS NOT NULL AND length({text}) <= {limit}),
q0 AS (SELECT post, source_id, forwarded, regexp_extract_all(text, '{_q(T.ROLE_PARTS)}') AS parts FROM ev),
q1 AS (SELECT post, source_id, forwarded, unnest(range(1, len(parts) + 1)) AS idx, unnest(parts) AS part FROM q0),
q2 AS (SELECT *, sum({_BREAK}::INT) OVER p AS sentence, sum((part = ',')::INT) OVER p AS commas FROM q1 WINDOW p AS (PARTITION BY post ORDER BY idx ROWS UNBOUNDED PRECEDING)),
words AS (SELECT post, source_id, forwarded, (row_number() OVER (PARTITION BY post ORDER BY idx))::INT AS pos, part AS text, {_FOLD_SQL.format('part')} AS plain, sentence,
    coalesce(commas > lag(commas) OVER (PARTITION BY post, sentence ORDER BY idx), false) AS after_comma FROM q2 WHERE {_IS_WORD}),
k0 AS (SELECT *, {_KIND} AS kind, {_CUE} AS cue, {_any('plain', LEX.conjunctions)} AS joins, {_any('plain', LEX.fillers)} AS fills, {_clear('s')} AS says_clear,
    sum(after_comma::INT) OVER s AS segment, row_number() OVER s = 1 AS opens FROM words WINDOW s AS (PARTITION BY post, sentence ORDER BY pos)),
k1 AS (SELECT *, after_comma AND bool_or(says_clear) OVER (PARTITION BY post, sentence) AND count(kind) OVER (PARTITION BY post, sentence, segment) > 0 AS cuts FROM k0),
k2 AS (SELECT *, (sum((opens OR cuts)::INT) OVER (PARTITION BY post ORDER BY pos ROWS UNBOUNDED PRECEDING))::BIGINT AS clause FROM k1),
k3 AS (SELECT *, lag(plain) OVER c AS one, lag(plain, 2) OVER c AS two, {_clear('c')} AS clears, {_any('plain', LEX.intercepted)} AND NOT {_any('lag(plain) OVER c', LEX.intercepted_negated_by)} AS hit,
    list(plain) OVER (PARTITION BY post, clause ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS ahead,
    coalesce(sum((cue IS NULL AND NOT fills)::INT) OVER (PARTITION BY post, clause ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM k2 WINDOW c AS (PARTITION BY post, clause ORDER BY pos)),
marked AS (SELECT *, CASE WHEN kind IS NOT NULL THEN CASE WHEN {_NUMBER.format('one')} IS NOT NULL THEN {_near(_NUMBER.format('one'), 'plain')} ELSE {_near(_NUMBER.format('two'), 'one')} END END AS count,
    max(cue) OVER (PARTITION BY post, clause, run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_cue FROM k3),
patterns(rank, n, spelled, exact, vetoed, max_suffix, capitalized, within, place_id, reach_km, lat) AS (VALUES {_PATTERNS}),
m0 AS (SELECT post, pos, n, rank, within, place_id, reach_km, lat FROM marked, patterns WHERE {str(places).lower()} AND len(ahead) >= n AND {_fits(1)} AND {_fits(2)} AND {_fits(3)} AND NOT list_contains(vetoed, plain) AND (NOT capitalized OR regexp_matches(text, '^\p{{Lu}}'))),
c1 AS (SELECT *, row_number() OVER (PARTITION BY post ORDER BY pos, n DESC, rank) AS rn FROM m0 WHERE within IS NULL),
g1(post, rn, free, kept, place_id) AS (SELECT DISTINCT post, 0::BIGINT, 0::INT, false, NULL::VARCHAR FROM c1 UNION ALL SELECT g1.post, c1.rn, CASE WHEN c1.pos >= free THEN c1.pos + c1.n ELSE free END, c1.pos >= free, c1.place_id FROM g1 JOIN c1 ON c1.post = g1.post AND c1.rn = g1.rn + 1),
cities AS (SELECT DISTINCT post, place_id FROM g1 WHERE kept),
c2 AS (SELECT *, row_number() OVER (PARTITION BY post ORDER BY pos, n DESC, rank) AS rn FROM m0 WHERE within IS NULL OR EXISTS (SELECT 1 FROM cities c WHERE c.post = m0.post AND c.place_id = m0.within)),
g2(post, rn, free, kept) AS (SELECT DISTINCT post, 0::BIGINT, 0::INT, false FROM c2 UNION ALL SELECT g2.post, c2.rn, CASE WHEN c2.pos >= free THEN c2.pos + c2.n ELSE free END, c2.pos >= free FROM g2 JOIN c2 ON c2.post = g2.post AND c2.rn = g2.rn + 1),
places AS (SELECT c2.* FROM c2 JOIN g2 ON g2.post = c2.post AND g2.rn = c2.rn AND g2.kept),
f0 AS (SELECT m.*, p.place_id, p.reach_km, p.lat, EXISTS (SELECT 1 FROM places x WHERE x.post = m.post AND x.pos < m.pos AND m.pos < x.pos + x.n) AS covered FROM marked m LEFT JOIN places p ON p.post = m.post AND p.pos = m.pos),
f1 AS (SELECT *, place_id IS NULL AND NOT covered AND kind IS NULL AND NOT clears AND NOT hit AND cue IS NULL AND NOT joins AND regexp_matches(text, '^\p{{Lu}}') AND length(plain) >= 4 AS unknown FROM f0),
f2 AS (SELECT *, (place_id IS NOT NULL OR unknown) AND (before_cue IS NOT NULL OR NOT coalesce(last_value(CASE WHEN NOT joins THEN place_id IS NOT NULL OR unknown OR covered END IGNORE NULLS) OVER (PARTITION BY post, clause ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)) AS first FROM f1),
f3 AS (SELECT *, CASE WHEN first THEN pos ELSE last_value(CASE WHEN first AND NOT joins THEN pos END IGNORE NULLS) OVER (PARTITION BY post, clause ORDER BY pos ROWS UNBOUNDED PRECEDING) END AS list FROM f2),
f4 AS (SELECT *, max(CASE WHEN first THEN before_cue END) OVER l AS lead, bool_or(unknown) OVER l AS lost FROM f3 WINDOW l AS (PARTITION BY post, clause, list ORDER BY pos ROWS UNBOUNDED PRECEDING)),
placed AS (SELECT *, CASE WHEN (place_id IS NOT NULL OR unknown) AND lead >= 2 THEN lead WHEN place_id IS NOT NULL THEN CASE WHEN lead = 1 AND NOT lost THEN 1 ELSE 0 END END AS role,
    sum((NOT covered)::INT) OVER c AS nth, row_number() OVER c = 1 AS initial FROM f4 WINDOW c AS (PARTITION BY post, clause ORDER BY pos ROWS UNBOUNDED PRECEDING)),
merged AS (SELECT post, clause, place_id, min(pos) AS pos, max(role) AS role, any_value(reach_km) AS reach_km, any_value(lat) AS lat FROM placed WHERE place_id IS NOT NULL GROUP BY ALL),
named AS (SELECT post, clause, list(place_id || '=' || {_ROLE_NAME.format('role')} ORDER BY pos) AS places, list(place_id || '=' || {_ROLE_NAME.format('role')} ORDER BY pos) FILTER (role >= 2) AS affected FROM merged GROUP BY ALL),
missed AS (SELECT post, clause, list(text ORDER BY pos) AS unresolved FROM (SELECT post, clause, text, min(pos) AS pos FROM placed WHERE unknown AND role IS NOT NULL GROUP BY ALL) GROUP BY ALL),
said AS (SELECT post, clause, any_value(forwarded) AS forwarded, [{', '.join(f"bool_or(place_id IS NULL AND NOT covered AND coalesce(kind = '{k}', false))" for k in READER_KINDS)}] AS has,
    [{', '.join(f"max(count) FILTER (place_id IS NULL AND NOT covered AND kind = '{k}')" for k in READER_KINDS)}] AS counts, bool_or(place_id IS NULL AND NOT covered AND kind IS NULL AND clears) AS clear_word,
    bool_or(NOT covered AND ({_PHRASE})) AS phrase, bool_or(place_id IS NULL AND NOT covered AND kind IS NULL AND NOT clears AND hit) AS hit,
    bool_or(NOT covered AND (nth <= 2 AND {_any('plain', LEX.leads)} OR {_any('plain', LEX.marks)})) AS refers, bool_or(initial AND regexp_matches(plain, '^[0-9]+$')) AS counted FROM placed GROUP BY ALL),
told AS (SELECT post, clause, forwarded, list_filter({_list(READER_KINDS)}, lambda k, i: has[i]) AS own_kinds, counts, clear_word, hit, refers, counted, clear_word OR phrase AS cleared, coalesce(places, []) AS places, coalesce(affected, []) AS affected, coalesce(unresolved, []) AS unresolved
    FROM said LEFT JOIN named USING (post, clause) LEFT JOIN missed USING (post, clause)),
told2 AS (SELECT *, last_value(CASE WHEN len(own_kinds) > 0 THEN {{'kinds': own_kinds, 'cleared': cleared, 'placed': len(places) > 0}} END IGNORE NULLS) OVER (PARTITION BY post ORDER BY clause ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM told),
told3 AS (SELECT *, coalesce(len(own_kinds) = 0 AND NOT cleared AND len(affected) > 0 AND before IS NOT NULL AND NOT before.cleared AND (refers OR counted AND NOT before.placed), false) AS inherited FROM told2),
clauses AS (SELECT *, CASE WHEN inherited THEN before.kinds ELSE own_kinds END AS kinds, CASE WHEN cleared THEN 'cleared' WHEN hit THEN 'intercepted' ELSE 'threat' END AS phase FROM told3),
r0 AS (SELECT *, CASE WHEN list_has_any(kinds, ['ballistic_missile', 'cruise_missile']) THEN list_filter(kinds, lambda k: k <> 'missile') ELSE kinds END AS left_kinds FROM clauses),
r1 AS (SELECT *, unnest(CASE WHEN len(left_kinds) > 0 THEN left_kinds WHEN clear_word THEN [NULL] ELSE [] END) AS kind FROM r0),
readings AS (SELECT post AS external_id, (row_number() OVER (PARTITION BY post ORDER BY clause, list_position({_list(READER_KINDS)}, kind)) - 1)::INT AS statement, clause, kind, inherited AS kind_inherited, phase, counts[list_position({_list(READER_KINDS)}, kind)] AS count, places, affected, unresolved, forwarded FROM r1)
"""


READER = reader_sql()
_numbered = spelled_sql(spelled_sql("text", TOWNS), NUMBERS)
_actionable = "(phase = 'threat' AND kind IS NOT NULL AND len(affected) > 0)"
_TTL = "CASE kind " + " ".join(f"WHEN '{k}' THEN {BRIDGE_TTL_MIN[k] * 60}" for k in READER_KINDS) + " END"
_CONTRACT = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CONTRACT_KIND.items()) + " END"
_CLEAR_TTL = BRIDGE_TTL_MIN["clear"] * 60
_BRIDGED = f"""{READER},
located AS (SELECT external_id, r.clause, kind, kind_inherited, phase, count, statement, a.place_id, CASE a.role WHEN 2 THEN 'via' ELSE 'target' END AS place_role, (row_number() OVER (PARTITION BY external_id, statement ORDER BY a.pos) - 1)::INT AS place_order,
    CASE WHEN abs(a.lat) > 90 THEN 'invalid_geometry' WHEN a.place_id = '{REGION_PREFIX}UA2' THEN 'unknown_region' END AS code FROM readings r JOIN merged a ON a.post = r.external_id AND a.clause = r.clause AND a.role >= 2 WHERE NOT forwarded AND kind IS NOT NULL),
obs AS (SELECT *, CASE phase WHEN 'cleared' THEN 'clear' WHEN 'intercepted' THEN 'neutralized' ELSE 'threat' END AS stance, count AS of_count FROM located WHERE code IS NULL
    UNION ALL SELECT *, 'threat', NULL FROM located WHERE code IS NULL AND phase = 'intercepted')
"""

SQL: dict[str, str] = {
    "N01_length_gate": f"{READER} SELECT post AS external_id, count(*) AS n_words FROM words GROUP BY post",
    "N02_comma_splits": f"{READER} SELECT post AS external_id, clause, count(*) AS n_words, min(pos) AS first FROM marked GROUP BY ALL",
    "N03_N04_places": f"{READER} SELECT post AS external_id, pos, n, place_id FROM places",
    "N05_kinds": f"{READER} SELECT post AS external_id, pos, kind FROM marked WHERE kind IS NOT NULL",
    "N06_counts": f"{reader_sql(_numbered)} SELECT post AS external_id, pos, kind, count FROM marked WHERE count IS NOT NULL",
    "N07_clause_counts": f"{reader_sql(_numbered)} SELECT * FROM (SELECT post AS external_id, clause, unnest({_list(READER_KINDS)}) AS kind, unnest(counts) AS count FROM clauses) WHERE count IS NOT NULL",
    "N08_N10_marks": f"{READER} SELECT post AS external_id, pos, clears, hit FROM marked WHERE clears OR hit",
    "N09_N18_phases": f"{READER} SELECT post AS external_id, clause, phase, clear_word, array_to_string(kinds, ',') AS kinds FROM clauses",
    "N11_N12_roles": f"{READER} SELECT post AS external_id, pos, {_ROLE_NAME.format('role')} AS role, {_ROLE_NAME.format('before_cue')} AS before_cue, unknown FROM placed WHERE role IS NOT NULL",
    "N13_readings": f"{READER} SELECT external_id, statement, kind, kind_inherited, phase, count, array_to_string(places, ',') AS places, array_to_string(unresolved, ',') AS unresolved, forwarded, 'https://t.me/' || external_id AS url FROM readings",
    "N14_unresolved": f"{READER} SELECT post AS external_id, clause, array_to_string(unresolved, ',') AS unresolved FROM clauses WHERE len(unresolved) > 0",
    "N15_merged_mentions": f"{READER} SELECT post AS external_id, clause, (row_number() OVER (PARTITION BY post, clause ORDER BY pos) - 1)::INT AS nth, place_id, {_ROLE_NAME.format('role')} AS role, reach_km FROM merged",
    "N16_carry_forward": f"{READER} SELECT post AS external_id, clause, array_to_string(kinds, ',') AS kinds FROM clauses WHERE inherited",
    "N21_affected": f"{READER} SELECT external_id, statement, array_to_string(affected, ',') AS affected, {_actionable} AS actionable FROM readings",
    "N22_actionable": f"{READER} SELECT count(*) AS readings, count(*) FILTER ({_actionable}) AS actionable, count(*) FILTER (kind_inherited) AS inherited FROM readings",
    "N23_unresolved_top20": f"{READER} SELECT word, count(*) AS n FROM (SELECT unnest(unresolved) AS word FROM readings) GROUP BY word ORDER BY n DESC, word LIMIT 20",
    "N24_other_vocabulary": f"{reader_sql(limit=2000, places=False)} SELECT kind, phase, count(*) AS n FROM readings GROUP BY ALL",
    "B01_B03_skipped": f"{READER} SELECT DISTINCT external_id AS evidence_id, 'forwarded' AS code, 'forwarded' AS wire FROM readings WHERE forwarded UNION ALL SELECT external_id, 'unlocated_clear', 'unlocated_clear' FROM readings WHERE NOT forwarded AND phase = 'cleared' AND (kind IS NULL OR len(affected) = 0)",
    "B04_B09_observations": f"{_BRIDGED} SELECT external_id AS evidence_id, {_CONTRACT} AS kind, stance, of_count AS count, (CASE WHEN stance = 'threat' THEN {_TTL} ELSE {_CLEAR_TTL} END)::INT AS ttl, place_id, place_role, statement, place_order, CASE WHEN kind_inherited THEN 'kind_inherited' ELSE '' END AS matched, CASE WHEN starts_with(place_id, '{REGION_PREFIX}') THEN 'cells' ELSE 'polygon' END AS shape, (CASE WHEN starts_with(place_id, '{REGION_PREFIX}') THEN 2 ELSE 49 END)::INT AS corners FROM obs",
    "B08_B10_unplaced": f"{_BRIDGED} SELECT external_id AS evidence_id, code, 'invalid_geometry' AS wire, count(*) AS n FROM located WHERE code IS NOT NULL GROUP BY ALL",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "N01_length_gate": n01_length_gate, "N02_comma_splits": n02_comma_splits, "N03_N04_places": n03_n04_places, "N05_kinds": n05_kinds, "N06_counts": n06_counts, "N07_clause_counts": n07_clause_counts, "N08_N10_marks": n08_n10_marks,
    "N09_N18_phases": n09_n18_phases, "N11_N12_roles": n11_n12_roles, "N13_readings": n13_readings, "N14_unresolved": n14_unresolved, "N15_merged_mentions": n15_merged_mentions, "N16_carry_forward": n16_carry_forward,
    "N21_affected": n21_affected, "N22_actionable": n22_actionable, "N23_unresolved_top20": n23_unresolved_top20, "N24_other_vocabulary": n24_other_vocabulary, "B01_B03_skipped": b01_b03_skipped,
    "B04_B09_observations": b04_b09_observations, "B08_B10_unplaced": b08_b10_unplaced,
}
