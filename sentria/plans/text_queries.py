"""Registered queries of text scalars (T) and of namesakes (O10) over the text tables, with DuckDB counterparts."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.vocabulary import resolved_names

#: A set of words.
KIND_FORMS, KIND_STEMS = ("the", "la", "der"), ("thin", "cion")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.col("role").alias("source"), "text")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def t01_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.fold(F.concat("text", F.lit(" Її Ґанок об'їзд ЁЛКА"))).cast("binary")).alias("folded"))


def t02_normalize_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.normalize_word(F.concat("text", F.lit(" Ко\u0301рабль Її ЁЛКА об’їзд"))).cast("binary")).alias("normalized"))


def t03_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, breaks and commas of every document, counted."""
    return _docs(spark, sf_dir).select("doc_id", F.explode(T.role_parts("text")).alias("part")).groupBy("doc_id").agg(
        F.count_if(T.is_word("part")).alias("n_words"), F.count_if(F.col("part").rlike(f"^{T.ROLE_BREAK}$")).alias("n_breaks"), F.count_if(F.col("part") == ",").alias("n_commas"))


def _role_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, turn, pos, original, folded, sentence`` of every word."""
    parts = _texts(spark, sf_dir).select("conv_id", "turn", F.posexplode(T.role_parts("text")).alias("at", "part"))
    w = Window.partitionBy("conv_id", "turn").orderBy("at")
    breaks = parts.withColumn("sentence", F.sum(F.col("part").rlike(f"^{T.ROLE_BREAK}$").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return breaks.filter(T.is_word("part")).select("conv_id", "turn", F.row_number().over(w).alias("pos"), F.col("part").alias("original"), T.fold("part").alias("folded"), "sentence")


def t04_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of each line."""
    lines = _texts(spark, sf_dir).select("conv_id", "turn", F.posexplode(T.lines("text")).alias("line", "value"))
    words = lines.select("conv_id", "turn", "line", F.inline(T.point_tokens("value")))
    return words.groupBy("conv_id", "turn", "line", F.col("clause").cast("long").alias("clause")).agg(F.count(F.lit(1)).alias("n_words"), F.min("norm").alias("least"))


def _word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _role_tokens(spark, sf_dir).groupBy("folded").agg(F.count(F.lit(1)).alias("n"))


def t05_capitalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _role_tokens(spark, sf_dir).groupBy("conv_id").agg(F.count_if(T.is_capitalized("original")).alias("n_capitalized"))


def t06_t07_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _word_counts(spark, sf_dir)
    return words.select(F.col("folded").alias("word"), "n", T.matches_pattern("folded", F.lit("th"), False, 2).alias("stem"), T.matches_any("folded", list(KIND_FORMS), list(KIND_STEMS)).alias("set")).filter("stem or set")


def t08_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _word_counts(spark, sf_dir).filter(T.is_form_of("folded", ["the", "ed"], ("", "re", "in", "an", "sh"))).select(F.col("folded").alias("word"), "n")


def t09_t10_t11_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems, skeletons and keys of Cyrillic names made from numbers of parts."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    heads, tails = ["киев", "черниг", "запорож", "одесс", "полтав"], ["ами", "ого", "ье", "а", "ою", "ий", ""]
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))
    word = F.concat(pick(heads, F.col("p_partkey")), pick(tails, F.floor(F.col("p_partkey") / 5)))
    named = parts.select("p_partkey", word.alias("word"), F.concat(word, F.lit(" "), pick(heads, F.col("p_partkey") + 1)).alias("name"))
    return named.select("p_partkey", T.stem("word", 3).alias("stem"), T.skeleton("word").alias("skeleton"), T.name_key(F.split("name", " ")).alias("key"))


def t12_t13_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return parts.select("p_partkey", T.number(F.col("p_partkey").cast("string")).alias("number"), T.number_word(F.when(F.col("p_partkey") % 3 == 0, F.lit("шесть")).when(F.col("p_partkey") % 3 == 1, F.lit("слово")).otherwise(F.col("p_size").cast("string"))).alias("word"))


def t14_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.length(T.collapse_whitespace("text")).cast("long").alias("n_chars"))


def t15_strip_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.strip_stress(F.concat("text", F.lit("за\u0301мок"))).cast("binary")).alias("plain"))


def t16_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.size(T.lines("text")).alias("n_lines"))


def o10_namesakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation as namesakes: rank by key, population by balance; the winner or none."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    places = s.select((F.col("s_suppkey") % 40).cast("string").alias("key"), F.lit(1).alias("n_words"), F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), (F.col("s_suppkey") % 4).cast("int").alias("rank"), F.floor(F.abs("s_acctbal") * F.abs("s_acctbal")).alias("population"))
    return resolved_names(places).select("key", F.col("place.id").alias("id"), "ambiguous")


_FOLD_SQL = f"translate(lower({{}}), '{T.FOLD_FROM.replace(chr(39), chr(39) * 2)}', '{T.FOLD_TO}')"
_NORM_SQL = f"translate(lower({{}}), '{T.NORM_FROM.replace(chr(39), chr(39) * 2)}', '{T.NORM_TO}')"
_q = lambda s: s.replace("'", "''")
_IS_WORD = r"regexp_matches(part, '^[\p{L}\p{N}\x{300}\x{301}]')"
_BREAK = f"regexp_matches(part, '^{T.ROLE_BREAK}$')"
_IN = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"
_KIND = lambda c: f"({c} IN {_IN(KIND_FORMS)} OR " + " OR ".join(f"starts_with({c}, '{s}')" for s in KIND_STEMS) + ")"
_TOKENS = f"""
p0 AS (SELECT conv_id, turn, regexp_extract_all(text, '{_q(T.ROLE_PARTS)}') AS parts FROM conversations),
p AS (SELECT conv_id, turn, unnest(range(1, len(parts) + 1)) AS idx, unnest(parts) AS part FROM p0),
b AS (SELECT *, sum({_BREAK}::INT) OVER (PARTITION BY conv_id, turn ORDER BY idx ROWS UNBOUNDED PRECEDING)::BIGINT AS sentence FROM p),
tokens AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY idx)::INT AS pos, part AS original, {_FOLD_SQL.format("part")} AS folded, sentence FROM b WHERE {_IS_WORD})
"""


def _point_words(line: str, value: str, source: str) -> str:
    return f"""
l0 AS (SELECT conv_id, turn, {line} AS line, regexp_extract_all({value}, '{_q(T.POINT_PARTS)}') AS parts FROM {source}),
l1 AS (SELECT conv_id, turn, line, unnest(range(1, len(parts) + 1)) AS idx, unnest(parts) AS part FROM l0),
l2 AS (SELECT *, sum((NOT {_IS_WORD})::INT) OVER (PARTITION BY conv_id, turn, line ORDER BY idx ROWS UNBOUNDED PRECEDING)::BIGINT AS clause FROM l1),
words AS (SELECT *, {_NORM_SQL.format("part")} AS norm FROM l2 WHERE {_IS_WORD})
"""


_LINES = r"CASE WHEN regexp_split_to_array(text, '\r?\n')[-1] = '' THEN regexp_split_to_array(text, '\r?\n')[:-2] ELSE regexp_split_to_array(text, '\r?\n') END"
_STEM = "coalesce(" + ", ".join(f"CASE WHEN ends_with({{0}}, '{e}') AND length({{0}}) - {len(e)} >= 3 THEN left({{0}}, length({{0}}) - {len(e)}) END" for e in T.ENDINGS) + ", {0})"

#: Letters with a grave or acute accent and what they are without it: DuckDB composes, but doesn't decompose.
_ACCENTED = {c: plain for c in map(chr, range(0xC0, 0x2000)) if (plain := unicodedata.normalize("NFC", unicodedata.normalize("NFD", c).replace("\u0300", "").replace("\u0301", ""))) != c and len(plain) == 1}

SQL: dict[str, str] = {
    "T01_fold": f"SELECT doc_id, md5({_FOLD_SQL.format(chr(40) + 'text || ' + chr(39) + ' Її Ґанок об' + chr(39) * 2 + 'їзд ЁЛКА' + chr(39) + chr(41))}) AS folded FROM documents",
    "T02_normalize_word": f"SELECT doc_id, md5({_NORM_SQL.format(chr(40) + 'text || ' + chr(39) + ' Ко' + chr(0x301) + 'рабль Її ЁЛКА об’їзд' + chr(39) + chr(41))}) AS normalized FROM documents",
    "T03_tokens": f"SELECT doc_id, count(*) FILTER ({_IS_WORD}) AS n_words, count(*) FILTER ({_BREAK}) AS n_breaks, count(*) FILTER (part = ',') AS n_commas FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_q(T.ROLE_PARTS)}')) AS part FROM documents) GROUP BY doc_id",
    "T04_clauses": f"WITH t AS (SELECT conv_id, turn, {_LINES} AS ls FROM conversations), u AS (SELECT conv_id, turn, unnest(range(0, len(ls))) AS n, unnest(ls) AS value FROM t), {_point_words(line='n', value='value', source='u')} SELECT conv_id, turn, line::INT AS line, clause, count(*) AS n_words, min(norm) AS least FROM words GROUP BY ALL",
    "T05_capitalized": rf"WITH {_TOKENS} SELECT conv_id, count(*) FILTER (regexp_matches(original, '^\p{{Lu}}')) AS n_capitalized FROM tokens GROUP BY conv_id",
    "T06_T07_patterns": f"WITH {_TOKENS} SELECT * FROM (SELECT folded AS word, count(*) AS n, starts_with(folded, 'th') AND length(folded) - 2 <= 2 AS stem, {_KIND('folded')} AS \"set\" FROM tokens GROUP BY folded) WHERE stem OR \"set\"",
    "T08_forms": f"WITH {_TOKENS} SELECT folded AS word, count(*) AS n FROM tokens WHERE folded IN {_IN([s + e for s in ('the', 'ed') for e in ('', 're', 'in', 'an', 'sh')])} OR starts_with(folded, 'the-') OR starts_with(folded, 'ed-') GROUP BY folded",
    "T09_T10_T11_keys": f"""WITH w AS (SELECT p_partkey, ['киев', 'черниг', 'запорож', 'одесс', 'полтав'][p_partkey % 5 + 1] || ['ами', 'ого', 'ье', 'а', 'ою', 'ий', ''][floor(p_partkey / 5)::BIGINT % 7 + 1] AS word, ['киев', 'черниг', 'запорож', 'одесс', 'полтав'][(p_partkey + 1) % 5 + 1] AS second FROM part),
        s AS (SELECT p_partkey, {_STEM.format('word')} AS stem, translate(word, '{T.VOWELS}', '') AS skeleton, {_STEM.format('second')} AS other FROM w) SELECT p_partkey, stem, skeleton, stem || ' ' || translate(other, '{T.VOWELS}', '') AS key FROM s""",
    "T12_T13_numbers": "SELECT p_partkey, CASE WHEN p_partkey BETWEEN 1 AND 1000 THEN p_partkey::INT END AS number, CASE p_partkey % 3 WHEN 0 THEN 6 WHEN 1 THEN NULL ELSE p_size END AS word FROM part",
    "T14_collapse": r"SELECT doc_id, length(trim(regexp_replace(text, '\s+', ' ', 'g')))::BIGINT AS n_chars FROM documents",
    "T15_strip_stress": f"SELECT doc_id, md5(translate(nfc_normalize(text || 'за' || chr(769) || 'мок'), '{''.join(_ACCENTED)}' || chr(768) || chr(769), '{''.join(_ACCENTED.values())}')) AS plain FROM documents",
    "T16_lines": f"SELECT doc_id, len({_LINES})::INT AS n_lines FROM documents",
    "O10_namesakes": """WITH p AS (SELECT (s_suppkey % 40)::VARCHAR AS key, s_suppkey::VARCHAR AS id, (s_suppkey % 4)::INT AS rank, floor(abs(s_acctbal) * abs(s_acctbal))::BIGINT AS population FROM supplier),
        r AS (SELECT *, row_number() OVER w AS n, lead(rank) OVER w AS rank2, lead(population) OVER w AS population2 FROM p WINDOW w AS (PARTITION BY key ORDER BY rank DESC, population DESC, id)),
        c AS (SELECT key, id, population2 IS NULL OR rank > rank2 OR (population > 0 AND population >= 10 * population2) AS clear FROM r WHERE n = 1) SELECT key, CASE WHEN clear THEN id END AS id, NOT clear AS ambiguous FROM c""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "T01_fold": t01_fold, "T02_normalize_word": t02_normalize_word, "T03_tokens": t03_tokens, "T04_clauses": t04_clauses, "T05_capitalized": t05_capitalized, "T06_T07_patterns": t06_t07_patterns, "T08_forms": t08_forms,
    "T09_T10_T11_keys": t09_t10_t11_keys, "T12_T13_numbers": t12_t13_numbers, "T14_collapse": t14_collapse, "T15_strip_stress": t15_strip_stress, "T16_lines": t16_lines, 
    
    "O10_namesakes": o10_namesakes, 
}
