"""Vocabularies: loading, checking and building gazetteers and lexicons.

Every vocabulary is what the caller gives. Small documents are checked on the
driver; place tables are built by joins and stay DataFrames.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import folded
from ..params import REGION_PREFIX

READER_KINDS = ("drone", "guided_bomb", "cruise_missile", "ballistic_missile", "missile")
#: Shorthand that two sources use (fixed values).
SOURCE_WORDS = {
    ("telegram.channel:war_monitor", "бр"): "ballistic_missile",
    ("telegram.channel:monitorwarr", "реактив"): "drone",
    ("telegram.channel:monitorwarr", "реактиви"): "drone",
    ("telegram.channel:monitorwarr", "реактивив"): "drone",
}


class BadVocabulary(ValueError):
    """The document is not of the version or shape that is read here."""


def _checked(document: dict, allowed: set[str], needed: set[str], what: str) -> dict:
    if unknown := set(document) - allowed - needed:
        raise BadVocabulary(f"{what}: unknown field {sorted(unknown)[0]}")
    if missing := needed - set(document):
        raise BadVocabulary(f"{what}: field {sorted(missing)[0]} is missing")
    return document


@dataclass(frozen=True)
class Words:
    """A word matches a form, or begins with a stem."""

    forms: frozenset[str] = frozenset()
    stems: tuple[str, ...] = ()

    @staticmethod
    def of(forms: list[str] = (), stems: list[str] = ()) -> Words:
        forms, stems = [folded(f) for f in forms], [folded(s) for s in stems]
        if not all(forms) or not all(stems):
            raise BadVocabulary("a pattern without a word")
        return Words(frozenset(forms), tuple(stems))

    def __contains__(self, word: str) -> bool:
        return word in self.forms or word.startswith(self.stems) if self.stems else word in self.forms

    def column(self, word: Column | str) -> Column:
        return T.matches_any(word, sorted(self.forms), list(self.stems))


@dataclass(frozen=True)
class Lexicon:
    kinds: dict[str, Words]
    cleared: Words
    phrases: tuple[tuple[str, ...], ...] = ()
    negated_by: Words = Words()
    negated_after: Words = Words()
    intercepted: Words = Words()
    intercepted_negated_by: Words = Words()
    cues: dict[str, Words] = field(default_factory=dict)
    conjunctions: Words = Words()
    fillers: Words = Words()
    leads: Words = Words()
    marks: Words = Words()

    def kind(self, word: str, source: str = "") -> str | None:
        return next((k for k, words in self.kinds.items() if word in words), None) or SOURCE_WORDS.get((source, word))

    def cue(self, word: str) -> str | None:
        """The strongest role: target, then via, then origin."""
        return next((role for role in ("target", "via", "origin") if word in self.cues[role]), None)


_LIST = {"stems", "forms", "phrases", "negated_by", "negated_after", "note"}


def parse_lexicon(document: str) -> Lexicon:
    try:
        doc = json.loads(document)
    except ValueError as e:
        raise BadVocabulary("lexicon: not JSON") from e
    _checked(doc, {"intercepted"}, {"version", "kinds", "cleared", "cues", "conjunctions", "fillers", "continuation"}, "lexicon")
    if doc["version"] != "lexicon.v1":
        raise BadVocabulary("lexicon: unsupported version")
    _checked(doc["kinds"], set(), set(READER_KINDS), "kinds")
    for name, words in [*doc["kinds"].items(), ("cleared", doc["cleared"]), ("intercepted", doc.get("intercepted") or {})]:
        _checked(words, _LIST, set(), name)
    _checked(doc["cues"], set(), {"target", "via", "origin"}, "cues")
    _checked(doc["continuation"], {"note"}, {"leads", "marks"}, "continuation")
    both = lambda w: Words.of(w.get("forms", []), w.get("stems", []))
    clear, hit = doc["cleared"], doc.get("intercepted") or {}
    phrases = tuple(tuple(map(folded, p.split())) for p in clear.get("phrases", []))
    if not all(phrases):
        raise BadVocabulary("a pattern without a word")
    return Lexicon(
        kinds={k: both(doc["kinds"][k]) for k in READER_KINDS}, cleared=both(clear), phrases=phrases, negated_by=Words.of(clear.get("negated_by", [])), negated_after=Words.of(clear.get("negated_after", [])),
        intercepted=both(hit), intercepted_negated_by=Words.of(hit.get("negated_by", [])), cues={k: Words.of(v) for k, v in doc["cues"].items()}, conjunctions=Words.of(doc["conjunctions"]),
        fillers=Words.of(doc["fillers"]), leads=Words.of(doc["continuation"]["leads"]), marks=Words.of([], doc["continuation"]["marks"]),
    )


@dataclass(frozen=True)
class RolePlace:
    id: str
    name: str
    lat: float
    lon: float
    reach_km: int
    within: str | None
    patterns: tuple[tuple[tuple[str, bool], ...], ...]  # words of (text, exact)
    vetoed: frozenset[str]
    max_suffix: int
    capitalized: bool


class RoleGazetteer:
    """Places by the first letter of their patterns' first words, in file order."""

    def __init__(self, places: list[RolePlace]):
        self.places = places
        self.index: dict[str, list[tuple[int, int]]] = {}
        for n, place in enumerate(places):
            for p, pattern in enumerate(place.patterns):
                self.index.setdefault(pattern[0][0][0], []).append((n, p))


def parse_role_gazetteer(document: str) -> RoleGazetteer:
    try:
        doc = json.loads(document)
    except ValueError as e:
        raise BadVocabulary("gazetteer: not JSON") from e
    _checked(doc, set(), {"version", "attribution", "places"}, "gazetteer")
    if doc["version"] != "gazetteer.v1":
        raise BadVocabulary("gazetteer: unsupported version")
    places = []
    for p in doc["places"]:
        _checked(p, {"within"}, {"id", "name", "lat", "lon", "reach_km", "match"}, "place")
        m = _checked(p["match"], {"stems", "forms", "not", "max_suffix", "capitalized"}, set(), "match")
        patterns = tuple(tuple((folded(w), exact) for w in spelled.split()) for spelled, exact in [*((s, False) for s in m.get("stems", [])), *((f, True) for f in m.get("forms", []))])
        if any(not pattern or not all(w for w, _ in pattern) for pattern in patterns):
            raise BadVocabulary("a pattern without a word")
        places.append(RolePlace(p["id"], p["name"], p["lat"], p["lon"], p["reach_km"], p.get("within"), patterns, frozenset(map(folded, m.get("not", []))), m.get("max_suffix", 2), m.get("capitalized", False)))
    return RoleGazetteer(places)


#: Places of the point reader rank by feature code; all other codes are 0 (fixed values).
FEATURE_RANK = {"PPLC": 3, "PPLA": 2, "PPLA2": 1}
POINT_COLUMNS = "id string, name string, lat double, lon double, feature_code string, population long, aliases string"


def read_point_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Seven tab-separated fields; comments, and carriage returns at line ends, are allowed. ``bad`` says what is wrong with a row."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line")).filter("line <> '' and not startswith(line, '#')")
    parts = F.split("line", "\t", -1)
    at = lambda i: F.get(parts, F.lit(i))
    rows = lines.select(
        at(0).alias("id"), at(1).alias("name"), at(2).try_cast("double").alias("lat"), at(3).try_cast("double").alias("lon"), at(4).alias("feature_code"),
        F.when(at(5) == "", F.lit(0)).otherwise(at(5).try_cast("long")).cast("long").alias("population"), at(6).alias("aliases"), F.size(parts).alias("fields"),
    )
    bad = (
        F.when(F.col("fields") != 7, "expected 7 tab-separated fields").when((F.col("id") == "") | (F.col("name") == ""), "empty id or name").when(F.col("lat").isNull(), "bad latitude")
        .when(F.col("lon").isNull(), "bad longitude").when((F.abs("lat") > 90) | (F.abs("lon") > 180), "coordinate out of range").when(F.col("population").isNull() | (F.col("population") < 0), "bad population")
    )
    return rows.withColumn("bad", bad).drop("fields")


def feature_rank(code: Column | str) -> Column:
    code = F.col(code) if isinstance(code, str) else code
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in FEATURE_RANK.items() for x in pair]), code), F.lit(0))


def point_names(places: DataFrame) -> DataFrame:
    """``key, words, id, name, lat, lon, rank, population``: a row for each distinct key of a name of one to three words."""
    names = F.concat(F.array("name"), F.transform(F.split(F.coalesce("aliases", F.lit("")), ","), F.trim))
    exploded = places.withColumn("spelled", F.explode(names)).withColumn("words", T.point_tokens("spelled")["norm"])
    named = exploded.filter(F.size("words").between(1, 3))
    return named.select(T.name_key(F.col("words")).alias("key"), F.size("words").alias("n_words"), "id", "name", "lat", "lon", feature_rank("feature_code").alias("rank"), "population").distinct()


def resolved_names(names: DataFrame, dominance: int = 10) -> DataFrame:
    """Per key the place it stands for, or null and ``ambiguous``: by rank, then population, then id.

    The first wins if its rank is higher, or it has ``dominance`` times the population of the next.
    """
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("r"), (-F.col("population")).alias("p"), "id", "name", "lat", "lon", "rank", "population"))), 1, 2)
    ranked = names.groupBy("key", "n_words").agg(best.alias("best")).withColumn("a", F.element_at("best", 1)).withColumn("b", F.get("best", F.lit(1)))
    clear = F.col("b").isNull() | (F.col("a.rank") > F.col("b.rank")) | ((F.col("a.population") > 0) & (F.col("a.population") >= dominance * F.col("b.population")))
    return ranked.select("key", "n_words", F.when(clear, F.struct("a.id", "a.name", "a.lat", "a.lon")).alias("place"), (~clear).alias("ambiguous"))


#: Feature codes of places that are not lived in, and codes of seats (fixed values).
NOT_POPULATED = ("PPLX", "PPLH", "PPLQ", "PPLW")
SEATS = ("PPLC", "PPLA", "PPLA2", "PPLA3", "PPLA4")
DUMP = ("id", "name", "asciiname", "alternates", "lat", "lon", "class", "code", "country", "cc2", "admin1", "admin2", "admin3", "admin4", "population", "elevation", "dem", "timezone", "modified")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines (``value``) of a text file, or of the text in a ZIP archive, which one task unpacks."""
    if not path.endswith(".zip"):
        return spark.read.text(path)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    member = next(n for n in archive.namelist() if n.endswith(".txt") and "readme" not in n.lower())
                    with archive.open(member) as f:
                        text = io.TextIOWrapper(f, encoding="utf-8", newline="\n")
                        while lines := list(islice(text, 10_000)):
                            yield pa.RecordBatch.from_pydict({"value": [line.rstrip("\n") for line in lines]})

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpacked, "value string")


def dump_rows(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of a place dump (tab-separated, 19 columns or more, no quoting) from ``value``, and ``problems`` (value, problem) of lines with fewer."""
    parts = F.split(F.regexp_replace("value", "\r$", ""), "\t", -1)
    long_enough = F.size(parts) >= len(DUMP)
    rows = lines.filter(long_enough).select(*(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(DUMP)))
    typed = rows.withColumns({"lat": F.col("lat").try_cast("double"), "lon": F.col("lon").try_cast("double"), "population": F.coalesce(F.col("population").try_cast("long"), F.lit(0).cast("long"))})
    return typed, lines.filter(~long_enough & (F.col("value") != "")).select("value", F.concat(F.lit("expected 19 tab-separated fields, found "), F.size(parts).cast("string")).alias("problem"))


def read_dump(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``dump_rows`` of a text file or a ZIP archive."""
    return dump_rows(_lines(spark, path))


def wanted_place() -> Column:
    return (F.col("class") == "P") & ~F.col("code").isin(*NOT_POPULATED) & ((F.col("population") >= 1000) | F.col("code").isin(*SEATS))


def build_point_gazetteer(dump: DataFrame) -> DataFrame:
    """Rows of the point gazetteer, sorted by id: populated places of 1000 or more, and seats.

    Aliases are Cyrillic spellings, or the plain one, without stress marks.
    """
    alternates = F.filter(F.split(T.strip_stress(F.coalesce("alternates", F.lit(""))), ","), lambda a: (a != "") & (a.rlike(r"[Ѐ-ӿ]") | (a == F.col("asciiname"))) & ~a.rlike(r"[\t,\n]"))
    aliases = F.array_sort(F.array_distinct(F.filter(F.concat(alternates, F.array(F.coalesce("asciiname", F.lit("")))), lambda a: (a != F.col("name")) & (a != ""))))
    rows = dump.filter(wanted_place()).select(F.concat(F.lit("geonames:"), "id").alias("id"), "name", "lat", "lon", F.col("code").alias("feature_code"), "population", F.array_join(aliases, ",").alias("aliases"))
    return rows.orderBy("id")


def reach_km(population: Column | str, given: Column | None = None) -> Column:
    p = F.col(population) if isinstance(population, str) else population
    steps = F.when(p >= 200000, 20).when(p >= 50000, 12).when(p >= 10000, 8).otherwise(5)
    return steps if given is None else F.coalesce(given, steps)


def build_role_gazetteer(spec: DataFrame, dump: DataFrame, regions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Places of a curated list (``geonames_id`` or ``region``, name, reach_km, within) with coordinates, and ``problems`` (id, problem).

    The list is the small side and the planner broadcasts it if it is. A listed
    place must be a populated place of the dump, a region one of ``regions`` (id,
    lat, lon, reach_km); each once, and what a place lies within must be listed too.
    """
    places = dump.filter("class = 'P' and country = 'UA'").select(F.col("id").alias("d_id"), "lat", "lon", "population")
    joined = spec.filter("region is null").join(places, F.col("geonames_id").cast("string") == F.col("d_id"), "left")
    name = lambda c: F.concat(F.lit("geonames:"), F.col(c).cast("string"))
    rows = joined.filter("d_id is not null").select(name("d_id").alias("id"), "name", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), reach_km("population", F.col("reach_km")).alias("reach_km"), name("within").alias("within"))
    unmatched = joined.filter("d_id is null").select(name("geonames_id").alias("id"), F.lit("not a populated place of the dump").alias("problem"))
    known = regions if regions is not None else spec.sparkSession.createDataFrame([], "id string, lat double, lon double, reach_km int")
    coded = spec.filter("region is not null").select(F.concat(F.lit(REGION_PREFIX), "region").alias("id"), "name").join(known.select(F.col("id").alias("r_id"), "lat", "lon", "reach_km"), F.col("id") == F.col("r_id"), "left")
    rows = rows.unionByName(coded.filter("r_id is not null").select("id", "name", "lat", "lon", F.col("reach_km").cast("int").alias("reach_km"), F.lit(None).cast("string").alias("within")))
    unknown = coded.filter("r_id is null").select("id", F.lit("not a region that is listed").alias("problem"))
    twice = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", F.lit("listed more than once").alias("problem"))
    outside = rows.filter("within is not null").join(rows.select(F.col("id").alias("o_id")).distinct(), F.col("within") == F.col("o_id"), "left_anti").select("id", F.lit("lies within a place that is not listed").alias("problem"))
    return rows, unmatched.unionByName(unknown).unionByName(twice).unionByName(outside)
