"""Point reader: lines of posts to observations at named places.

Each line is cut into clauses. Words give hazards, all-clears and jet marks by
clause; names give places by their keys, longest first; each place belongs to
the nearest clause before it that names a hazard, or else to the first one.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ADJECTIVE_ENDINGS, NOUN_ENDINGS, keyed, normalized
from ..params import POINT_TTL_MIN
from ..schemas import GEOMETRY, OBSERVATION_PROVENANCE
from .runs import map_rows

NORMALIZER = "points.v1"
# Fixed values of the reader, down to the look-back: kind words in the order in which they are tried (kind, endings,
# stems), what is matched whole or by its beginning, administrative areas, units.
KIND_WORDS = (
    ("air.ballistic_missile", NOUN_ENDINGS, ("баллист", "баллистик", "баліст", "балістик", "искандер", "іскандер", "кинжал", "кинджал")),
    ("air.ballistic_missile", ADJECTIVE_ENDINGS, ("баллистическ", "балістичн")),
    ("air.missile", NOUN_ENDINGS, ("ракет", "калибр", "калібр", "циркон", "оникс", "онікс", "х-101", "х-22", "х-59", "х-69")),
    ("air.missile", ADJECTIVE_ENDINGS, ("крылат", "крилат")),
    ("air.attack_drone", NOUN_ENDINGS, ("шахед", "шахід", "мопед", "бандерол", "бпла", "дрон", "герань", "герані")),
)
GUIDED_BOMBS = ("каб", "каба", "кабы", "кабов", "каби", "кабів", "умпб", "умпк", "фаб", "фабы", "фаби")
GUIDED_BOMB_PREFIX = "умпб"
JET_PREFIX = "реактивн"
CLEAR_PREFIXES = ("минус", "мінус", "отбой", "відбій", "сбит", "збит", "уничтож", "знищ")
AREA_STEMS, AREA_WORD = ("район", "област", "громад"), "обл"
UNIT_STEMS = ("минут", "хвилин", "секунд", "час", "годин", "километр", "кілометр", "метр")
UNIT_WORDS = ("км", "м", "мин", "хв", "сек", "с", "ч", "год")
LOOKBACK, MAX_NAME = 2, 3

_EXACT: dict[str, str] = {}
for _kind, _endings, _stems in reversed(KIND_WORDS):
    _EXACT |= {s + e: _kind for s in _stems for e in _endings}
_HYPHENED = [(s + "-", kind) for kind, _, stems in KIND_WORDS for s in stems]
_AREAS = {s + e for s in AREA_STEMS for e in NOUN_ENDINGS} | {AREA_WORD}
_PARTS = re.compile("[\\w\u0300\u0301'’ʼ`-]+|[.,;:!?—–]")


def words_of(line: str) -> list[tuple[str, str, int]]:
    """(raw, normalized, clause) of a line."""
    out, clause = [], 0
    for part in _PARTS.findall(line.replace("_", " ")):
        raw = part.strip("-'’ʼ`")
        if raw and part not in ".,;:!?—–":
            out.append((raw, normalized(raw), clause))
        elif part in ".,;:!?—–" or not part.strip("-"):
            clause += 1
    return out


def kind_of(word: str) -> str | None:
    if word in GUIDED_BOMBS or word.startswith(GUIDED_BOMB_PREFIX):
        return "air.guided_bomb"
    return _EXACT.get(word) or next((kind for stem, kind in _HYPHENED if word.startswith(stem)), None)


def is_area(word: str) -> bool:
    return word in _AREAS or word.startswith(tuple(s + "-" for s in AREA_STEMS))


def _number(word: str) -> int | None:
    return int(word) if re.fullmatch(r"\+?[0-9]{1,9}", word) and 1 <= int(word) <= 1000 else None


def _is_unit(word: str) -> bool:
    return word in UNIT_WORDS or word.startswith(UNIT_STEMS)


def count_before(words: list[tuple[str, str, int]], at: int) -> int | None:
    """The nearest number of the two words before in this clause that no unit follows."""
    for i in range(at - 1, max(-1, at - 1 - LOOKBACK), -1):
        if words[i][2] == words[at][2] and not _is_unit(words[i + 1][1]) and (n := _number(words[i][1])) is not None:
            return n
    return None


def cleared_clauses(words: list[tuple[str, str, int]]) -> set[int]:
    """Clauses an all-clear speaks of: its own if that names a hazard, else the one before if that does."""
    named = {c for _, w, c in words if kind_of(w)}
    marks = {c for _, w, c in words if w.startswith(CLEAR_PREFIXES)}
    return {c if c in named else c - 1 for c in marks if c in named or c - 1 in named}


def mentions_of(words: list[tuple[str, str, int]]) -> list[dict]:
    cleared, jets = cleared_clauses(words), {c for _, w, c in words if w.startswith(JET_PREFIX)}
    found: dict[tuple, dict] = {}
    for i, (raw, word, clause) in enumerate(words):
        kind = kind_of(word)
        if kind:
            kind = "air.jet_drone" if kind == "air.attack_drone" and clause in jets else kind
            stance = "clear" if clause in cleared else "threat"
            m = found.setdefault((kind, stance, clause), {"kind": kind, "stance": stance, "clause": clause, "count": None, "words": []})
            m["words"].append(raw)
            m["count"] = m["count"] if m["count"] is not None else count_before(words, i)
    return list(found.values())


def places_of(words: list[tuple[str, str, int]], names: dict[tuple[str, ...], dict]) -> tuple[list[dict], list[str]]:
    """Places by clause, once each, and names that stand for several places."""
    found: dict[tuple, dict] = {}
    ambiguous: list[str] = []
    at = 0
    while at < len(words):
        clause = words[at][2]
        longest = next((n for n in range(1, MAX_NAME + 1) if at + n >= len(words) or words[at + n][2] != clause), MAX_NAME)
        hit = None
        if words[at][0][0].isupper():
            hit = next(((names[k], n) for n in range(longest, 0, -1) if (k := keyed([w for _, w, _ in words[at : at + n]])) in names), None)
        if hit is None:
            at += 1
            continue
        place, n = hit
        after = at + n
        if not (after < len(words) and words[after][2] == clause and is_area(words[after][1])):
            if place["place"] is None:
                ambiguous.append(" ".join(w for w, _, _ in words[at:after]))
            else:
                found.setdefault((clause, place["place"]["id"]), place["place"] | {"clause": clause})
        at = after
    return list(found.values()), ambiguous


def absorbed(mentions: list[dict], place_clauses: set[int]) -> list[dict]:
    """Without generic missiles that only say again what a ballistic one of the same stance says."""
    ballistic = {(m["stance"], m["clause"]) for m in mentions if m["kind"] == "air.ballistic_missile"}
    stances = {s for s, _ in ballistic}
    says_again = lambda m: (m["stance"], m["clause"]) in ballistic or m["clause"] not in place_clauses and m["stance"] in stances
    return [m for m in mentions if m["kind"] != "air.missile" or not says_again(m)]


def read_line(line: str, names: dict[tuple[str, ...], dict]) -> tuple[list[dict], list[tuple[str, str]]]:
    """(mention, place) pairs of a line, and (code, detail) of what could not be placed."""
    words = words_of(line)
    mentions = mentions_of(words)
    if not mentions:
        return [], []
    places, ambiguous = places_of(words, names)
    mentions = absorbed(mentions, {p["clause"] for p in places})
    owners = sorted({m["clause"] for m in mentions})
    pairs = [m | {"place": p} for m in mentions for p in places if owners[max(0, bisect_right(owners, p["clause"]) - 1)] == m["clause"]]
    problems = [("ambiguous", name) for name in ambiguous]
    if mentions and not pairs:
        problems.append(("unlocated", ",".join(dict.fromkeys(m["kind"] for m in mentions))))
    return pairs, problems


def of_lines(evidence: DataFrame, function: Callable[[list[tuple[str, str, int]]], list[dict]], schema: str) -> DataFrame:
    """``evidence_id, line`` and what ``function`` makes of each line's words, for posts that weren't forwarded."""

    def one(row: dict) -> Iterator[dict]:
        for number, line in enumerate(re.split("\r?\n", row["text"] or ""), 1):
            for found in function(words_of(line)):
                yield {"evidence_id": row["external_id"], "line": number} | found

    return map_rows(evidence.filter("forwarded_from is null").select("external_id", "text"), one, f"evidence_id string, line int, {schema}")


READ = f"source_id string, kind string, stance string, count int, observed_at timestamp, geometry {GEOMETRY}, ttl int, confidence string, provenance {OBSERVATION_PROVENANCE}, line int, code string, detail string"


def observe(evidence: DataFrame, names: dict[tuple[str, ...], dict]) -> tuple[DataFrame, DataFrame]:
    """Observations, and ``skipped`` (evidence_id, line, code, detail).

    ``names`` maps keys to ``{"place": {...} or None}``: what ``resolved_names`` gives, collected by the caller as a vocabulary.
    """

    def one(row: dict) -> Iterator[dict]:
        blank = {"source_id": row["source_id"], "observed_at": row["published_at"]}
        post = {"evidence_id": row["external_id"], "evidence_url": row["url"], "normalizer": NORMALIZER}
        for number, line in enumerate(re.split("\r?\n", row["text"] or ""), 1):
            pairs, problems = read_line(line, names)
            for p in pairs:
                place = p["place"]
                yield blank | {
                    "kind": p["kind"], "stance": p["stance"], "count": p["count"], "geometry": {"type": "point", "coordinates": [place["lon"], place["lat"]]}, "ttl": 60 * POINT_TTL_MIN["clear" if p["stance"] == "clear" else p["kind"]],
                    "provenance": post | {"matched": p["words"], "place_id": place["id"], "place_name": place["name"]}, "line": number,
                }
            for code, detail in problems:
                yield blank | {"provenance": post, "line": number, "code": code, "detail": detail}

    posts = evidence.filter("forwarded_from is null").select("source_id", "external_id", "published_at", F.col("provenance.url").alias("url"), "text")
    rows = map_rows(posts, one, READ)
    forwarded = evidence.filter("forwarded_from is not null").select(F.col("external_id").alias("evidence_id"), F.lit(0).alias("line"), F.lit("forwarded").alias("code"), F.lit(None).cast("string").alias("detail"))
    problems = rows.filter("code is not null").select(F.col("provenance.evidence_id").alias("evidence_id"), "line", "code", "detail")
    return rows.filter("code is null").drop("line", "code", "detail"), forwarded.unionByName(problems)

