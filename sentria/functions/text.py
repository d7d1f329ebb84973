"""Text scalars as Spark columns, with plain Python twins for folds over one post.

Everything here is a built-in expression but ``strip_stress``, which needs
Unicode decomposition. Letter tables and patterns are fixed values of the
vocabularies these functions serve.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

APOSTROPHES = "'’ʼ`"
# translate(): what has no partner in the second string is dropped
FOLD_FROM, FOLD_TO = "ёєіїыґ" + APOSTROPHES + "ъ", "ееиииг"
NORM_FROM, NORM_TO = "ё" + APOSTROPHES + "\u0300\u0301", "е"
VOWELS = "аеёиоуыэюяіїє"
#: Endings in the order in which they are tried.
ENDINGS = (
    "ами", "ями", "ого", "его", "ому", "ему", "ой", "ей", "ою", "ею", "ом", "ем", "ах", "ях", "ая",
    "яя", "ое", "ее", "ые", "ие", "ий", "ый", "а", "я", "о", "е", "у", "ю", "ы", "и", "і", "ь",
    "й",
)
NOUN_ENDINGS = (
    "", "а", "я", "у", "ю", "е", "є", "и", "ы", "і", "ь", "ом", "ем", "ой", "ей", "ою", "ею", "ью",
    "ов", "ев", "ів", "ам", "ям", "ах", "ях", "ами", "ями",
)
ADJECTIVE_ENDINGS = (
    "ая", "яя", "ое", "ее", "ые", "ие", "ый", "ий", "ій", "ой", "ую", "юю", "ого", "его", "ому",
    "ему", "ым", "им", "ыми", "ими", "ых", "их", "ої", "ою", "у", "а", "е", "і",
)
#: Words for numbers and for units of the role reader.
NUMBER_WORDS = {
    "один": 1, "одна": 1, "одно": 1, "два": 2, "две": 2, "дви": 2, "три": 3, "четыре": 4, "чотири": 4, "пять": 5,
    "шесть": 6, "шисть": 6, "десяток": 10,
}
UNITS = frozenset(("минут", "минуты", "мин", "хвилин", "хвилини", "хв", "секунд", "сек", "км", "часа", "годин", "годину"))

#: A word of the role reader, already trimmed, or a break, or a comma.
ROLE_WORD = r"[\p{L}\p{N}](?:[\p{L}\p{N}'’ʼ-]*[\p{L}\p{N}])?"
ROLE_BREAK = r"[\n.!?;…]"
ROLE_PARTS = ROLE_WORD + "|" + ROLE_BREAK + "|,"
#: A word of the point reader with its stress marks, or a clause end, or a free-standing dash.
POINT_WORD = "[\\p{L}\\p{N}\u0300\u0301](?:[\\p{L}\\p{N}\u0300\u0301'’ʼ`-]*[\\p{L}\\p{N}\u0300\u0301])?"
POINT_PARTS = POINT_WORD + r"|[.,;:!?—–]|-+"


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def fold(text: Column | str) -> Column:
    """Lower case without the differences between the two spellings, apostrophes and hard signs."""
    return F.translate(F.lower(_column(text)), FOLD_FROM, FOLD_TO)


def normalize_word(text: Column | str) -> Column:
    """Lower case without apostrophes and stress marks."""
    return F.translate(F.lower(_column(text)), NORM_FROM, NORM_TO)


def role_parts(text: Column | str) -> Column:
    """Words, breaks and commas in order."""
    return F.regexp_extract_all(_column(text), F.lit(ROLE_PARTS), F.lit(0))


def is_word(part: Column | str) -> Column:
    return _column(part).rlike(r"^[\p{L}\p{N}\x{300}\x{301}]")


def role_tokens(text: Column | str) -> Column:
    """Array of ``original, folded, barrier_before, comma_before`` in order, by one fold over the parts."""
    empty = F.array().cast("array<struct<original:string,folded:string,barrier_before:boolean,comma_before:boolean>>")
    start = F.struct(empty.alias("out"), F.lit(True).alias("barrier"), F.lit(False).alias("comma"))

    def step(state: Column, part: Column) -> Column:
        token = F.struct(part.alias("original"), fold(part).alias("folded"), state["barrier"].alias("barrier_before"), (state["comma"] & ~state["barrier"]).alias("comma_before"))
        word = F.struct(F.concat(state["out"], F.array(token)).alias("out"), F.lit(False).alias("barrier"), F.lit(False).alias("comma"))
        other = F.struct(state["out"].alias("out"), (state["barrier"] | (part != ",")).alias("barrier"), (state["comma"] | (part == ",")).alias("comma"))
        return F.when(is_word(part), word).otherwise(other)

    return F.aggregate(role_parts(text), start, step, lambda s: s["out"])


def lines(text: Column | str) -> Column:
    """Lines without their ends; a final line end opens no line."""
    parts = F.split(_column(text), "\r?\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def point_tokens(line: Column | str) -> Column:
    """Array of ``raw, norm, clause`` of one line."""
    parts = F.regexp_extract_all(_column(line), F.lit(POINT_PARTS), F.lit(0))
    start = F.struct(F.array().cast("array<struct<raw:string,norm:string,clause:int>>").alias("out"), F.lit(0).alias("clause"))

    def step(state: Column, part: Column) -> Column:
        token = F.struct(part.alias("raw"), normalize_word(part).alias("norm"), state["clause"].alias("clause"))
        word = F.struct(F.concat(state["out"], F.array(token)).alias("out"), state["clause"].alias("clause"))
        return F.when(is_word(part), word).otherwise(F.struct(state["out"].alias("out"), (state["clause"] + 1).alias("clause")))

    return F.aggregate(parts, start, step, lambda s: s["out"])


def is_capitalized(word: Column | str) -> Column:
    return _column(word).rlike(r"^\p{Lu}")


def matches_pattern(word: Column | str, pattern: Column | str, exact: Column | bool, max_suffix: Column | int) -> Column:
    """Equal to the pattern, or a stem of it with at most ``max_suffix`` more letters."""
    w, p = _column(word), _column(pattern)
    exact = F.lit(exact) if isinstance(exact, bool) else exact
    return F.when(exact, w == p).otherwise(w.startswith(p) & (F.length(w) - F.length(p) <= max_suffix))


def matches_any(word: Column | str, forms: list[str], stems: list[str]) -> Column:
    """A form, or any word that begins with a stem."""
    w = _column(word)
    return reduce(lambda a, s: a | w.startswith(s), stems, w.isin(forms))


def is_form_of(word: Column | str, stems: list[str], endings: tuple[str, ...] = NOUN_ENDINGS) -> Column:
    """A stem with one of the endings, or with a hyphen and anything. Equality with the finite set of forms."""
    w = _column(word)
    return reduce(lambda a, s: a | w.startswith(s + "-"), stems, w.isin([s + e for s in stems for e in endings]))


def stem(word: Column | str, min_len: int) -> Column:
    """Without the first listed ending that leaves ``min_len`` letters."""
    w = _column(word)
    cut = [F.when(w.endswith(e) & (F.length(w) - len(e) >= min_len), F.left(w, F.length(w) - len(e))) for e in ENDINGS]
    return F.coalesce(*cut, w)


def skeleton(word: Column | str) -> Column:
    return F.translate(_column(word), VOWELS, "")


def name_key(words: Column, min_len: int = 3) -> Column:
    """Key of a name: the stem of its first word, the skeletons of the other stems."""
    return F.array_join(F.transform(words, lambda w, i: F.when(i == 0, stem(w, min_len)).otherwise(skeleton(stem(w, min_len)))), " ")


def number(norm: Column | str) -> Column:
    """1 to 1000 if the word is such a number, else null."""
    n = F.when(_column(norm).rlike(r"^\+?[0-9]+$"), _column(norm).try_cast("int"))
    return F.when(n.between(1, 1000), n)


def number_word(folded: Column | str) -> Column:
    """Digits or a word for a number, else null."""
    w = _column(folded)
    words = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    return F.coalesce(F.when(w.rlike("^[0-9]+$"), w.try_cast("int")), F.get(F.array(F.element_at(words, w)), F.lit(0)))


def collapse_whitespace(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_column(text), r"\s+", " "))


@F.pandas_udf(StringType())
def strip_stress(text):  # noqa: ANN001, ANN201
    """NFC without combining stress marks; the only scalar without a built-in."""
    plain = lambda t: unicodedata.normalize("NFC", unicodedata.normalize("NFD", t).replace("\u0300", "").replace("\u0301", ""))
    return text.map(plain, na_action="ignore")


# Twins for folds over the words of one post
_FOLD = {ord(c): (FOLD_TO[i] if i < len(FOLD_TO) else None) for i, c in enumerate(FOLD_FROM)}
_NORM = {ord(c): (NORM_TO[i] if i < len(NORM_TO) else None) for i, c in enumerate(NORM_FROM)}


def folded(text: str) -> str:
    return text.lower().translate(_FOLD)


def normalized(text: str) -> str:
    return text.lower().translate(_NORM)


def stemmed(word: str, min_len: int = 3) -> str:
    return next((word[: -len(e)] for e in ENDINGS if word.endswith(e) and len(word) - len(e) >= min_len), word)


def keyed(words: list[str]) -> tuple[str, ...]:
    """``name_key`` of normalized words."""
    bases = [stemmed(w) for w in words]
    return (bases[0], *("".join(c for c in b if c not in VOWELS) for b in bases[1:]))
