"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors (at-signs, plus signs, URL schemes,
digits and identifier cues). Deterministic parsers then expand each anchor in its
neighbourhood and validate what they found: addresses of hosts and card numbers
from the first digit of a run on, which no anchor within it opens again. Every
parser takes time in proportion to the text.

Base kinds are email, ip, card and phone; added kinds are ``login`` (user part
of a URL), ``iban`` (checksum of 97), ``ssn`` and ``account`` (digits after a cue).

Defined cases: a null text is empty; repeated rows and repeated ids are
searched row by row; an empty table gives an empty result; columns beside the
id and the text are ignored. Offsets count code points; ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import batch_of, rows_of, small_batches

Span = tuple[int, int, str]

#: Base kinds first, in the order that ties in ``start`` take.
KINDS = ("email", "ip", "card", "phone", "login", "iban", "ssn", "account")
#: Anchors of the automaton (matched in lower case) and the parser each one calls.
ANCHORS = {"@": "email", "+": "phone", "://": "login", "iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "account", "acct": "account", "konto": "account", "compte": "account", "cuenta": "account"} | dict.fromkeys("0123456789", "digits")

DIGITS = frozenset("0123456789")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]++")
LOGIN = re.compile(r"[^\s/:@]++:[^\s/@]++(?=@)")
IBAN = re.compile(r"[\s:#.no]{0,8}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
SSN = re.compile(r"[\s:#.no]{0,8}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
ACCOUNT = re.compile(r"(?:[\s:#.=]|number|nummer|num|no){0,8}([0-9](?:[ -]?[0-9]){7,16})(?![ -]?[0-9]|[A-Za-z])", re.IGNORECASE)
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in ANCHORS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def card_valid(text: str) -> bool:
    digits = text.replace(" ", "").replace("-", "")
    return 14 <= len(digits) <= 19 and luhn(digits)


def iban_valid(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _email(text: str, at: int, after: int) -> tuple[int, int] | None:
    """Around the at-sign: as much local part as there is from ``after`` on, and the longest domain."""
    start = at
    while start > after and text[start - 1] in LOCAL:
        start -= 1
    host = DOMAIN.match(text, at + 1) if start < at else None
    return (start, host.end()) if host else None


def _phone(text: str, at: int) -> tuple[int, int] | None:
    """From the plus sign to the last digit of its run, with a character between at least."""
    run = PHONE.match(text, at)
    if not run:
        return None
    end = len(run[0].rstrip(" ().-")) + at
    return (at, end) if end - at >= 4 and 10 <= sum(c.isdigit() for c in text[at:end]) <= 15 else None


def find_personal(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans as (start, end, kind), in order of start, then kind."""
    base: list[Span] = []
    more: list[Span] = []
    # lower case for the cues only; where it changes the length, of A-Z alone
    low = text.lower()
    low = low if len(low) == len(text) else text.translate(_LOWER)
    mailed = addressed = carded = 0
    for last, (size, kind) in _automaton().iter(low):
        first, end = last - size + 1, last + 1
        if kind == "digits":
            # a start inside a run of digits can't match where the run's own start doesn't
            if first >= addressed and not (first and text[first - 1] in DIGITS) and (m := IP.match(text, first)):
                addressed = m.end()
                if _small(m[0]):
                    base.append((*m.span(), "ip"))
            if first >= carded and (m := CARD.match(text, first)):
                carded = m.end()
                if card_valid(m[0]):
                    base.append((*m.span(), "card"))
        elif kind == "email":
            if span := _email(text, first, mailed):
                base.append((*span, kind))
                mailed = span[1]
        elif kind == "phone":
            if span := _phone(text, first):
                base.append((*span, kind))
        elif kind == "login":
            if m := LOGIN.match(text, end):
                more.append((*m.span(), kind))
        elif kind == "iban":
            if (m := IBAN.match(text, end)) and (fit := _longest_iban(m[1])):
                more.append((m.start(1), m.start(1) + fit, kind))
        elif m := (SSN if kind == "ssn" else ACCOUNT).match(text, end):
            more.append((*m.span(1), kind))
    order = lambda s: (s[0], KINDS.index(s[2]))
    return sorted(base, key=order), sorted({*base, *more}, key=order)


def _small(address: str) -> bool:
    """Whether each part is at most 255, leading zeros aside."""
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in address.split("."))


def _longest_iban(text: str) -> int:
    """Length of the longest prefix that is a valid number, 0 if there is none."""
    return next((n for n in range(len(text), 14, -1) if text[n - 1] != " " and iban_valid(text[:n])), 0)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


_ARROW = pa.schema([("doc_id", pa.int64()), ("n_email", pa.int64()), ("n_ip", pa.int64()), ("n_card", pa.int64()), ("n_phone", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])
FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in rows_of(batches, "doc_id", "text"):
        rows = []
        for doc_id, text in zip(ids, texts, strict=True):
            base, every = find_personal(text or "")
            kinds = [k for _, _, k in base]
            rows.append((doc_id, *(kinds.count(k) for k in KINDS[:4]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
        yield batch_of(rows, _ARROW)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts of the base kinds, their digest and all spans. One pass, no shuffle."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_search, FOUND)
