"""Benchmark decontamination with one Aho-Corasick automaton.

Test items are normalised (A-Z in lower case, words joined by single spaces). A
window is 13 consecutive words of an item; an item with fewer is one window.
The automaton holds each item cut into consecutive blocks of seven words, one of
which lies whole in every window (an item of fewer than 13 words is held whole),
so that it has about as many nodes as the benchmark has characters. A text is
normalised in the same way and scanned once. Where a block occurs, the windows of the
text around it are looked up among those of the items that have the block: the work is the same for one item
and for thousands that share a preamble. Hits are mapped back to words of the text and to offsets in the original.

The items go to the workers as a broadcast of at most ``MAX_CHARS`` characters, which
are counted first; each worker builds the automaton once (some 60 bytes a character, and
40 more for windows around blocks that have occurred: half a GB at most). A benchmark beyond that is dealt into parts by a hash of the item's id.
The texts are then scanned for one part after the other, with what was found written
between, and results are the same.

Defined cases: null and wordless texts have no words, are hit nowhere and are
not contaminated; wordless items match nothing; items that repeat an id count as
one item; items without an id are ignored; an empty benchmark leaves all clean; repeated rows each keep a row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import batch_of, beside, content, rows_of, small_batches, written

# Words of the original text: letters in either case.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WINDOW = 13
#: Most characters of items in one automaton.
MAX_CHARS = 4_000_000
# On UTF-8 bytes: lower case for A-Z, a space for what is no word character.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


#: Runs of words (first word, words) that windows occupy, and the items whose windows occur.
Hits = tuple[list[tuple[int, int]], set]


def normalised(text: str) -> bytes:
    """UTF-8 words in lower case with a space before, between and after them; empty if there are none."""
    words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
    return b" " + b" ".join(words) + b" " if words else b""


class Matcher:
    """The automaton of a benchmark, or of a part of it."""

    def __init__(self, items: list[tuple[object, str | None]], size: int = WINDOW):
        self.size = size
        step = (size + 1) // 2
        #: how many words of a window may come before the block in it
        self.before = size - step
        self.items: list[tuple[object, list[bytes]]] = []
        #: for each pattern of the automaton its words, the items that are this pattern, and the items and words in them where it begins
        self.n_words: list[int] = []
        self.whole: list[list[object]] = []
        self.owners: list[list[tuple[int, int]]] = []
        #: of patterns that have occurred: the windows of items around them, and the items that have each
        self.around: dict[int, dict[bytes, list[object]]] = {}
        numbers: dict[bytes, int] = {}
        for item_id, text in dict.fromkeys(items):
            words = normalised(text or "").split()
            short = len(words) < size
            for at in range(0, 1 if short else len(words) - step + 1, step) if words else ():
                own = words if short else words[at : at + step]
                number = numbers.setdefault(b" " + b" ".join(own) + b" ", len(numbers))
                if number == len(self.n_words):
                    self.n_words.append(len(own))
                    self.whole.append([])
                    self.owners.append([])
                if short:
                    self.whole[number].append(item_id)
                else:
                    self.owners[number].append((len(self.items), at))
            self.items.append((item_id, words))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.lengths = [len(block) for block in numbers]
        for block, number in numbers.items():
            self.automaton.add_word(block.decode("latin-1"), number)
        if numbers:
            self.automaton.make_automaton()

    def _windows(self, number: int) -> dict[bytes, list[object]]:
        """Items by each window that holds a block, gathered when the block first occurs."""
        if number not in self.around:
            found = self.around[number] = {}
            for item, at in self.owners[number]:
                item_id, own = self.items[item]
                for low in range(max(0, at - self.before), min(at, len(own) - self.size) + 1):
                    found.setdefault(b" ".join(own[low : low + self.size]), []).append(item_id)
        return self.around[number]

    def hits(self, folded: bytes) -> Hits:
        """Where windows occur, and the items that have them.

        An occurrence of a block is looked up in the seven windows around it,
        however many items share the block; a window's items are added once a text.
        """
        seen = list(self.automaton.iter(folded.decode("latin-1"))) if len(self.automaton) else []
        if not seen:
            return [], set()
        at = np.flatnonzero(np.frombuffer(folded, np.uint8) == 32)
        firsts = np.searchsorted(at, [end + 1 - self.lengths[number] for end, number in seen]).tolist()
        spaces = at.tolist()
        last = len(spaces) - 1 - self.size
        runs, met = [], {}
        for first, (_, number) in zip(firsts, seen, strict=True):
            if self.whole[number]:
                runs.append((first, self.n_words[number]))
                met[number, b""] = self.whole[number]
            windows = self._windows(number) if self.owners[number] else {}
            for low in range(max(0, first - self.before), min(first, last) + 1) if windows else ():
                window = folded[spaces[low] + 1 : spaces[low + self.size]]
                if window in windows:
                    runs.append((low, self.size))
                    met[number, window] = windows[window]
        return runs, set().union(*met.values())


def marked_words(n_words: int, runs: list[tuple[int, int]]) -> np.ndarray:
    """For each word whether any run (first word, words) covers it."""
    steps = np.zeros(n_words + 1, np.int64)
    np.add.at(steps, [first for first, _ in runs], 1)
    np.add.at(steps, [first + n for first, n in runs], -1)
    return np.cumsum(steps)[:-1] > 0


def original_spans(text: str, marked: np.ndarray) -> list[tuple[int, int]]:
    """Offsets in the original text of each run of marked words."""
    spans: list[list[int]] = []
    last = -2
    for i, m in enumerate(WORD.finditer(text)):
        if marked[i]:
            if i == last + 1:
                spans[-1][1] = m.end()
            else:
                spans.append([m.start(), m.end()])
            last = i
    return [(a, b) for a, b in spans]


_HELD: dict[object, Matcher] = {}


def _matcher(part) -> Matcher:
    """The automaton of a broadcast part; a worker keeps the last one it built."""
    if part.id not in _HELD:
        _HELD.clear()
        _HELD[part.id] = Matcher(part.items.value)
    return _HELD[part.id]


class _Part:
    """Items of a part of the benchmark, broadcast, under a name of its own."""

    def __init__(self, spark, items: list[tuple]):
        self.id = uuid.uuid4().hex
        self.items = spark.sparkContext.broadcast(items)


def _parts(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[_Part, bool]]:
    """The benchmark in parts of ``MAX_CHARS`` or so, and whether each one is the last."""
    items = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).filter("item is not null and text is not null")
    chars = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-chars // MAX_CHARS) or 1
    for i in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == i)
        yield _Part(benchmark.sparkSession, [tuple(r) for r in part.collect()]), i == n - 1


FOUND = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>, spans array<struct<start:long,end:long>>"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)


def judged(text: str | None, folded: bytes, hits: Hits) -> tuple:
    """What ``FOUND`` has of a text besides its id."""
    n_words = max(0, folded.count(b" ") - 1)
    marked = marked_words(n_words, hits[0])
    n_hit = int(marked.sum())
    ids = sorted(set(map(str, hits[1])))
    spans = [{"start": a, "end": b} for a, b in original_spans(text or "", marked)] if n_hit else []
    return n_words, n_hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n_words, ids, spans


_HITS = pa.struct([("runs", pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())]))), ("items", pa.list_(pa.string()))])


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", with_content: bool = False) -> DataFrame:
    """Per row of ``docs``: ``FOUND``, and ``content`` if wanted. One pass over the texts, no shuffle.

    A text is contaminated if a window occurs and hit words are at least 5 % of its words.
    """
    kept = ["content"] if with_content else []

    def scan(part: _Part, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(part)
            for batch in batches:
                ids, texts, before = next(rows_of(iter([batch]), "doc_id", "text", "hits"))
                rows = []
                for doc_id, text, found in zip(ids, texts, before, strict=True):
                    folded = normalised(text or "")
                    runs, items = matcher.hits(folded)
                    if found:
                        runs, items = runs + [(h["first"], h["n"]) for h in found["runs"]], {*map(str, items), *found["items"]}
                    rows.append((doc_id, *judged(text, folded, (runs, items))) if last else {"runs": [{"first": a, "n": n} for a, n in runs], "items": sorted(map(str, items))})
                if last:
                    yield beside(batch_of(rows, _ARROW), batch, kept)
                else:
                    at = batch.schema.get_field_index("hits")
                    yield pa.RecordBatch.from_arrays([pa.array(rows, _HITS) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

        return run

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(content(F.col(text_col)).alias(k) for k in kept), F.lit(None).cast("struct<runs:array<struct<first:long,n:long>>,items:array<string>>").alias("hits"))
    small_batches(docs.sparkSession)
    for part, last in _parts(benchmark, item_col, item_text_col):
        if last:
            return rows.mapInArrow(scan(part, True), ", ".join([FOUND, *(f"{k} binary" for k in kept)]))
        rows = written(rows.mapInArrow(scan(part, False), rows.schema), "decontaminated-in-part")
