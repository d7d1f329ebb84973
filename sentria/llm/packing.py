"""Best-fit packing of tokenised documents into sequences, hierarchically.

Documents are tokenised and cut where they are longer than a sequence; the
first piece takes what full pieces leave over. Each partition packs its pieces
by best fit, longest first, and emits the bins that are nearly full. Underfull
bins become items themselves: groups of partitions merge, as in a tree, and
pack these items by best fit again, until one group is left or none can be filled.

After best fit no two bins of one partition fit into one, so that each partition
has one bin at most that is no more than half full. Only these can still fill
others, and a histogram of their sizes (``capacity`` / 2 rows at most) tells how many
of them fit beside a bin of each size. A partition hands on so many bins of a size and
emits the rest, for which no item is left anywhere: lengths that don't combine end
where they were packed first, and no task takes the table.

Ids are those of the ``tokenizers`` file. Texts made only of characters below
U+0250 without the special token are encoded with ``tiktoken`` from the same
vocabulary, which gives the same ids several times faster (a worker compares both
files first and fails if they differ); all others with ``tokenizers`` itself.
``END_ID`` follows each document.

Defined cases: a null text is empty and takes one token, ``END_ID``; repeated
rows and ids are packed row by row; an empty table gives an empty result; extra
columns are ignored. Sequence numbers depend only on the input's partitions
and the order of lengths and ids, so that a task that runs again gives the same rows.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import batch_of, rows_of, small_batches, written

CAPACITY = 2048
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
#: A bin is emitted once it has this many tokens.
NEARLY_FULL = 2028
#: Partitions that merge in each round.
FAN_IN = 8

_OTHER = re.compile("[^\x00-ɏ]")
_SPECIAL = "<|endoftext|>"


@cache
def _slow(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class DifferentVocabularies(ValueError):
    """The two files of a tokenizer don't have the same ids."""


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary of a byte-level tokenizer: printable Latin-1 for itself."""
    plain = [b for b in range(256) if chr(b).isprintable() and b != 32]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@cache
def _fast(path: str, pattern: str, slow: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    letters, known = _byte_letters(), _slow(slow).get_vocab()
    if any(known.get("".join(map(letters.__getitem__, token))) != number for token, number in ranks.items()):
        raise DifferentVocabularies(f"{path} and {slow}")
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, tokenizer: str = TOKENIZER, ranks: str | None = RANKS) -> list[int]:
    """Ids of a text as ``tokenizers`` gives them, without the closing id."""
    import public_tokenizers

    if ranks and _SPECIAL not in text and not _OTHER.search(text):
        return _fast(public_tokenizers.path(ranks), public_tokenizers.PATTERN, public_tokenizers.path(tokenizer)).encode_ordinary(text)
    return _slow(public_tokenizers.path(tokenizer)).encode(text, add_special_tokens=False).ids


def pieces(ids: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, CRC-32 of the little-endian ids) of a document's ids."""
    data = np.asarray(ids, "<u4").tobytes()
    first = len(ids) % capacity or min(len(ids), capacity)
    cuts = [0, *range(first, len(ids) + 1, capacity)]
    return [(i, a, b - a, zlib.crc32(data[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def best_fit(sizes: Iterable[int], capacity: int = CAPACITY) -> list[int]:
    """The bin of each item, which should come longest first.

    ``free`` has a bit for each room that some open bin has; the lowest
    bit from the item's size on is the tightest fit.
    """
    rooms: dict[int, list[int]] = defaultdict(list)
    free, bins, out = 0, 0, []
    for size in sizes:
        fits = free >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            held = rooms[room]
            number = held.pop()
            if not held:
                free ^= 1 << room
        else:
            room, number, bins = capacity, bins, bins + 1
        if room > size:
            rooms[room - size].append(number)
            free |= 1 << (room - size)
        out.append(number)
    return out


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECE = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
#: ``used`` is the bin's size, ``rank`` counts bins of that size in the partition ``part``.
PLACED = f"{PIECE}, sequence_id long, offset long, used long, rank long, part long"
_PLACED = pa.schema([*_PIECE, *((n, pa.int64()) for n in ("sequence_id", "offset", "used", "rank", "part"))])


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, ranks: str | None = RANKS) -> DataFrame:
    """One row for each piece of each document."""
    small_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows_of(batches, "doc_id", "text"):
            yield batch_of([(i, *p) for i, t in zip(ids, texts, strict=True) for p in pieces([*token_ids(t or "", tokenizer, ranks), END_ID], capacity)], pa.schema(_PIECE))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, PIECE)


def _packer(level: int, capacity: int):
    """Packs a partition's items. At level 0 these are pieces, afterwards bins, whose rows share a sequence id."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        items: dict[object, list[tuple]] = defaultdict(list)
        number = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                number += 1
                items[number if level == 0 else row[5]].append(row[:7] if level else (*row, 0, 0))
        # a total order, whatever order the rows arrived in
        order = sorted(items.values(), key=lambda rows: (-sum(r[3] for r in rows), min((r[0] is not None, r[0] or 0, r[1], r[4]) for r in rows)))
        totals = [sum(r[3] for r in rows) for rows in order]
        placed = best_fit(totals, capacity)
        filled: dict[int, int] = defaultdict(int)
        for total, where in zip(totals, placed, strict=True):
            filled[where] += total
        sizes: dict[int, int] = defaultdict(int)
        rank: dict[int, int] = {}
        for where in range(len(filled)):
            rank[where] = sizes[filled[where]]
            sizes[filled[where]] += 1
        base = (level << 56) | (part << 32)
        at: dict[int, int] = defaultdict(int)
        out: list[tuple] = []
        for rows, total, where in zip(order, totals, placed, strict=True):
            out += [(*r[:5], base | where, at[where] + r[6], filled[where], rank[where], part) for r in rows]
            at[where] += total
            if len(out) >= 20_000:
                yield batch_of(out, _PLACED)
                out = []
        yield batch_of(out, _PLACED)

    return pack


def _wanted(placed: DataFrame, capacity: int, enough: int) -> list[int]:
    """For each size of a bin (0 to ``capacity``) how many bins there are that fit beside it."""
    small = placed.filter((2 * F.col("used") <= capacity) & (F.col("used") < enough))
    counts = {r[0]: r[1] for r in small.groupBy("used").agg(F.countDistinct("sequence_id")).collect()}
    out, held = [0] * (capacity + 1), 0
    for room in range(1, capacity + 1):
        held += counts.get(room, 0)
        size = capacity - room
        out[size] = held if size >= enough or 2 * size > capacity else held - counts.get(size, 0) + max(0, counts.get(size, 0) - 1)
    return out


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, nearly_full: int | None = None, fan_in: int = FAN_IN, tokenizer: str = TOKENIZER, ranks: str | None = RANKS) -> DataFrame:
    """``PIECE`` with ``sequence_id`` and ``offset``. Only rows of pieces, never texts or ids, move between machines."""
    enough = NEARLY_FULL * capacity // CAPACITY if nearly_full is None else nearly_full
    rows = written(tokenised(docs, id_col, text_col, capacity, tokenizer, ranks), "pieces")
    groups = rows.rdd.getNumPartitions()
    placed = written(rows.mapInArrow(_packer(0, capacity), PLACED), "placed")
    done, level = [], 0
    while groups > 1:
        wanted = _wanted(placed, capacity, enough)
        goes_on = (F.col("used") < enough) & (F.col("rank") < F.element_at(F.lit(wanted), F.col("used").cast("int") + 1))
        if not any(wanted):
            break
        level += 1
        done.append(placed.filter(~goes_on))
        groups = -(-groups // fan_in)
        merged = placed.filter(goes_on).withColumn("part", F.floor(F.col("part") / fan_in)).repartitionById(groups, F.col("part").cast("int"))
        placed = written(merged.select(*_PLACED.names).mapInArrow(_packer(level, capacity), PLACED), "placed")
    for more in done:
        placed = placed.unionByName(more)
    return placed.select(*(n for n, _ in _PIECE), "sequence_id", "offset")
