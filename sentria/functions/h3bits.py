"""Algebra of H3 indexes by their public bit layout: no geometry, no tables.

An index has, from bit 52 up, its resolution (4 bits); from bit 45, its base cell
(7 bits); and below, fifteen digits of three bits each, coarsest first, of which
those beyond the resolution are 7. Twelve base cells are pentagons, whose
children lack the digit 1 after leading zeros.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pentagonal base cells (fixed values).
PENTAGONS = (4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117)


def parse(text: Column) -> Column:
    return F.when(text.rlike("^[0-9a-f]{1,16}$"), F.conv(text, 16, 10).cast("decimal(20,0)").cast("long"))


def to_text(cell: Column | str) -> Column:
    return F.lower(F.hex(F.col(cell) if isinstance(cell, str) else cell))


def resolution(cell: Column) -> Column:
    return F.shiftright(cell, 52).bitwiseAND(F.lit(15)).cast("int")


def base_cell(cell: Column) -> Column:
    return F.shiftright(cell, 45).bitwiseAND(F.lit(127)).cast("int")


def digit(cell: Column, r: int) -> Column:
    """The digit of resolution ``r``, 1 to 15."""
    return F.shiftright(cell, 3 * (15 - r)).bitwiseAND(F.lit(7)).cast("int")


def last_digit(cell: Column) -> Column:
    """The digit of its own resolution; of a base cell none that counts."""
    return F.call_function("shiftright", cell, 3 * (15 - resolution(cell))).bitwiseAND(F.lit(7)).cast("int")


def is_cell(cell: Column) -> Column:
    """Mode 1, a base cell there is, digits up to the resolution and none beyond."""
    good = (F.shiftright(cell, 59).bitwiseAND(F.lit(31)) == 1) & (F.shiftright(cell, 56).bitwiseAND(F.lit(7)) == 0) & (base_cell(cell) < 122)
    for r in range(1, 16):
        good = good & F.when(resolution(cell) >= r, digit(cell, r) != 7).otherwise(digit(cell, r) == 7)
    return F.coalesce(good, F.lit(False))


def parent(cell: Column, to: int) -> Column:
    """The cell that holds it at a coarser resolution; null if ``to`` is finer."""
    fill = (1 << (3 * (15 - to))) - 1
    moved = cell.bitwiseAND(F.lit(~(15 << 52))).bitwiseOR(F.lit(to << 52)).bitwiseOR(F.lit(fill))
    return F.when(resolution(cell) >= to, moved)


def is_pentagon(cell: Column) -> Column:
    zeros = F.lit(True)
    for r in range(1, 16):
        zeros = zeros & ((resolution(cell) < r) | (digit(cell, r) == 0))
    return base_cell(cell).isin(*PENTAGONS) & zeros


def children(cell: Column, to: int) -> Column:
    """Children one resolution finer, which must be ``to``; null otherwise."""
    shift = 3 * (15 - to)
    opened = cell.bitwiseAND(F.lit(~(15 << 52))).bitwiseOR(F.lit(to << 52)).bitwiseAND(F.lit(~(7 << shift)))
    digits = F.when(is_pentagon(cell), F.array(*map(F.lit, (0, 2, 3, 4, 5, 6)))).otherwise(F.array(*map(F.lit, range(7))))
    return F.when(resolution(cell) == to - 1, F.transform(digits, lambda d: opened.bitwiseOR(d.cast("long") * F.lit(1 << shift))))


def _shifted(value: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", value.cast("long"), bits.cast("int"))


def up(cell: Column) -> Column:
    """The cell that holds it one resolution coarser; null for base cells."""
    r = resolution(cell)
    moved = cell.bitwiseAND(F.lit(~(15 << 52))).bitwiseOR(_shifted(r - 1, F.lit(52))).bitwiseOR(_shifted(F.lit(7), 3 * (15 - r)))
    return F.when(r > 0, moved)


def split(cell: Column) -> Column:
    """Its children one resolution finer: seven, or six of a pentagon; null at the finest."""
    r = resolution(cell)
    shift = 3 * (14 - r)
    opened = cell.bitwiseAND(F.lit(~(15 << 52))).bitwiseOR(_shifted(r + 1, F.lit(52))).bitwiseAND(F.bitwise_not(_shifted(F.lit(7), shift)))
    digits = F.when(is_pentagon(cell), F.array(*map(F.lit, (0, 2, 3, 4, 5, 6)))).otherwise(F.array(*map(F.lit, range(7))))
    return F.when(r < 15, F.transform(digits, lambda d: opened.bitwiseOR(_shifted(d, shift))))
