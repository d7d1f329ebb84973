"""Hard negatives by a vector-approximation file.

Components become integers, and a score is an integer inner product. Every
dimension is cut into ``CELLS`` cells, and a row's approximation has one byte a
dimension: its cell. The cut points come from a bounded sample
(``FIT_ROWS`` rows); they decide about speed only, since the bounds of a cell
hold for every row and the outermost cells reach as far as the rows do.

For an anchor, each dimension's cells give a table of the least and the greatest
product; looking up a row's cells and adding gives bounds of its score. Two
searches follow, in which only rows whose bounds may put them among the wanted
ones are scored exactly:

1. positives: the best rows of the anchor's label. A row is scored if its upper
   bound reaches the last of the best lower bounds.
2. negatives: for each positive, the best rows of other labels in the window
   of scores below it. A row is scored if its bounds meet the window, and its
   upper bound reaches the last of the best lower bounds of rows that are surely in it.

Rows are dealt to groups of a bounded size, each a task's work; the anchors,
in chunks, come to every group. A group returns, for an anchor or window, as many
rows as are wanted, whatever ties or near copies it holds, and the best of
all groups follow by rank. The work is anchors times rows, as the stated query set asks; nothing is sampled or capped.

Defined cases: rows with a null label, a null vector, or a null or non-finite
entry take no part; shorter vectors count as filled up with zeros; components
beyond 2**24 after scaling count as 2**24, so that scores are exact 64-bit
numbers; rows without an id are no anchors and come last in ties; repeated rows
are rows of their own; a positive below 0 has an empty window; anchors without
positives or windows without rows give no rows, and neither does an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import binary_rows, finite_vectors, rows_from, written

SCALE = 256
LARGEST = 1 << 24
CELLS = 256
#: Rows from which the cut points are taken, about as many.
FIT_ROWS = 20_000
#: Rows of a group (some 350 bytes each in its task), and anchors that are looked up together.
GROUP_ROWS, CHUNK, LOOKED_UP = 65_536, 32, 4096
POSITIVES = NEGATIVES = 5
#: A negative's score is at least this part of the positive's.
LEAST = (4, 5)

ROW = "row long, id long, label long, anchor boolean, x binary"
_ROW = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("label", pa.int64()), ("anchor", pa.bool_()), ("x", pa.binary())])
POSITIVE = "row long, id long, score long, other long"
_POSITIVE = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("score", pa.int64()), ("other", pa.int64())])
NEGATIVE = "row long, anchor_id long, k int, positive_id long, positive_score long, negative_id long, negative_score long, other long"
_NEGATIVE = pa.schema([("row", pa.int64()), ("anchor_id", pa.int64()), ("k", pa.int32()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("negative_id", pa.int64()), ("negative_score", pa.int64()), ("other", pa.int64())])


def integer_rows(vectors: DataFrame, id_col: str, vector_col: str, label: Column, anchor: Column, scale: int = SCALE) -> tuple[DataFrame, int]:
    """``row, id, label, anchor, x`` of the rows that take part (x: 32-bit integers), written; and the number of dimensions."""
    dims = vectors.agg(F.max(F.size(vector_col))).first()[0] or 0
    dims = max(dims, 1)

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, rows = finite_vectors(batch.column(4), dims)
            x = np.clip(np.floor(rows[ok] * scale), -LARGEST, LARGEST).astype("<i4")
            kept = pa.array(ok)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).filter(kept) for i in range(4)), binary_rows(x)], schema=_ROW)

    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector_col).alias("v"))
    return written(rows.filter("label is not null and v is not null").mapInArrow(scaled, ROW), "integer-rows"), dims


def cut_points(rows: DataFrame, n: int, dims: int, cells: int = CELLS) -> np.ndarray:
    """For each dimension, the least values of all cells but the first; cells hold about as many of the sampled rows each."""
    some = rows.filter(F.pmod(F.xxhash64("row"), F.lit(max(1, n // FIT_ROWS))) == 0).select("x").toArrow().column("x").combine_chunks()
    if not len(some):
        return np.zeros((dims, 0), np.int32)
    x = np.sort(rows_from(some, np.dtype("<i4"), dims), axis=0)
    return np.ascontiguousarray(x[np.linspace(0, len(x), cells, endpoint=False).astype(int)[1:]].T)


def coded(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Each component's cell (dimensions by rows)."""
    return np.stack([np.searchsorted(c, x[:, d], side="right").astype(np.uint8) for d, c in enumerate(cuts)])


class Group:
    """The rows of one group in order of their labels: approximations, what their cells reach, and integers to score with."""

    def __init__(self, batches: list[pa.RecordBatch], cuts: np.ndarray):
        table = pa.Table.from_batches(batches).combine_chunks()
        self.dims = len(cuts)
        label = table.column("label").to_numpy()
        order = np.argsort(label, kind="stable")
        self.label = label[order]
        self.row = table.column("row").to_numpy()[order]
        self.id_null = table.column("id").is_null().to_numpy()[order]
        self.id = table.column("id").fill_null(0).to_numpy()[order]
        self.x = rows_from(table.column("x").combine_chunks(), np.dtype("<i4"), self.dims)[order]
        self.cells = np.frombuffer(b"".join(table.column("cells").to_pylist()), np.uint8).reshape(len(order), self.dims)[order].T.copy()
        # a cell reaches from its cut point to below the next one; the outermost as far as this group's rows
        n_cells = cuts.shape[1] + 1
        self.least, self.most = np.zeros((self.dims, n_cells), np.int64), np.zeros((self.dims, n_cells), np.int64)
        if len(order):
            self.least[:, 0], self.most[:, -1] = self.x.min(axis=0), self.x.max(axis=0)
        self.least[:, 1:], self.most[:, :-1] = cuts, cuts - 1
        self.most = np.maximum(self.most, self.least)  # cells that hold nothing
        self.greatest = int(max(np.abs(self.least).max(initial=0), np.abs(self.most).max(initial=0)))

    def of_label(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.label, label, "left")), int(np.searchsorted(self.label, label, "right"))

    def bounds(self, q: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (anchors by rows) of the scores of rows ``start`` to ``end``, by lookup of their cells."""
        wide = np.int64 if self.dims * self.greatest * int(np.abs(q).max(initial=0)) >= 1 << 31 else np.int32
        ends = q.T[:, None, :] * self.least[:, :, None], q.T[:, None, :] * self.most[:, :, None]
        low, high = np.minimum(*ends).astype(wide), np.maximum(*ends).astype(wide)
        lower, upper = np.empty((len(q), end - start), wide), np.empty((len(q), end - start), wide)
        for at in range(start, end, LOOKED_UP):
            cells = self.cells[:, at : min(at + LOOKED_UP, end)]
            for table, out in ((low, lower), (high, upper)):
                total = np.zeros((cells.shape[1], len(q)), wide)
                for d in range(self.dims):
                    total += table[d].take(cells[d], axis=0)
                out[:, at - start : at - start + cells.shape[1]] = total.T
        return lower, upper

    def best(self, at: np.ndarray, score: np.ndarray, wanted: int) -> np.ndarray:
        """The places, among ``at``, of the best scores; of equal ones those of the least ids."""
        if len(at) > 8 * wanted:
            near = np.flatnonzero(score >= np.partition(score, -wanted)[-wanted])
            return near[self.best(at[near], score[near], wanted)] if len(near) < len(at) else self._sorted(at, score)[:wanted]
        return self._sorted(at, score)[:wanted]

    def _sorted(self, at: np.ndarray, score: np.ndarray) -> np.ndarray:
        return np.lexsort((self.row[at], self.id[at], self.id_null[at], -score))

    def scored(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        return self.x[at].astype(np.int64) @ q

    def ids(self, at: np.ndarray) -> list[int | None]:
        return [None if null else i for i, null in zip(self.id[at].tolist(), self.id_null[at].tolist(), strict=True)]


def positives_in(group: Group, rows: np.ndarray, label: int, q: np.ndarray, wanted: int) -> Iterator[tuple]:
    """For anchors of one label: ``row, id, score, other`` of the best other rows of this label."""
    start, end = group.of_label(label)
    if start == end:
        return
    lower, upper = group.bounds(q, start, end)
    for j, row in enumerate(rows.tolist()):
        others = group.row[start:end] != row
        low, high = lower[j][others], upper[j][others]
        at = start + np.flatnonzero(others)
        if len(at) > wanted:
            at = at[high >= np.partition(low, -wanted)[-wanted]]
        score = group.scored(at, q[j])
        chosen = group.best(at, score, wanted)
        yield from zip([row] * len(chosen), group.ids(at[chosen]), score[chosen].tolist(), group.row[at[chosen]].tolist(), strict=True)


def negatives_in(group: Group, anchor: dict, q: np.ndarray, lower: np.ndarray, upper: np.ndarray, wanted: int, least: tuple[int, int]) -> Iterator[tuple]:
    """For one anchor's windows: the best rows of other labels in each."""
    tops = [p["score"] for p in anchor["positives"]]
    floors = [-(-least[0] * top // least[1]) for top in tops]
    near = np.flatnonzero((upper >= min(floors)) & (lower <= max(tops)) & (group.label != anchor["label"]))
    low, high = lower[near], upper[near]
    possible = np.zeros(len(near), bool)
    for top, floor in zip(tops, floors, strict=True):
        meets = (high >= floor) & (low <= top)
        sure = low[(low >= floor) & (high <= top)]
        if len(sure) > wanted:
            meets &= high >= np.partition(sure, -wanted)[-wanted]
        possible |= meets
    at = near[possible]
    score = group.scored(at, q)
    for k, (p, floor) in enumerate(zip(anchor["positives"], floors, strict=True)):
        inside = np.flatnonzero((score >= floor) & (score <= p["score"]))
        chosen = inside[group.best(at[inside], score[inside], wanted)]
        for i, s, other in zip(group.ids(at[chosen]), score[chosen].tolist(), group.row[at[chosen]].tolist(), strict=True):
            yield anchor["row"], anchor["id"], k, p["id"], p["score"], i, s, other


def _search(judge, schema: pa.Schema, cuts: np.ndarray):
    """Walks a partition that holds the rows of one group and then the anchors, in order of their labels; ``judge`` gets chunks of these."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        group: Group | None = None
        for batch in batches:
            kinds = batch.column("kind").to_numpy(zero_copy_only=False)
            split = int(np.searchsorted(kinds, 1))
            if split:
                held.append(batch.slice(0, split))
            if split == len(kinds) or not held:
                continue
            group = group or Group(held, cuts)
            anchors = batch.slice(split)
            labels = anchors.column("label").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
            for a, b in zip(edges, edges[1:], strict=False):
                for at in range(a, b, CHUNK):
                    chunk = anchors.slice(at, min(CHUNK, b - at))
                    q = rows_from(chunk.column("x"), np.dtype("<i4"), len(cuts)).astype(np.int64)
                    found = list(judge(group, chunk, q))
                    columns = zip(*found, strict=True) if found else [[]] * len(schema)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    return walk


def _met(rows: DataFrame, anchors: DataFrame, groups: int) -> DataFrame:
    """Each group's rows, and after them every anchor, in a partition of its own."""
    to_all = anchors.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("kind", F.lit(1))
    both = rows.withColumn("kind", F.lit(0)).unionByName(to_all, allowMissingColumns=True)
    return both.repartitionById(groups, F.col("g")).sortWithinPartitions("kind", "label", "row")


def hard_negatives(
    vectors: DataFrame, label: Column, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, least: tuple[int, int] = LEAST,
) -> DataFrame:
    """Per anchor and positive, the best negatives of its window.

    Columns: ``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``. ``label`` and ``anchor`` are columns of ``vectors``; the
    window of a positive reaches from ``least`` (a fraction) of its score up to it.
    """
    spark = vectors.sparkSession
    rows, dims = integer_rows(vectors, id_col, vector_col, label, anchor, scale)
    n = rows.count()
    groups = max(-(-n // GROUP_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = cut_points(rows, n, dims)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = coded(rows_from(batch.column("x"), np.dtype("<i4"), dims), cuts)
            yield pa.RecordBatch.from_arrays([*batch.columns, binary_rows(cells.T)], names=[*batch.schema.names, "cells"])

    dealt = rows.select("row", "id", "label", "x", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("g"))
    file = written(dealt.mapInArrow(code, "row long, id long, label long, x binary, g int, cells binary"), "approximations")
    anchors = rows.filter("anchor").select("row", "id", "label", "x")

    def positives(group: Group, chunk: pa.RecordBatch, q: np.ndarray) -> Iterator[tuple]:
        return positives_in(group, chunk.column("row").to_numpy(), chunk.column("label")[0].as_py(), q, n_positives)

    found = _met(file, anchors, groups).mapInArrow(_search(positives, _POSITIVE, cuts), POSITIVE)
    place = lambda by, score, id_: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), F.col(id_).asc_nulls_last(), "other"))
    best = found.withColumn("at", place(["row"], "score", "id")).filter(F.col("at") <= n_positives)
    # at most n_positives to an anchor
    windows = best.filter("score >= 0").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "id", "score"))).alias("positives"))
    asked = written(anchors.join(windows, "row"), "windows")

    def negatives(group: Group, chunk: pa.RecordBatch, q: np.ndarray) -> Iterator[tuple]:
        lower, upper = group.bounds(q, 0, len(group.row))
        for j, a in enumerate(chunk.select(["row", "id", "label", "positives"]).to_pylist()):
            yield from negatives_in(group, a, q[j], lower[j], upper[j], n_negatives, least)

    mined = _met(file, asked, groups).mapInArrow(_search(negatives, _NEGATIVE, cuts), NEGATIVE)
    ranked = mined.withColumn("rank", place(["row", "k"], "negative_score", "negative_id")).filter(F.col("rank") <= n_negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
