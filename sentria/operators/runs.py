"""Ordered folds over keyed runs, without ever holding a key's rows.

Rows are dealt by key and sorted within partitions; a fold then walks each run
of equal keys as a stream. Memory is what the fold keeps, not what the key has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

Fold = Callable[[Iterable[dict]], Iterator[dict]]
BATCH = 5000


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _sent(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out: list[dict] = []
    for row in rows:
        out.append(row)
        if len(out) >= BATCH:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    yield pa.RecordBatch.from_pylist(out, schema=schema)


def fold_runs(df: DataFrame, keys: list[str], order: list[str], fold: Fold, schema: str) -> DataFrame:
    """``fold`` gets each key's rows in order, as dictionaries, and gives rows of ``schema``."""
    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    arrow = to_arrow_schema(parsed)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = groupby(_rows(batches), key=lambda r: tuple(r[k] for k in keys))
        yield from _sent((row for _, run in runs for row in fold(run)), arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(walk, parsed)


def map_rows(df: DataFrame, function: Callable[[dict], Iterable[dict]], schema: str) -> DataFrame:
    """Rows of ``schema`` from each row by itself, in Arrow batches and without a shuffle."""
    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    arrow = to_arrow_schema(parsed)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sent((out for row in _rows(batches) for out in function(row)), arrow)

    return df.mapInArrow(each, parsed)
