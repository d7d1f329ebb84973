"""Helpers shared by the corpus operators: the shared folder, written tables, text batches.

Everything that one job leaves for a later one goes to the folder that the
cluster names in ``spark.checkpoint.dir``; nothing is kept on one machine.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows and bytes of one Arrow batch sent to a Python worker; texts are long.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: Most rows of single keys of 8 to 32 bytes that may be broadcast (some 150 MB as a hashed relation).
BROADCAST_KEYS = 1_000_000


class NoSharedFolder(RuntimeError):
    """A cluster's session doesn't name a folder that all executors can reach."""


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver can reach.

    ``spark.checkpoint.dir`` of the session, or what was set on its context. Where
    neither is, a local session (as in tests) gets a folder of this machine; on
    a cluster this is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise NoSharedFolder("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sentria-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    Cuts lineage so that lost executors cost only running tasks, and gives
    the planner a true size, by which it alone decides about broadcasts.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that carry whole texts, by rows and by bytes.

    Plans read these settings when they run, so they stay with the session; they
    are only ever lowered.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        held = re.sub(r"[^0-9-]", "", str(spark.conf.get(key)))
        if not 0 < int(held or 0) <= most:
            spark.conf.set(key, str(most))


def keyed_only(keys: DataFrame) -> DataFrame:
    """``keys`` marked for broadcast if a count proves it small, else as it is."""
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark resolves it: with the scheme of the default file system if it has none."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toString()


#: Schemes of Hadoop's connectors and those by which Arrow knows the same stores.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs", "viewfs": "viewfs", "file": "file", "abfss": "abfss"}


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a qualified path, and the path in it. HDFS needs libhdfs on the workers."""
    scheme, colon, rest = uri.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), re.sub("^//+", "/", rest if colon else uri)
    return fs.FileSystem.from_uri(f"{ARROW_SCHEMES.get(scheme, scheme)}:{rest}")


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, like ``name``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[list, ...]]:
    """The named columns of each Arrow batch as Python lists."""
    for batch in batches:
        yield tuple(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """An Arrow batch of row tuples, which may be none."""
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def content(text: Column) -> Column:
    """Sixteen bytes of the SHA-256 of a text; null is empty."""
    return F.substring(F.unhex(F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)), 1, 16)


def beside(out: pa.RecordBatch, batch: pa.RecordBatch, names: Iterable[str]) -> pa.RecordBatch:
    """``out`` with the named columns of ``batch``, which has the same rows."""
    return pa.RecordBatch.from_arrays([*out.columns, *(batch.column(batch.schema.get_field_index(n)) for n in names)], names=[*out.schema.names, *names])


def finite_vectors(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which lists of numbers are vectors (neither null nor holding null or non-finite entries), and all as rows of doubles.

    Shorter lists are filled up with zeros; rows of lists that are no vectors mean nothing.
    """
    n = len(column)
    ok = column.is_valid().to_numpy(zero_copy_only=False)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(n), lengths)
    finite = np.isfinite(values)
    ok[owner[~finite]] = False
    values = np.where(finite, values, 0.0)
    if n and (lengths == dims).all():
        return ok, values.reshape(n, dims)
    rows = np.zeros((n, dims))
    rows[owner, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return ok, rows


def binary_rows(rows: np.ndarray) -> pa.Array:
    """Each row's bytes, as one binary value."""
    rows = np.ascontiguousarray(rows)
    width = rows.dtype.itemsize * rows.shape[1]
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def rows_from(column: pa.Array, dtype: np.dtype, dims: int) -> np.ndarray:
    """The inverse of ``binary_rows``."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), dims)
