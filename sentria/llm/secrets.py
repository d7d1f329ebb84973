"""Secret scans over an incremental blob ledger.

Every version of a text is content-addressed by the SHA-256 of its UTF-8
bytes. A ledger in a folder has two tables that only grow. ``findings`` records
which blobs were scanned under which version of the rules, with what was found;
``versions`` records which blobs every path ever had, with the batch that saw it
first. A scan looks only at pairs of blob and rule version that the ledger lacks,
each blob once however many paths hold it, appends them, and joins findings back
to all paths: ``scan_secrets`` to the rows at hand, ``history`` to every version
of every path, those that were overwritten or deleted since included.

Defined cases: a null text is the empty blob; repeated rows and repeated ids
each keep a row; an empty table gives an empty result; columns beside the id
and the text are ignored. A batch that a lost driver left unfinished has no
``_SUCCESS`` mark and is not read: its blobs are scanned again.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import batch_of, keyed_only, rows_of, small_batches, spare, written

Span = tuple[int, int, str]

#: Base kinds first, in the order that ties in ``start`` take.
KINDS = ("assign", "access", "hex", "pem", "jwt", "forge", "chat", "basic")
#: Part of the ledger's key: raise it with every change of the rules below.
RULE_VERSION = 3
#: Rows of one blob from which its findings are not joined by a shuffle.
HOT = 10_000

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
CUES = (b"passw", b"secret", b"token", b"api_key", b"apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Added kinds: a literal that must occur, and the pattern.
ADDED = (
    ("pem", "-----BEGIN ", re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]{0,40}PRIVATE KEY-----")),
    ("jwt", "eyJ", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("forge", "gh", re.compile(r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}")),
    ("chat", "xox", re.compile(r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}")),
    ("basic", "://", re.compile(r"(?<=://)[^\s/:@]++:[^\s/:@]{3,}+(?=@)")),
)


def find_secrets(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans as (start, end, kind), in order of start, then kind."""
    base: list[Span] = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(cue in low for cue in CUES):
        base += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        base += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    base += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    more = [(m.start(), m.end(), kind) for kind, literal, pattern in ADDED if literal in text for m in pattern.finditer(text)]
    order = lambda s: (s[0], KINDS.index(s[2]))
    return sorted(base, key=order), sorted(base + more, key=order)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every found secret, overlapping ones as one, replaced by ``mark``."""
    if not text:
        return text
    parts, at = [], 0
    for start, end, _ in find_secrets(text)[1]:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]]) if parts else text


FOUND = "blob string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
VERSION = "doc_id long, blob binary, batch int"
_ARROW = pa.schema([("blob", pa.string()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for blobs, texts in rows_of(batches, "blob", "text"):
        rows = []
        for blob, text in zip(blobs, texts, strict=True):
            base, every = find_secrets(text)
            kinds = [k for _, _, k in base]
            rows.append((blob, *(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
        yield batch_of(rows, _ARROW)


def content_address(text: Column) -> Column:
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)


def _ledger(spark: SparkSession, ledger: str, table: str, schema: str) -> DataFrame | None:
    """The finished batches of one of the ledger's tables, null if there are none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [str(s.getPath().getParent()) for s in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/{table}-*/_SUCCESS")) or []]
    return spark.read.schema(schema).parquet(*done) if done else None


def ledger_of(docs: DataFrame, ledger: str) -> DataFrame | None:
    """The ledger's rows ``FOUND + rule_version``, null if it has none."""
    return _ledger(docs.sparkSession, ledger, "batch", f"{FOUND}, rule_version int")


def versions_of(docs: DataFrame, ledger: str) -> DataFrame | None:
    """Rows ``VERSION``: a blob that a path had once, null if there are none."""
    return _ledger(docs.sparkSession, ledger, "versions", VERSION)


def _with_findings(paths: DataFrame, hits: DataFrame, hot: DataFrame | None, *columns: str) -> DataFrame:
    """``paths`` with the findings of their blobs; those of ``hot`` blobs go to the rows, not the rows to one task."""
    none = hashlib.sha256(b"").hexdigest()
    if hot is None:
        rows = paths.join(hits, "blob", "left")
    else:
        hot_hits = written(hits.join(keyed_only(hot), "blob", "left_semi"), "hot-findings")
        marked = paths.join(keyed_only(hot.select(F.col("blob").alias("hot_blob"))), F.col("blob") == F.col("hot_blob"), "left")
        cold = marked.filter("hot_blob is null").drop("hot_blob").join(hits.join(keyed_only(hot), "blob", "left_anti"), "blob", "left")
        rows = cold.unionByName(marked.filter("hot_blob is not null").drop("hot_blob").join(keyed_only(hot_hits), "blob", "left"))
    return rows.select(
        *columns, *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_assign", "n_access", "n_hex")),
        F.coalesce("base_sha256", F.lit(none)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )


def _hits(docs: DataFrame, ledger: str, rule_version: int) -> DataFrame:
    # repeated rows of one id scan a blob more than once, with equal results
    return ledger_of(docs, ledger).filter((F.col("rule_version") == rule_version) & (F.col("spans") != "")).drop("rule_version").dropDuplicates(["blob"])


def scan_secrets(docs: DataFrame, ledger: str, id_col: str = "doc_id", text_col: str = "text", rule_version: int = RULE_VERSION) -> DataFrame:
    """Scan what the ledger lacks, append it, and give every row its findings.

    Returns ``doc_id, blob, n_assign, n_access, n_hex, base_sha256, spans``.
    Texts move between machines only if more blobs have several paths than
    may be broadcast (``BROADCAST_KEYS``).
    """
    spark = docs.sparkSession
    small_batches(spark)
    addressed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), content_address(F.col(text_col)).alias("blob"))
    paths = written(addressed.select("doc_id", "blob"), "paths")
    many = written(paths.groupBy("blob").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.unhex("blob").alias("of_blob"), "first_id", "n"), "shared-blobs")
    once = addressed.join(keyed_only(many), F.unhex("blob") == F.col("of_blob"), "left").filter(F.col("of_blob").isNull() | F.col("doc_id").eqNullSafe(F.col("first_id"))).select("blob", "text")
    before, known = ledger_of(docs, ledger), versions_of(docs, ledger)
    if before is not None:
        once = once.join(before.filter(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    found = once.mapInArrow(_scan, FOUND).withColumn("rule_version", F.lit(rule_version))
    found.write.parquet(f"{ledger}/batch-{uuid.uuid4().hex}")
    unseen = paths.select("doc_id", F.unhex("blob").alias("blob")).distinct()
    if known is not None:
        old = known.select(F.col("doc_id").alias("old_id"), F.col("blob").alias("old_blob"))
        unseen = unseen.join(old, F.col("doc_id").eqNullSafe(F.col("old_id")) & (F.col("blob") == F.col("old_blob")), "left_anti")
    # batches are numbered in the order of their scans
    number = 0 if known is None else known.agg(F.max("batch")).first()[0] or 0
    unseen.withColumn("batch", F.lit(number + 1)).write.parquet(f"{ledger}/versions-{uuid.uuid4().hex}")
    hot = many.filter(F.col("n") > HOT).select(F.lower(F.hex("of_blob")).alias("blob"))
    return _with_findings(paths, _hits(docs, ledger, rule_version), None if hot.isEmpty() else hot, "doc_id", "blob")


def history(docs: DataFrame, ledger: str, rule_version: int = RULE_VERSION) -> DataFrame:
    """Findings in every version that a path ever had: ``doc_id, blob, batch`` and the columns of ``scan_secrets``.

    ``docs`` lends its session only.
    """
    versions = versions_of(docs, ledger)
    if versions is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, blob string, batch int, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    paths = versions.withColumn("blob", F.lower(F.hex("blob")))
    hot = written(paths.groupBy("blob").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("blob"), "hot-blobs")
    return _with_findings(paths, _hits(docs, ledger, rule_version), None if hot.isEmpty() else hot, "doc_id", "blob", "batch")


def redacted(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the secrets of its texts marked out; ``found`` is from ``scan_secrets``.

    Only texts whose blob has findings are scanned for their spans again.
    """
    small_batches(docs.sparkSession)
    is_dirty, blob = spare(docs, "is_dirty"), spare(docs, "blob_of_text")
    dirty = keyed_only(found.filter("spans <> ''").select(F.col("blob").alias(is_dirty)).distinct())
    marked = docs.withColumn(blob, content_address(F.col(text_col))).join(dirty, F.col(blob) == F.col(is_dirty), "left").drop(blob)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, flag = batch.schema.get_field_index(text_col), batch.schema.get_field_index(is_dirty)
            texts = batch.column(at)
            if batch.column(flag).null_count < len(batch):
                texts = pa.array([redact(t) if d else t for t, d in zip(texts.to_pylist(), batch.column(flag).to_pylist(), strict=True)], texts.type)
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    fixed = marked.mapInArrow(mark, marked.schema)
    if length_col:
        changed = F.length(F.col(text_col)).cast(docs.schema[length_col].dataType)
        fixed = fixed.withColumn(length_col, F.when(F.col(is_dirty).isNotNull(), changed).otherwise(F.col(length_col)))
    return fixed.drop(is_dirty)
