"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text gives a vector of transformed statistics (``FEATURES``). Class means
and covariances come from sums over all labelled training rows, which Spark adds
up; covariances are shrunk towards their pooled diagonal. The score is the
logistic function of the difference of the classes' log densities, from
Mahalanobis distances with cached Cholesky factors, plus the log prior odds.

Defined cases: a null text is empty; an empty text has a vector like any other;
repeated rows each get a score; labels that are null, or of ids without a
text, count for nothing, and several labels of an id count each; without
training rows of both classes every score is the share of class 1 (1 if there
are no labels at all, so that nothing is rejected); a null id is never labelled
and not held out; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import batch_of, beside, content, rows_of, small_batches, written

THRESHOLD = 0.7
FEATURES = (
    "length", "words", "word_length", "symbols", "upper", "exclaim", "pipes", "digits", "punctuation", "distinct",
    "repeated_lines", "repeated_grams", "line_words", "marked_words", "capital_words",
)
_SYMBOLS = b"#*$%&|<>"
_END = re.compile(r"[#*$%&|<>!]{2,}(?:\s|$)")


def statistics(text: str) -> list[float]:
    """The vector of one text: shares and lengths after logarithms or roots, in proportionate time."""
    data = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    n, nw, nl = max(1, len(text)), max(1, len(words)), max(1, len(lines))
    share = lambda chars: float(counts[list(chars)].sum()) / n
    grams = [hash(g) for g in zip(words, words[1:], words[2:], words[3:])]
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        np.log1p(sum(map(len, words)) / nw),
        np.sqrt(share(_SYMBOLS)),
        np.sqrt(float(counts[65:91].sum()) / n),
        np.sqrt(share(b"!?")),
        np.sqrt(share(b"|")),
        np.sqrt(float(counts[48:58].sum()) / n),
        np.sqrt(share(b".,;:")),
        len(set(words)) / nw,
        1 - len(set(lines)) / nl if lines else 0.0,
        1 - len(set(grams)) / len(grams) if grams else 0.0,
        np.log1p(nw / nl),
        np.sqrt(len(_END.findall(text)) / nw),
        np.sqrt(sum(map(str.isupper, words)) / nw),
    ]


@dataclass(frozen=True)
class Model:
    """Per class: mean, inverse Cholesky factor of the shrunk covariance, log determinant, log prior."""

    mean: np.ndarray
    inverse: np.ndarray
    log_det: np.ndarray
    log_prior: np.ndarray
    constant: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        log = []
        for c in (0, 1):
            z = (x - self.mean[c]) @ self.inverse[c].T
            log.append(self.log_prior[c] - self.log_det[c] - 0.5 * (z * z).sum(1))
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -30, 30)))


def fit(sums: list[tuple[float, np.ndarray, np.ndarray]], shrink: float = 0.1, floor: float = 1e-4) -> Model:
    """From (rows, sum of x, sum of x xT) of the classes 0 and 1.

    A class covariance S becomes (1 - a) S + a D, with D the pooled diagonal and
    a = shrink + (1 - shrink) d / (d + n), so that small classes lean on D more.
    """
    d = len(FEATURES)
    n = np.array([s[0] for s in sums])
    if n.min() < 2:
        return Model(*[np.zeros(0)] * 4, constant=float(n[1] / n.sum()) if n.sum() else 1.0)
    means = [s[1] / s[0] for s in sums]
    covariances = [s[2] / s[0] - np.outer(m, m) for s, m in zip(sums, means, strict=True)]
    pooled = np.diag(sum(c * k for c, k in zip(covariances, n, strict=True)) / n.sum()) + floor
    inverse, log_det = [], []
    for c, k in zip(covariances, n, strict=True):
        a = shrink + (1 - shrink) * d / (d + k)
        factor = np.linalg.cholesky((1 - a) * c + a * np.diag(pooled))
        inverse.append(np.linalg.inv(factor))
        log_det.append(np.log(np.diag(factor)).sum())
    return Model(np.array(means), np.array(inverse), np.array(log_det), np.log(n / n.sum()))


VECTOR = "doc_id long, x array<double>"
_VECTOR = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])
SCORED = "doc_id long, score double"
_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_content: bool = False) -> DataFrame:
    small_batches(docs.sparkSession)
    kept = ["content"] if with_content else []

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in rows_of(iter([batch]), "doc_id", "text"):
                yield beside(batch_of([(i, statistics(t or "")) for i, t in zip(ids, texts, strict=True)], _VECTOR), batch, kept)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(content(F.col(text_col)).alias(k) for k in kept))
    return rows.mapInArrow(measure, ", ".join([VECTOR, *(f"{k} binary" for k in kept)]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(measured: DataFrame, labels: DataFrame, label_col: str = "quality") -> Model:
    """From all labelled rows that are not held out; sums are added up by Spark, a row for each class."""
    d = len(FEATURES)
    known = labels.select(F.col("doc_id").alias("of_doc"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1) and of_doc is not null")
    rows = measured.filter(~held_out(F.col("doc_id"))).join(known, F.col("doc_id") == F.col("of_doc")).select("label", *(F.col("x")[i].alias(f"x{i}") for i in range(d)))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    out = {r["label"]: r for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(d)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in pairs)).collect()}
    sums = []
    for c in (0, 1):
        square = np.zeros((d, d))
        if c in out:
            for i, j in pairs:
                square[i, j] = square[j, i] = out[c][f"p{i}_{j}"]
        sums.append((float(out[c]["n"]) if c in out else 0.0, np.array([out[c][f"s{i}"] if c in out else 0.0 for i in range(d)]), square))
    return fit(sums)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, with_content: bool = False) -> DataFrame:
    """Per row: ``doc_id, held_out, score, predicted``, and ``content`` if wanted. Texts are read once and don't move."""
    kept = ["content"] if with_content else []
    measured = written(vectors(docs, id_col, text_col, with_content), "vectors")
    model = train(measured, labels, label_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            yield beside(pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x), pa.float64())], schema=_SCORED), batch, kept)

    scored = measured.mapInArrow(score, ", ".join([SCORED, *(f"{k} binary" for k in kept)]))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *kept)
