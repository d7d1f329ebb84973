"""The pipeline and its stages against plain Python."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sentria.llm import packing, quality_classifier, secrets
from sentria.llm._shared import table
from tests.llm.test_operators import DOCS, ODD, SF, brute_groups, docs, plain_contamination

SMALL = SF.replace("sf0.001", "sf0.01")
STAGE = dict(corpus_pipeline.STAGES)


def plain_statistics(text):
    """The classifier's vector by its definition."""
    share = lambda test: sum(map(test, text)) / max(1, len(text))
    words, lines = text.split(), [x for x in text.split("\n") if x]
    grams = [tuple(words[i : i + 4]) for i in range(len(words) - 3)]
    new = lambda xs: len(set(xs)) / len(xs) if xs else 1.0
    return [
        math.log1p(len(text)), math.log1p(len(words)), math.log1p(sum(map(len, words)) / max(1, len(words))), math.sqrt(share(lambda c: c in "#*$%&|<>")), math.sqrt(share(lambda c: "A" <= c <= "Z")),
        math.sqrt(share(lambda c: c in "!?")), math.sqrt(share(lambda c: c == "|")), math.sqrt(share(lambda c: c in "0123456789")), math.sqrt(share(lambda c: c in ".,;:")),
        new(words) if words else 0.0, 1 - new(lines), 1 - new(grams), math.log1p(max(1, len(words)) / max(1, len(lines))),
        math.sqrt(len(re.findall(r"[#*$%&|<>!]{2,}(?:\s|$)", text)) / max(1, len(words))), math.sqrt(sum(w.isupper() for w in words) / max(1, len(words))),
    ]


def plain_scores(texts, ids, labels):
    """Log-density differences of two normal distributions, shrunk as documented, by the textbook formula."""
    x = np.array([plain_statistics(t) for t in texts])
    label = dict(labels)
    known = [label.get(i) if zlib.crc32(str(i).encode()) % 4 != 2 else None for i in ids]
    d, parts = x.shape[1], [x[[k == c for k in known]] for c in (0, 1)]
    cov = [np.cov(p.T, bias=True) for p in parts]
    pooled = np.diag(sum(len(p) * c for p, c in zip(parts, cov, strict=True)) / sum(map(len, parts))) + 1e-4
    log = []
    for p, c in zip(parts, cov, strict=True):
        a = 0.1 + 0.9 * d / (d + len(p))
        s = (1 - a) * c + a * np.diag(pooled)
        diff = x - p.mean(0)
        log.append(-0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(s), diff) - 0.5 * np.linalg.slogdet(s)[1] + math.log(len(p)))
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -30, 30)))


@pytest.fixture(scope="module")
def sample(spark):
    rows = table(spark, SMALL, "documents").collect()
    items = [(r["item_id"], r["text"]) for r in table(spark, SMALL, "benchmark").collect()]
    labels = [(r["doc_id"], r["quality"]) for r in table(spark, SMALL, "labels").collect()]
    return rows, items, labels


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_statistics_by_definition(sample):
    for text in [r["text"] or "" for r in sample[0]] + [t or "" for t in ODD]:
        assert np.allclose(quality_classifier.statistics(text), plain_statistics(text)), text[:80]


def test_quality(spark, sample):
    rows, _, labels = sample
    scores = plain_scores([r["text"] or "" for r in rows], [r["doc_id"] for r in rows], labels)
    kept = STAGE["quality"](spark, table(spark, SMALL, "documents"), SMALL)
    assert ids(kept) == sorted(r["doc_id"] for r, s in zip(rows, scores, strict=True) if s >= 0.7)
    label = dict(labels)
    good = [r["doc_id"] for r in rows if label.get(r["doc_id"]) == 1]
    assert len(set(good) - set(ids(kept))) <= 0.02 * len(good)


def test_near_duplicates(spark, sample):
    rows = sorted(sample[0], key=lambda r: r["doc_id"])[:400]
    groups, _ = brute_groups([r["text"] for r in rows])
    own = table(spark, SMALL, "documents").filter(F.col("doc_id") <= rows[-1]["doc_id"])
    assert ids(STAGE["near_duplicates"](spark, own, SMALL)) == sorted(rows[g]["doc_id"] for g in set(groups))


def test_decontamination(spark, sample):
    rows, items, _ = sample
    first = lambda t: {tuple(w[i : i + 13]) for w in [re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")] for i in range(max(1, len(w) - 12))}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    windows = set().union(*(first((t or "").translate(lower)) for _, t in items)) - {()}
    short = [w for w in windows if len(w) < 13]
    assert not short
    leaks = {r["doc_id"] for r in rows if first((r["text"] or "").translate(lower)) & windows}
    kept = ids(STAGE["decontamination"](spark, table(spark, SMALL, "documents"), SMALL))
    assert leaks and kept == sorted({r["doc_id"] for r in rows} - leaks)
    assert {r["doc_id"] for r in rows[:60] if plain_contamination(r["text"], items)[1]} == leaks & {r["doc_id"] for r in rows[:60]}


def test_one_window_in_a_long_document_is_enough(spark, sample):
    item = next(t for _, t in sample[1] if len(t.split()) >= 13)
    filler = " ".join(f"filler{i}" for i in range(3000))
    leaked = docs(spark, f"{filler} {item} {filler}", filler, item.upper().replace(" ", ", "))
    assert ids(STAGE["decontamination"](spark, leaked, SMALL)) == [1]


def test_secret_scans(spark, sample):
    kept = {r["doc_id"]: r for r in STAGE["secret_scans"](spark, table(spark, SMALL, "documents"), SMALL).collect()}
    changed = 0
    for r in sample[0]:
        text = r["text"]
        for start, end, _ in reversed(merged(secrets.find_secrets(text or "")[1])):
            text = text[:start] + "[SECRET]" + text[end:]
        assert kept[r["doc_id"]]["text"] == text
        assert kept[r["doc_id"]]["n_chars"] == (r["n_chars"] if text == r["text"] else len(text))
        changed += text != r["text"]
    assert changed and len(kept) == len(sample[0])


def merged(spans):
    out = []
    for start, end, kind in spans:
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]), kind)
        else:
            out.append((start, end, kind))
    return out


def test_packing(spark, sample):
    lengths = {r["doc_id"]: len(packing.token_ids(r["text"] or "")) + 1 for r in sample[0]}
    out = STAGE["packing"](spark, table(spark, SMALL, "documents"), SMALL).toPandas()
    assert out.groupby("doc_id")["length"].sum().to_dict() == lengths
    assert (out.groupby("sequence_id")["length"].sum() <= 2048).all()


CLASHING = ["rejected", "rejected_id", "all_rejected", "rejected_content", "own_content", "content", "sig", "path", "is_first", "shared_id", "dropped_id", "own_sig", "blob", "is_dirty", "blob_of_text", "spans", "hits", "predicted", "label", "n_hit", "piece", "used"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, name):
    """Nulls in every column, odd texts, repeated rows, shared ids, clashing columns, an empty table."""
    good = " ".join(f"word{i} of a sentence that is fine," for i in range(40)) + "."
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(ODD)] + [(None, None, None, None, None), (3, good, None, "s", len(good)), (3, good, None, "s", len(good)), (None, good + " token=abcdef123", "en", None, None)]
    frame = spark.createDataFrame(rows, DOCS).select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHING)))
    out = STAGE[name](spark, frame, SMALL)
    got = out.collect()
    if name == "packing":
        assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and len(got) >= len(rows)
    else:
        assert out.columns == frame.columns
        count = Counter((r["doc_id"], r["text"]) for r in got)
        if name == "near_duplicates":
            assert set(count.values()) == {1} and len({(r["text"] or "").strip() for r in got}) == len(got)
        elif name in ("decontamination", "secret_scans"):
            assert len(got) == len(rows)
            assert name == "decontamination" or (None, good + " [SECRET]") in count
    assert STAGE[name](spark, frame.limit(0), SMALL).count() == 0


def test_run(spark, sample):
    out = corpus_pipeline.run(spark, SMALL).toPandas()
    docs_ = table(spark, SMALL, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_ = spark.createDataFrame(stage(spark, docs_, SMALL).collect(), docs_.schema)
    assert sorted(set(out["doc_id"])) == ids(docs_)
    lengths = {r["doc_id"]: len(packing.token_ids(r["text"] or "")) + 1 for r in docs_.collect()}
    assert out.groupby("doc_id")["length"].sum().to_dict() == lengths
