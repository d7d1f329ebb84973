"""The ledger over time, and blobs that many paths hold."""

from __future__ import annotations

from sentria.llm import secrets
from sentria.llm._shared import fresh_dir
from tests.llm.test_operators import docs


def found(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_findings_reach_every_version_of_every_path(spark):
    ledger = fresh_dir(spark, "t")
    first = docs(spark, "token=abcdef", "clean", "token=abcdef", "old secret: 123456", ids=[1, 2, 3, 4])
    secrets.scan_secrets(first, ledger)
    # 1 loses its secret, 2 gets an old one, 4 is deleted, 5 is new
    second = docs(spark, "clean", "token=abcdef", "token=abcdef", "clean", ids=[1, 2, 3, 5])
    assert found(secrets.scan_secrets(second, ledger), "doc_id", "n_assign") == [(1, 0), (2, 1), (3, 1), (5, 0)]
    assert secrets.ledger_of(first, ledger).count() == 3  # nothing was scanned twice
    assert found(secrets.history(first, ledger), "doc_id", "batch", "spans") == [
        (1, 1, "assign:0:12"), (1, 2, ""), (2, 1, ""), (2, 2, "assign:0:12"), (3, 1, "assign:0:12"), (4, 1, "assign:4:18"), (5, 2, ""),
    ]
    assert found(secrets.scan_secrets(second, ledger), "doc_id", "n_assign") == [(1, 0), (2, 1), (3, 1), (5, 0)]
    assert secrets.versions_of(first, ledger).count() == 7
    assert secrets.history(first, fresh_dir(spark, "none")).count() == 0


def test_hot_blobs(spark, monkeypatch):
    monkeypatch.setattr(secrets, "HOT", 3)
    rows = docs(spark, *["token=abcdef"] * 6, *["clean"] * 5, "passwd: hunter22", None, ids=[*range(11), None, 11])
    clashing = rows.selectExpr("*", "1 as blob", "2 as batch", "3 as hot_blob")
    ledger = fresh_dir(spark, "t")
    got = secrets.scan_secrets(clashing, ledger)
    assert sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["n_assign"]) for r in got.collect()) == [(-1, 1), *((i, 1) for i in range(6)), *((i, 0) for i in range(6, 12))]
    assert secrets.history(rows, ledger).filter("n_assign = 1").count() == 7
    assert secrets.scan_secrets(clashing.limit(0), ledger).count() == 0
