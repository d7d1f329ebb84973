"""Every registered query of the engine against its SQL; the others must run and give rows."""

from __future__ import annotations

import pytest

from sentria.plans import registry
from tests.oracle import SF, same


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, name):
    same(spark, registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    rows = registry.QUERIES[name](spark, SF).collect()
    assert rows and not any(r["error"] for r in rows if "error" in r)


def test_entry_imports():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries())
    assert set(registry.SQL) <= set(e.oracle_sql())


def test_entry_without_the_corpus_operators(tmp_path):
    """The corpus folder may be absent as a whole; a part that is broken is an error."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    shutil.copytree(root / "sentria", tmp_path / "sentria", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    ask = [sys.executable, "-c", "import __spark_entry__ as e; print(any(n.startswith('op') or n == 'pipeline' for n in e.queries()), len(e.queries()))"]
    run = lambda: subprocess.run(ask, cwd=tmp_path, capture_output=True, text=True)
    assert run().stdout.split() == ["False", str(len(registry.QUERIES))]
    (tmp_path / "sentria" / "llm").mkdir()
    (tmp_path / "sentria" / "llm" / "__init__.py").write_text("")
    (tmp_path / "sentria" / "llm" / "queries.py").write_text("import no_such_module")
    assert "no_such_module" in run().stderr
