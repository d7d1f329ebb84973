"""Words are dealt by the amount of text, and a region's circle is found once."""

from __future__ import annotations

import json

from sentria.operators import role_reader, tracks
from sentria.operators.vocabulary import parse_lexicon
from sentria.plans import reader_queries as R
from tests.oracle import SF


def test_tasks_follow_the_texts(spark, monkeypatch):
    """Twice the texts, twice the tasks: what one of them sorts doesn't grow."""
    lexicon, posts = parse_lexicon(R.LEXICON), R.evidence(spark, SF).limit(30)
    chars = sum(len(r["text"]) for r in posts.collect() if r["text"] and len(r["text"]) <= role_reader.MAX_TEXT_CHARS)
    said = lambda: role_reader.marked_words(role_reader.split_words(posts), lexicon)
    rows = lambda df: sorted(json.dumps(r.asDict(), default=str, sort_keys=True) for r in df.drop("post").collect())
    few = rows(said())
    monkeypatch.setattr(role_reader, "TASK_CHARS", chars // 16)
    many = said()
    assert many.rdd.getNumPartitions() >= 16 and rows(many) == few


def test_a_region_is_measured_once(monkeypatch):
    calls, centroid = [], tracks.shapes.centroid
    monkeypatch.setattr(tracks.shapes, "centroid", lambda *a: calls.append(a) or centroid(*a))
    tracks._circle.cache_clear()
    cells = ("861e63bb7ffffff", "861e63b97ffffff")
    assert tracks._circle(cells) == tracks._circle(tuple(list(cells))) and len(calls) == 1
    assert tracks._circle(None) == tracks._circle(("no",)) == tracks._circle(()) == (None, None, None)


def test_pages_are_parsed_once_for_both_walks(spark):
    from sentria.plans import source_queries

    plan = source_queries.s06_s15_walk(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("Relation [") == 2
