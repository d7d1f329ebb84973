"""Episodes by windows give what the fold row by row gives; and nothing of a place is held in Python, or gathered unasked."""

from __future__ import annotations

import random
from datetime import timedelta

from sentria.operators import episodes
from sentria.plans import fusion_queries
from sentria.schemas import OBSERVATION
from tests.oracle import SF
from tests.test_fusion import P, T0, obs


def test_equals_the_fold(spark):
    """Posts that are repeated and edited, clears that are contradicted, and reports of one moment or at the very end of another's validity."""
    rnd, rows, minute = random.Random(11), [], 0
    for n in range(700):
        minute += rnd.choice([0, 0, 1, 5, 10, 20, 45] + [500] * (n % 60 == 0))
        source = rnd.choice("ABCD")
        rows.append(obs(minute, source, rnd.choice(["threat"] * 3 + ["clear", "clear", "neutralized"]), place=rnd.choice(["p1", "p2"]), ttl=rnd.choice([600, 1200, 1800, 9000]), post=f"{source}/{rnd.choice([n, n // 3])}", role=rnd.choice(["via", "target", None]), kind=rnd.choice(["air.attack_drone", "air.jet_drone", "air.missile"])))
    df, now = spark.createDataFrame(rows, OBSERVATION), T0 + timedelta(minutes=minute + 8)
    found = episodes.assess(df, P, now)
    ready = [r.asDict(True) for r in episodes.usable(df, P, now)[0].filter("stance <> 'neutralized'").orderBy(*episodes.ORDER).collect()]
    fold = episodes.episode_fold(P, now.astimezone().replace(tzinfo=None))
    whole = [x for key in sorted({(r["class"], r["key"]) for r in ready}) for x in fold(iter([r for r in ready if (r["class"], r["key"]) == key]))]
    plain = lambda v: {k: plain(x) for k, x in v.items() if k not in ("geometry", "cells")} if isinstance(v, dict) else [plain(x) for x in v] if isinstance(v, list) else v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v
    text = lambda rows: sorted(repr(sorted(plain(r).items())) for r in rows)
    made = [r.asDict(True) for r in found.assessments.collect()]
    assert text(made) == text(r["assessment"] for r in whole if r["assessment"])
    assert text(r.asDict(True) for r in found.events.collect()) == text(r["event"] for r in whole if r["event"])
    assert {r["status"] for r in made} == {"retracted", "expired", "active"} and max(r["revision"] for r in made) > 5


def test_nothing_is_gathered_unasked(spark):
    plan = fusion_queries.f16_status_by_class(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "collect_list" not in plan and "footprint(" not in plan
