"""Walks on columns give what the walk report by report gives, and need neither paths nor evidence."""

from __future__ import annotations

import random
from datetime import timedelta

from sentria.operators import tracks
from sentria.params import CLASSES
from sentria.schemas import OBSERVATION
from tests.test_fusion import P, T0, obs


def reported(seed: int, n: int) -> tuple[list, int]:
    """Statements of one and two places, of which some are passed by, in towns within reach of each other and a region; edited posts; silences."""
    rnd, rows, minute = random.Random(seed), [], 0
    at = {f"p{i}": (30.5 + i / 2, 50.4) for i in range(4)}
    for i in range(n):
        minute += rnd.choice([0, 0, 1, 1, 2, 5, 31, 62, 130] + [400] * (i % 40 == 0))
        source, stance, count = rnd.choice("ABC"), rnd.choice(["threat"] * 5 + ["clear", "neutralized"]), rnd.choice([None, 0, 1, 2, 3])
        post, kind = f"{source}/{i if i % 9 else i // 18}", rnd.choice(["air.attack_drone", "air.jet_drone", "air.missile", "air.ballistic_missile", "air.guided_bomb"])
        for order, place in enumerate(rnd.sample(sorted(at), rnd.choice([1, 1, 2]))):
            row = list(obs(minute, source, stance, place=place, at=at[place], kind=kind, count=count, post=post, role=rnd.choice(["via", "target", None])))
            row[8] = (*row[8][:7], rnd.choice([0, 0, 0, None]) if order == 0 else 0, order)
            rows.append(tuple(row))
    return rows, minute


def test_equals_the_walk_by_reports(spark):
    rows, minute = reported(7, 500)
    df, now = spark.createDataFrame(rows, OBSERVATION), T0 + timedelta(minutes=minute + 40)
    found, log = tracks.follow(df, P, now)
    seen = tracks.with_contradictions(tracks.reports(df, P)).orderBy("class", "observed_at", "source_id", "evidence_id", "statement", "alone", "turn")
    held = [r.asDict(True) for r in seen.collect()]
    fold = tracks.track_fold(P, now.astimezone().replace(tzinfo=None))
    whole = [x for c in CLASSES for x in fold(iter([r for r in held if r["class"] == c]))]
    plain = lambda v: {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else [plain(x) for x in v] if isinstance(v, list) else v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v
    text = lambda rows: sorted(repr(sorted(plain(r).items())) for r in rows)
    every = [r.asDict(True) for r in found.collect()]
    assert text(every) == text(r["track"] for r in whole if r["track"]) and len(every) > 100
    assert {r["status"] for r in every} == {"active", "cleared", "neutralized", "stale"} | {r["status"] for r in every}
    assert text(r.asDict(True) for r in log.collect()) == text(r["event"] for r in whole if r["event"])
    ended = [r.asDict(True) for r in tracks.ended(df, P, now).collect()]
    steps = lambda rows, size: sorted((r["track_id"], r["status"], r["first_at"], size(r)) for r in rows)
    assert steps(ended, lambda r: r["steps"]) == steps(every, lambda r: len(r["path"]))


def test_ends_carry_no_histories(spark):
    """What grows with a track's life is not kept by a walk, nor sent by it."""
    df = spark.createDataFrame(reported(8, 20)[0], OBSERVATION)
    assert not {"path", "evidence"} & set(tracks.ended(df, P, T0).columns)
    assert {"path", "evidence"} <= set(tracks.follow(df, P, T0)[0].columns)
