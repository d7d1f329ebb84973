"""Scenarios of episodes and tracks, and independence of input order."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sentria.functions import h3grid
from sentria.operators import episodes, tracks
from sentria.params import CLASSES, UnknownPolicy, policy
from sentria.plans import registry
from sentria.schemas import OBSERVATION
from tests.oracle import rows, tables

T0 = datetime(2024, 5, 1, 12, 0, tzinfo=timezone.utc)
P = policy("fusion.v1")


def obs(minute, source="A", stance="threat", kind="air.attack_drone", place="p1", post=None, count=None, ttl=1800, at=(30.5, 50.4), role=None, statement=0, geometry=None):
    post = post or f"{source}/{minute}"
    g = geometry or {"type": "point", "coordinates": list(at), "rings": None, "resolution": None, "cells": None}
    g = tuple(g[k] for k in ("type", "coordinates", "rings", "resolution", "cells"))
    return (f"s:{source}", kind, stance, count, T0 + timedelta(minutes=minute), g, ttl, None, (post, "u", "n", [], place, place, role, statement, 0))


def assess(spark, rows, minute=240):
    df = spark.createDataFrame(rows, OBSERVATION)
    out = episodes.assess(df, P, T0 + timedelta(minutes=minute))
    a = [r.asDict(True) for r in out.assessments.collect()]
    e = [r.asDict(True) for r in out.events.collect()]
    return sorted(a, key=lambda r: (r["valid_from"], r["assessment_id"])), sorted(e, key=lambda r: (r["effective_at"], r["assessment_id"], r["seq"])), [tuple(r) for r in out.skipped.collect()]


def kinds(events):
    return [e["kind"] for e in events]


def test_one_report_and_its_expiry(spark):
    a, e, _ = assess(spark, [obs(0)], 29)
    assert [(x["status"], x["revision"], x["likelihood"], x["proximity"]) for x in a] == [("active", 1, "moderate", "target")]
    a, e, _ = assess(spark, [obs(0)], 30)
    assert a[0]["status"] == "expired" and kinds(e) == ["issued", "expired"] and a[0]["active_sources"] == []
    assert assess(spark, [obs(0)], -1)[:2] == ([], [])


def test_renewal_is_inclusive_and_late_reports_open_anew(spark):
    a, e, _ = assess(spark, [obs(0), obs(30), obs(61)])
    assert [x["revision"] for x in a] == [2, 1] and kinds(e) == ["issued", "superseded", "expired", "issued", "expired"]


def test_all_clears(spark):
    both = [obs(0), obs(2, "B")]
    a, e, _ = assess(spark, [*both, obs(4, "A", "clear")], 20)
    assert a[0]["status"] == "active" and a[0]["active_sources"] == ["s:B"] and kinds(e) == ["issued", "superseded"]
    a, e, _ = assess(spark, [*both, obs(4, "A", "clear"), obs(7, "B", "clear")], 20)
    assert a[0]["status"] == "retracted" and e[-1]["reason"] == "source_all_clear" and a[0]["corroboration_count"] == 0
    a, _, _ = assess(spark, [*both, obs(4, "A", "clear"), obs(6)], 20)
    assert (a[0]["revision"], a[0]["likelihood"]) == (3, "high")
    a, _, _ = assess(spark, [obs(0), obs(20, "B"), obs(35, "A", "clear")], 40)
    assert a[0]["status"] == "active"


@pytest.mark.parametrize("clear", [obs(5, "A", "clear", place="p2"), obs(5, "A", "clear", kind="air.missile"), obs(-5, "A", "clear"), obs(5, "C", "clear"), obs(5, "A", "neutralized")])
def test_clears_that_do_not_count(spark, clear):
    assert assess(spark, [obs(0), clear], 20)[0][0]["status"] == "active"


def test_contradicted_clear(spark):
    a, _, _ = assess(spark, [obs(0), obs(5, "A", "clear", post="A/x"), obs(5, "A", post="A/x")], 20)
    assert [x["status"] for x in a] == ["active"]


def test_skips(spark):
    empty = {"type": "cells", "coordinates": None, "rings": None, "resolution": 6, "cells": []}
    _, _, s = assess(spark, [obs(0, geometry=empty), obs(1, place="ua-adm1:UA1"), obs(999)])
    assert sorted(s) == [("A/0", "invalid_geometry"), ("A/1", "region")]


def test_via_then_aimed(spark):
    a, _, _ = assess(spark, [obs(0, role="via")], 10)
    assert a[0]["proximity"] == "nearby"
    a, _, _ = assess(spark, [obs(0, role="via"), obs(1)], 10)
    assert (a[0]["proximity"], a[0]["revision"]) == ("target", 2)


def test_order_does_not_matter(spark):
    rows = [obs(i, "ABC"[i % 3], ("threat", "threat", "clear")[i % 3], count=i % 4 or None) for i in range(0, 60, 4)]
    assert assess(spark, rows) == assess(spark, rows[::-1])
    assert follow(spark, rows) == follow(spark, rows[::-1])


def test_unknown_policy():
    with pytest.raises(UnknownPolicy):
        policy("fusion.v0")


def follow(spark, rows, minute=30):
    t, e = tracks.follow(spark.createDataFrame(rows, OBSERVATION), P, T0 + timedelta(minutes=minute))
    return sorted((r["track_id"], r["status"], r["motion"], len(r["path"]), r["count_unknown"]) for r in t.collect()), sorted((r["track_id"], r["seq"], r["kind"]) for r in e.collect())


def test_counts_start_and_end_tracks(spark):
    t, e = follow(spark, [obs(0, count=4)])
    assert [x[1:3] for x in t] == [("active", "heading")] * 4 and [x[2] for x in e] == ["started"] * 4
    t, _ = follow(spark, [obs(0, count=4), obs(5, "B", "neutralized", count=1)])
    assert sorted(x[1] for x in t) == ["active"] * 3 + ["neutralized"]
    t, _ = follow(spark, [obs(0), obs(5, "B", "neutralized", count=1)])
    assert [x[1] for x in t] == ["active"] and t[0][4]


def test_track_clears_and_age(spark):
    assert follow(spark, [obs(0), obs(5, "A", "clear")])[0][0][1] == "cleared"
    assert follow(spark, [obs(0), obs(5, "B", "clear")])[0][0][1] == "active"
    assert follow(spark, [obs(0)], 61)[0][0][1] == "quiet"
    t, e = follow(spark, [obs(0)], 421)
    assert t[0][1] == "stale" and [x[2] for x in e] == ["started", "quiet", "stale"]
    t, e = follow(spark, [obs(0), obs(70)], 71)
    assert t[0][1] == "active" and [x[2] for x in e] == ["started", "quiet", "moved"]


def test_reach(spark):
    far = (31.9, 51.1)  # some 125 km away
    assert len(follow(spark, [obs(0), obs(40, "B", place="p2", at=far)], 41)[0]) == 1
    assert len(follow(spark, [obs(0), obs(5, "B", place="p2", at=far)], 41)[0]) == 2


def test_track_cells(spark):
    t, _ = tracks.follow(spark.createDataFrame([obs(0), obs(1, "B", "clear", place="x")], OBSERVATION), P, T0 + timedelta(minutes=5))
    row = tracks.with_cells(t, P, T0 + timedelta(minutes=5)).first()
    assert len(row["cells"]["cells"]) > 20 and row["region_cells"]["cells"] == []


def test_order_returns_every_row(spark, monkeypatch):
    monkeypatch.setattr("tests.oracle.SF", "/root/testdata/sf0.01")
    every = tables().execute(registry.SQL["F07_order"].removesuffix(" WHERE n <= 100")).df()
    got = registry.QUERIES["F07_order"](spark, "/root/testdata/sf0.01").toPandas()
    assert every["n"].max() > 100 and rows(got) == rows(every)


def test_islands_cut_the_walk_and_change_nothing(spark):
    """Silences of six hours and more cut a class; results equal those of one walk over all its reports."""
    rnd = random.Random(4)
    minute, rows = 0, []
    for n in range(120):
        minute += rnd.choice([1, 5, 30, 90, 359, 360, 361, 900])
        rows.append(obs(minute, "ABC"[n % 3], rnd.choice(["threat", "threat", "clear", "neutralized"]), place=f"p{rnd.randint(0, 3)}", at=(30.5 + rnd.randint(0, 3) / 2, 50.4), count=rnd.choice([None, 1, 2])))
    df, now = spark.createDataFrame(rows, OBSERVATION), T0 + timedelta(minutes=minute + 45)
    cut = tracks.islands(df, P.tracks)
    assert cut.agg(F.max("island")).first()[0] >= 5
    t, e = tracks.follow(df, P, now)
    seen = tracks.with_contradictions(tracks.reports(df, P)).orderBy("observed_at", "source_id", "evidence_id", "statement", "alone", "turn")
    order = [r.asDict(True) for r in seen.collect()]
    whole = list(tracks.track_fold(P, now.astimezone().replace(tzinfo=None))(iter(order)))
    assert sorted(r["track_id"] + r["status"] + str(len(r["path"])) for r in t.collect()) == sorted(r["track"]["track_id"] + r["track"]["status"] + str(len(r["track"]["path"])) for r in whole if r["track"])
    assert sorted((r["track_id"], r["seq"], r["kind"]) for r in e.collect()) == sorted((r["event"]["track_id"], r["event"]["seq"], r["event"]["kind"]) for r in whole if r["event"])


def walks_as_one(spark, rows, now):
    """``follow`` against one walk over all reports of each class; gives the groups that were dealt."""
    df = spark.createDataFrame(rows, OBSERVATION)
    t, e = tracks.follow(df, P, now)
    seen = tracks.with_contradictions(tracks.reports(df, P)).orderBy("class", "observed_at", "source_id", "evidence_id", "statement", "alone", "turn")
    order = [r.asDict(True) for r in seen.collect()]
    fold = tracks.track_fold(P, now.astimezone().replace(tzinfo=None))
    whole = [x for c in CLASSES for x in fold(iter([r for r in order if r["class"] == c]))]
    told = lambda r: (r["track_id"], r["status"], r["position"]["id"], r["target"] and r["target"]["id"], len(r["path"]), len(r["evidence"]))
    assert sorted(map(told, t.collect()), key=str) == sorted((told(r["track"]) for r in whole if r["track"]), key=str)
    assert sorted((r["track_id"], r["seq"], r["kind"], r["effective_at"].replace(tzinfo=None)) for r in e.collect()) == sorted((r["event"]["track_id"], r["event"]["seq"], r["event"]["kind"], r["event"]["effective_at"].replace(tzinfo=None)) for r in whole if r["event"])
    return tracks.dealt(df, P).groupBy("class", "cluster", "island").count().collect()


def test_clusters_cut_a_class_without_silences(spark):
    """Reports every few minutes, in places of which some are within reach of each other: more walks than classes."""
    rnd = random.Random(6)
    rows, minute = [], 0
    # three pairs of neighbours, far from each other, on both sides of the date line and near a pole
    at = {f"p{n}": (lon, lat) for n, (lon, lat) in enumerate([(30.5, 50.4), (31.2, 50.4), (179.9, 10.0), (-179.9, 10.3), (0.0, 89.8), (180.0, 89.9)])}
    for n in range(260):
        minute += rnd.choice([0, 1, 5, 20, 70])
        place = rnd.choice(sorted(at))
        rows.append(obs(minute, "ABC"[n % 3], rnd.choice(["threat", "threat", "threat", "clear", "neutralized"]), place=place, at=at[place], kind=rnd.choice(["air.guided_bomb", "air.guided_bomb", "air.ballistic_missile"]), count=rnd.choice([None, 1, 2]), post=f"{'ABC'[n % 3]}/{n // 2}"))
    groups = walks_as_one(spark, rows, T0 + timedelta(minutes=minute + 45))
    bombs = {r["cluster"] for r in groups if r["class"] == "bomb"}
    # statements of two places link clusters; without these, each pair is one
    assert len(groups) > len({r["class"] for r in groups}) and len({r["cluster"] for r in groups if r["class"] == "missile"}) >= 1 and 1 <= len(bombs) <= 3


@pytest.mark.parametrize(("links", "expected"), [
    ([("a", 30, 50, "a"), ("b", 31, 50, "b"), ("c", 60, 50, "c")], [{"a", "b"}, {"c"}]),
    ([("a", 179.9, 0, "a"), ("b", -179.9, 0, "b"), ("c", 0, 90, "c"), ("d", 180, 89.9, "d")], [{"a", "b"}, {"c", "d"}]),
    ([("a", 30, 50, "z"), ("z", 90, 10, "z"), ("c", 60, 50, "c")], [{"a", "z"}, {"c"}]),
    ([("a", 30, 50, "q"), ("c", 60, 50, "q")], [{"a", "c", "q"}]),
])
def test_connected_places(links, expected):
    rows = [{"id": i, "spot": {"lon": float(x), "lat": float(y), "radius_km": 10.0}, "other": o, "kind": "air.guided_bomb"} for i, x, y, o in links]
    found = tracks.connected(rows, P.tracks)
    groups = {}
    for i, root in found.items():
        groups.setdefault(root, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected)) and all(root == min(g) for root, g in groups.items())
    # kinds without a speed meet in place only
    alone = tracks.connected([r | {"kind": "air.ballistic_missile"} for r in rows], P.tracks)
    assert all((alone[i] == alone[o]) for i, _, _, o in links) and len(set(alone.values())) >= len(groups)


def test_islands_of_episodes(spark):
    rnd = random.Random(5)
    minute, rows = 0, []
    for n in range(150):
        minute += rnd.choice([1, 10, 29, 30, 31, 200, 400, 800])
        rows.append(obs(minute, "AB"[n % 2], rnd.choice(["threat", "threat", "clear"]), place="p1", ttl=rnd.choice([600, 1800, 30000])))
    df, now = spark.createDataFrame(rows, OBSERVATION), T0 + timedelta(minutes=minute + 10)
    ready = episodes.usable(df, P, now)[0]
    assert episodes.with_islands(ready).agg(F.max("island")).first()[0] >= 3
    found = episodes.assess(df, P, now)
    whole = list(episodes.episode_fold(P, now.astimezone().replace(tzinfo=None))(iter(r.asDict(True) for r in ready.orderBy(*episodes.ORDER).collect())))
    assert sorted((r["assessment_id"], r["status"], r["revision"]) for r in found.assessments.collect()) == sorted((r["assessment"]["assessment_id"], r["assessment"]["status"], r["assessment"]["revision"]) for r in whole if r["assessment"])
    assert sorted((r["assessment_id"], r["seq"], r["kind"]) for r in found.events.collect()) == sorted((r["event"]["assessment_id"], r["event"]["seq"], r["event"]["kind"]) for r in whole if r["event"])
    assert all(len(r["cells"]["cells"]) > 5 for r in found.assessments.collect())


def cells_of(df):
    return {r["position"]["id"]: (len(r["cells"]["cells"]), len(r["region_cells"]["cells"]), r["status"]) for r in df.collect()}


def test_cells_of_tracks(spark):
    """Discs that grow with time, corridors to a target, regions, and tracks that ended."""
    middle = h3grid.cell_of(31.0, 50.5, 6)
    region = {"type": "cells", "coordinates": None, "rings": None, "resolution": 6, "cells": sorted(map(h3grid.text_of, h3grid.disk([middle], 1)))}
    now = T0 + timedelta(minutes=30)
    follow_ = lambda *rows: cells_of(tracks.with_cells(tracks.follow(spark.createDataFrame(rows, OBSERVATION), P, now)[0], P, now))
    at_once, later = follow_(obs(29)), follow_(obs(0))
    assert 20 < at_once["p1"][0] < later["p1"][0] and at_once["p1"][1:] == (0, "active")
    # a region has no cells of its own but those of the region and a ring
    assert follow_(obs(0, place="ua-adm1:UA1", geometry=region)) == {"ua-adm1:UA1": (0, 19, "active")}
    assert assess(spark, [obs(0, place="ua-adm1:UA1", geometry=region)])[2] == [("A/0", "region")]
    # from a place into a region: the place's disc, and the region
    both = follow_(obs(0, role="via", post="A/x"), (*obs(0, place="ua-adm1:UA1", post="A/x", geometry=region)[:8], ("A/x", "u", "n", [], "ua-adm1:UA1", "ua-adm1:UA1", None, 0, 1)))
    assert both["p1"][0] > 20 and both["p1"][1] == 19
    # towards another place: a corridor, which holds more than the disc
    aimed = follow_(obs(0, role="via", post="A/y"), (*obs(0, place="p9", post="A/y", at=(31.6, 51.0))[:8], ("A/y", "u", "n", [], "p9", "p9", None, 0, 1)))
    assert aimed["p1"][0] > later["p1"][0] + 10
    assert follow_(obs(0), obs(5, "A", "clear"))["p1"] == (0, 0, "cleared")


def test_skipped_rows_in_order(spark):
    bad = {"type": "point", "coordinates": [300.0, 50.0], "rings": None, "resolution": None, "cells": None}
    rows = [obs(3, post="c"), obs(2, post="b", geometry=bad), obs(1, post="b", place="ua-adm1:UA30"), obs(4, post="a", place="ua-adm1:UA30"), obs(5, post="b", geometry=bad)]
    skipped = episodes.usable(spark.createDataFrame(rows, OBSERVATION).repartition(3), P, T0 + timedelta(minutes=60))[1]
    expected = [("a", "region"), ("b", "invalid_geometry"), ("b", "invalid_geometry"), ("b", "region")]
    assert [tuple(r) for r in episodes.skipped_in_order(skipped).collect()] == expected
    assert episodes.skipped_in_order(skipped.limit(0)).collect() == []
