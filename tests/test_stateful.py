"""Logs as streams: equal to the batch operators on input in order, corrections of what comes late, state that goes."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sentria.operators import episodes, tracks
from sentria.schemas import OBSERVATION
from sentria.streaming import stateful
from tests.test_fusion import T0, P, obs

FLAT = "class string, key string, source_id string, evidence_id string, observed_at timestamp, ttl int, stance string"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, folder, schema, batches, log, name):
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}-in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}-in")
    log(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/{name}-c").outputMode("append").trigger(availableNow=True).start().awaitTermination(240)
    return spark.table(name).collect()


def in_batches(rows, n):
    """Posts of one moment stay together."""
    size = -(-len(rows) // n)
    out, rows = [], sorted(rows, key=lambda r: r[4])
    while rows:
        cut = min(size, len(rows))
        while cut < len(rows) and rows[cut][4] == rows[cut - 1][4]:
            cut += 1
        out.append(rows[:cut])
        rows = rows[cut:]
    return out


def told(rows):
    return sorted((r["log_id"], r["seq"], r["kind"], r["at_us"], r["evidence_id"]) for r in rows)


def micros(at):
    at = at if at.tzinfo else at.astimezone(timezone.utc)
    return (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def history(seed, n):
    rnd = random.Random(seed)
    rows, minute = [], 0
    for i in range(n):
        minute += rnd.choice([0, 1, 3, 10, 25, 40])
        source = "ABC"[i % 3]
        rows.append(obs(minute, source, rnd.choice(["threat", "threat", "threat", "clear", "clear", "neutralized"]), place=f"p{rnd.randrange(2)}", at=(30.5 + rnd.randrange(3) / 3, 50.4), ttl=rnd.choice([1800, 10800]), post=f"{source}/{minute}", count=rnd.choice([None, 1, 2]), kind=rnd.choice(["air.attack_drone", "air.guided_bomb"])))
    return rows, minute


def test_event_log_equals_the_batch(rocks, tmp_path):
    rows, minute = history(3, 60)
    end = T0 + timedelta(minutes=minute + 300)
    batch = episodes.assess(rocks.createDataFrame(rows, OBSERVATION), P, end - timedelta(minutes=10)).events.collect()
    ready, _ = episodes.usable(rocks.createDataFrame(rows, OBSERVATION), P, end)
    keyed = {(r["source_id"], r["evidence_id"], r["class"], r["key"]) for r in ready.select("source_id", "evidence_id", "class", "key").collect()}
    classes = {"air.attack_drone": "drone", "air.guided_bomb": "bomb"}
    flat = [(classes[r[1]], r[8][4], r[0], r[8][0], r[4], r[6], r[2]) for r in rows]
    assert all((r[2], r[3], r[0], r[1]) in keyed for r in flat)
    # a last report elsewhere moves the watermark on
    got = run(rocks, tmp_path, FLAT, [*in_batches(flat, 4), [("drone", "far", "s:Z", "Z/1", end, 60, "threat")]], lambda s: stateful.event_log(s, P), "episode_log")
    assert told([r for r in got if "/far/" not in r["log_id"]]) == sorted((r["assessment_id"], r["seq"], r["kind"], micros(r["effective_at"]), r["evidence"] and r["evidence"]["evidence_id"]) for r in batch)
    assert {r["reason"] for r in got} == {None, "source_all_clear"} and {"issued", "superseded", "expired"} <= {r["kind"] for r in got}


def test_late_rows_are_corrected(rocks, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    row = lambda m, source, stance="threat", ttl=1800, key="p": ("drone", key, f"s:{source}", f"{source}/{m}", at(m), ttl, stance)
    batches = [[row(0, "A"), row(20, "A")], [row(10, "B")], [row(22, "C", "clear"), row(5, "A", "clear")], [row(60, "A", "clear"), row(70, "B", "clear"), row(110, "C")], [row(100, "D", ttl=60)], [row(100, "E", key="q"), row(105, "E", "clear", key="q")], [row(90, "F", ttl=60, key="q"), row(101, "G", key="q")], [row(400, "A")]]
    got = run(rocks, tmp_path, FLAT, batches, lambda s: stateful.event_log(s, P, "2 hours"), "late_log")
    log = lambda end: [(r["kind"], r["evidence_id"], r["reason"]) for r in sorted(got, key=lambda r: r["seq"]) if r["log_id"].endswith(end)]
    assert log("/p/A/0") == [("issued", "A/0", None), ("superseded", "A/20", None), ("corrected", "B/10", "late_report"), ("corrected", "A/5", "late_all_clear"), ("expired", None, None)]
    # late for its own time, but the assessment that is open speaks for the place
    assert log("/p/C/110") == [("issued", "C/110", None), ("corrected", "D/100", "late_report"), ("expired", None, None)]
    # over before the last thing known: told by the log that closed; not over: an assessment of its own
    assert log("/q/E/100") == [("issued", "E/100", None), ("retracted", "E/105", "source_all_clear"), ("corrected", "F/90", "late_report")] and log("/q/G/101") == [("issued", "G/101", "late_report"), ("expired", None, None)]
    assert all([r["seq"] for r in sorted(got, key=lambda r: r["seq"]) if r["log_id"] == i] == list(range(1, 1 + sum(r["log_id"] == i for r in got))) for i in {r["log_id"] for r in got})


@pytest.mark.parametrize("seed", [5, 8])
def test_track_log_equals_the_batch(rocks, tmp_path, seed):
    rows, minute = history(seed, 50)
    end = T0 + timedelta(minutes=minute + 700)
    _, events = tracks.follow(rocks.createDataFrame(rows, OBSERVATION), P, end - timedelta(minutes=10))
    last = obs(minute + 700, "Z", place="far", at=(-100.0, 10.0), kind="air.missile", post="Z/1")
    got = run(rocks, tmp_path, OBSERVATION, [*in_batches(rows, 4), [last]], lambda s: stateful.track_log(s, P), f"track_log_{seed}")
    expected = sorted((r["track_id"], r["seq"], r["kind"], micros(r["effective_at"]), r["evidence"] and r["evidence"]["evidence_id"]) for r in events.collect())
    assert told([r for r in got if "/Z/1#" not in r["log_id"]]) == expected and {"started", "moved", "quiet", "stale"} <= {r["kind"] for r in got}
    # live tracks only are kept: all but the last have gone
    state = rocks.read.format("statestore").option("path", f"{tmp_path}/track_log_{seed}-c").option("stateVarName", "live").load()
    assert {r["key"]["walk"] + r["key"]["class"] for r in state.select("key").collect()} <= {"missile"}
    assert state.count() == 1


def test_clusters_are_keys_of_their_own(rocks, tmp_path):
    rows = [obs(m, "A", place=p, at=at, kind="air.guided_bomb", post=f"A/{p}{m}") for m, p, at in [(0, "x", (30.5, 50.4)), (3, "y", (90.0, 10.0)), (9, "x", (30.5, 50.4))]]
    batch = tracks.follow(rocks.createDataFrame(rows, OBSERVATION), P, T0 + timedelta(minutes=10))[1].collect()
    named = lambda s: s.withColumn("near", F.when(F.col("provenance.place_id") == "x", "one").otherwise("two"))
    got = run(rocks, tmp_path, OBSERVATION, in_batches(rows, 2), lambda s: stateful.track_log(named(s), P, cluster="near"), "clustered_log")
    assert told(got) == sorted((r["track_id"], r["seq"], r["kind"], micros(r["effective_at"]), r["evidence"] and r["evidence"]["evidence_id"]) for r in batch)
