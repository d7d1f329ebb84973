"""Streams: incremental sessions with all-clears, and the exact window with its retention."""

from __future__ import annotations

from datetime import datetime, timedelta

import pandas as pd
import pytest

from sentria import streaming
from sentria.params import policy
from sentria.schemas import OBSERVATION
from tests.test_fusion import T0, obs

AT = datetime(2024, 1, 1)


def rows_of(*reports):
    """(minute, source, stance) as flat rows."""
    return [("drone", "p", f"s:{source}", f"{source}{minute}", AT + timedelta(minutes=minute), 1800, stance) for minute, source, stance in reports]


COLUMNS = ["class", "key", "source_id", "evidence_id", "observed_at", "ttl", "stance"]


@pytest.mark.parametrize(("reports", "closed", "left"), [
    ([(0, "A", "threat"), (20, "A", "threat")], [], 2),
    ([(0, "A", "threat"), (31, "A", "threat")], [("expired", 1)], 1),
    ([(0, "A", "threat"), (2, "B", "threat"), (4, "A", "clear")], [], 2),
    ([(0, "A", "threat"), (2, "B", "threat"), (4, "A", "clear"), (7, "B", "clear")], [("retracted", 2)], None),
    ([(0, "A", "threat"), (20, "B", "threat"), (35, "A", "clear")], [], 2),
    ([(0, "A", "threat"), (5, "C", "clear"), (6, "A", "neutralized")], [], 1),
    ([(0, "A", "threat"), (5, "A", "clear"), (6, "A", "threat")], [("retracted", 1)], 1),
    ([(0, "A", "clear")], [], None),
])
def test_advance(reports, closed, left):
    open_, out = streaming.advance(("drone", "p"), None, pd.DataFrame(rows_of(*reports), columns=COLUMNS))
    assert [(r[-1], r[-2]) for r in out] == closed and (open_.reports if open_ else None) == left


def test_a_post_that_contradicts_itself():
    rows = pd.DataFrame([("drone", "p", "s:A", "A0", AT, 1800, "threat"), ("drone", "p", "s:A", "A5", AT + timedelta(minutes=5), 1800, "clear"), ("drone", "p", "s:A", "A5", AT + timedelta(minutes=5), 1800, "threat")], columns=COLUMNS)
    open_, out = streaming.advance(("drone", "p"), None, rows)
    assert out == [] and open_.reports == 2


def write_batches(spark, folder, schema, *batches):
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_stream_sessions(spark, tmp_path):
    schema = "class string, key string, source_id string, evidence_id string, observed_at timestamp, ttl int, stance string"
    stream = write_batches(spark, str(tmp_path / "in"), schema, rows_of((0, "A", "threat"), (20, "A", "threat")), rows_of((120, "A", "threat"), (125, "A", "clear")), rows_of((600, "A", "threat")))
    q = streaming.sessions(stream).writeStream.format("memory").queryName("closed_sessions").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["status"], r["reports"]) for r in spark.table("closed_sessions").collect()) == [("expired", 2), ("retracted", 1)]


def test_exact_window_keeps_what_it_needs(spark, tmp_path):
    stream = write_batches(spark, str(tmp_path / "in"), OBSERVATION, [obs(0), obs(10, "B")], [obs(200, place="p2"), obs(-30, "C")], [obs(2000, place="p3")])
    got = {}

    def sink(fused, number):
        got[number] = (sorted((r["class"], r["place"]["id"], r["status"]) for r in fused.assessed.assessments.collect()), fused.tracks.count(), fused.track_events.filter("kind = 'started'").count())

    streaming.assess_window(stream, str(tmp_path / "w"), policy("fusion.v1"), sink, str(tmp_path / "c"), keep=timedelta(hours=6)).awaitTermination(180)
    # the files of a stream are read in any order of equal times: the last batch to come sees the latest time
    assert got and max(len(a) for a, _, _ in got.values()) >= 1 and all(t == s for _, t, s in got.values())
    hours = {int(p.name.partition("=")[2]) for p in (tmp_path / "w").glob("hour=*")}
    latest = int((T0 + timedelta(minutes=2000)).timestamp() // 3600)
    assert latest in hours
    if [a for a, _, _ in got.values()][-1] == [("drone", "p3", "active")]:
        assert hours == {latest}
