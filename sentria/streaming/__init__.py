"""Episodes and tracks over streams.

Exact mode: each micro-batch joins a retained window, which is assessed again at
an event-time evaluation time; rows are keyed, so sinks replace them. The window
is kept by hours of event time: a batch reads the hours that it needs, and deletes
those that no batch will need again. Late rows do no harm. Incremental mode: state
for each (class, place) holds the open episode with its live sources; reports
renew it, all-clears withdraw sources, timers close it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import episodes, tracks
from ..params import FusionPolicy


def deduplicated(posts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each post once within the watermark."""
    return posts.withWatermark("published_at", delay).dropDuplicatesWithinWatermark(["source_id", "external_id"])


def _hours(spark: SparkSession, path: str) -> list[int]:
    """The hours of event time that the window folder has, oldest first."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(int(f.getPath().getName().partition("=")[2]) for f in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/hour=*")) or [])


def _drop_hours(spark: SparkSession, path: str, before: int) -> None:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for hour in _hours(spark, path):
        if hour < before:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/hour={hour}"), True)


class Fused(NamedTuple):
    """What a batch of exact mode gives its sink."""

    assessed: episodes.Assessed
    tracks: DataFrame
    track_events: DataFrame


def assess_window(stream: DataFrame, window_path: str, policy: FusionPolicy, sink: Callable[[Fused, int], None], checkpoint: str, keep: timedelta = timedelta(hours=24), now: datetime | None = None) -> StreamingQuery:
    """Exact mode. The window is assessed at the latest time it has seen, or at ``now``.

    Rows go to ``hour=H/batch=N`` in the window folder. A batch that runs again
    replaces its own rows; hours older than ``keep`` before the evaluation time
    are pruned from the read, and deleted once the sink is done.
    """

    def fuse(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        hour = F.floor(F.unix_seconds("observed_at") / 3600)
        rows = batch.withColumn("hour", hour).withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour", "batch").parquet(window_path)
        hours = _hours(spark, window_path)
        if not hours:
            return
        seen = spark.read.schema(f"{batch._jdf.schema().toDDL()}, hour long, batch long").parquet(window_path)
        # the latest hour alone holds the latest time
        end = now or seen.filter(F.col("hour") == hours[-1]).agg(F.max("observed_at")).first()[0]
        end = end if end.tzinfo else end.astimezone(timezone.utc)
        first = int((end - keep).timestamp() // 3600)
        kept = seen.filter((F.col("hour") >= first) & (F.col("observed_at") > F.lit(end - keep))).drop("hour", "batch")
        sink(Fused(episodes.assess(kept, policy, end), *tracks.follow(kept, policy, end)), number)
        _drop_hours(spark, window_path, first)

    return stream.writeStream.foreachBatch(fuse).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: State of one (class, place): the open episode's beginning and first report, its sources with their ends, and reports so far.
STATE = "first_at timestamp, evidence_id string, sources array<string>, untils array<timestamp>, reports int"
CLOSED = "class string, key string, evidence_id string, first_at timestamp, until timestamp, sources int, reports int, status string"
_CLOSED = [f.split()[0] for f in CLOSED.split(", ")]


class _Open:
    """An open episode of one (class, place)."""

    def __init__(self, first: datetime, evidence: str, live: dict[str, datetime], reports: int):
        self.first, self.evidence, self.live, self.reports = first, evidence, live, reports
        self.until = max(live.values(), default=first)

    def closed(self, key: tuple, status: str, until: datetime) -> tuple:
        return (*key, self.evidence, self.first, until, len(self.live), self.reports, status)

    def renew(self, source: str, at: datetime, ttl: int) -> None:
        self.live = {s: u for s, u in self.live.items() if u >= at} | {source: at + timedelta(seconds=ttl)}
        self.until = max(self.live.values())
        self.reports += 1

    def withdraw(self, source: str, at: datetime) -> bool:
        """Whether the last live source has taken back its report."""
        if self.live.get(source, datetime.min) < at:
            return False
        rest = {s: u for s, u in self.live.items() if s != source and u >= at}
        if rest:
            self.live, self.until = rest, max(rest.values())
        return not rest


def advance(key: tuple, open_: _Open | None, rows: pd.DataFrame) -> tuple[_Open | None, list[tuple]]:
    """The open episode after some rows in order, and those that closed on the way."""
    out: list[tuple] = []
    threats = set(zip(rows.source_id[rows.stance == "threat"], rows.evidence_id[rows.stance == "threat"], strict=True))
    ordered = rows.assign(later=rows.stance != "threat").sort_values(["observed_at", "source_id", "evidence_id", "later"])
    for row in ordered.itertuples():
        at = row.observed_at.to_pydatetime().replace(tzinfo=None)
        if open_ and row.stance == "threat" and at > open_.until:
            out.append(open_.closed(key, "expired", open_.until))
            open_ = None
        if row.stance == "threat":
            open_ = open_ or _Open(at, row.evidence_id, {}, 0)
            open_.renew(row.source_id, at, int(row.ttl))
        elif row.stance == "clear" and open_ and (row.source_id, row.evidence_id) not in threats and open_.withdraw(row.source_id, at):
            out.append(open_.closed(key, "retracted", open_.until))
            open_ = None
    return open_, out


def sessions(rows: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Incremental mode: one row for each episode once it is retracted, or event time has passed its end.

    ``rows`` are flat: class, key, source_id, evidence_id, observed_at, ttl and
    stance (threat, clear; others are ignored; without the column all are threats). A batch's rows of a place are taken in order of
    time. Rows that come in a later batch than newer ones still count, as if they
    had come in time for renewals, but don't undo a retraction; exact mode does.
    """
    told = rows if "stance" in rows.columns else rows.withColumn("stance", F.lit("threat"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = None
        if state.exists:
            first, evidence, sources, untils, n = state.get
            open_ = _Open(first.replace(tzinfo=None), evidence, {s: u.replace(tzinfo=None) for s, u in zip(sources, untils, strict=True)}, n)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([open_.closed(key, "expired", open_.until)], columns=_CLOSED)
            return
        open_, out = advance(key, open_, pd.concat(list(batches)))
        if open_ is None:
            if state.exists:
                state.remove()
        else:
            state.update((open_.first, open_.evidence, list(open_.live), list(open_.live.values()), open_.reports))
            end = int(open_.until.replace(tzinfo=timezone.utc).timestamp() * 1000)
            state.setTimeoutTimestamp(max(end + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=_CLOSED)

    marked = told.select("class", "key", "source_id", "evidence_id", "observed_at", "ttl", "stance").withWatermark("observed_at", delay)
    return marked.groupBy("class", "key").applyInPandasWithState(step, CLOSED, STATE, "append", GroupStateTimeout.EventTimeTimeout)
