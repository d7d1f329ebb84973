"""Event logs of episodes and tracks as streams, by state for each key and timers of event time.

On input in order of time the logs equal those of the batch operators. Rows that
come in a later batch than newer ones (within the watermark's delay) are corrected
for as far as that needs no undoing; see the two functions.

State is kept by RocksDB, which these processors need
(``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import tracks
from ..params import FusionPolicy

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
LOGGED = "log_id string, seq int, kind string, at_us long, source_id string, evidence_id string, reason string"
#: Why a row of the log corrects what came before.
LATE = "late_report"


def _only_timer(handle: StatefulProcessorHandle, ms: int | None) -> None:
    """The key's one timer, if any."""
    for old in list(handle.listTimers()):
        if old != ms:
            handle.deleteTimer(old)
    if ms is not None:
        handle.registerTimer(ms)


class OpenEpisode:
    """The open episode of a (class, place), in microseconds: live sources with their ends, and posts that were counted."""

    def __init__(self, id_: str, seq: int = 0, live: dict[str, int] | None = None, posts: Iterable[str] = ()):
        self.id, self.seq, self.live, self.posts = id_, seq, live or {}, set(posts)

    @property
    def until(self) -> int:
        return max(self.live.values(), default=0)

    def row(self, kind: str, at: int, source: str | None = None, evidence: str | None = None, reason: str | None = None) -> Row:
        self.seq += 1
        return Row(log_id=self.id, seq=self.seq, kind=kind, at_us=at, source_id=source, evidence_id=evidence, reason=reason)

    def renewed(self, r: Row) -> bool:
        """Takes a report; whether its post is new to the episode."""
        self.live = {s: u for s, u in self.live.items() if u >= r.us} | {r.source_id: max(r.us + r.ttl * 1_000_000, self.live.get(r.source_id, 0) if self.live.get(r.source_id, 0) >= r.us and r.late else 0)}
        post = f"{r.source_id} {r.evidence_id}"
        new = post not in self.posts
        self.posts.add(post)
        return new

    def withdrawn(self, r: Row) -> bool:
        """Takes an all-clear; whether no live source is left."""
        if self.live.get(r.source_id, -1) < r.us:
            return False
        rest = {s: u for s, u in self.live.items() if s != r.source_id and u >= r.us}
        if rest:
            self.live = rest
        return not rest


class EpisodeLog(StatefulProcessor):
    """One (class, place): the open episode, the latest time seen, and the id and length of the log that closed last."""

    def __init__(self, version: str):
        self.version = version

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "id string, seq int, live string, posts string")
        self.past = handle.getValueState("past", "last_us long, id string, seq int")

    def _held(self) -> OpenEpisode | None:
        if not self.open.exists():
            return None
        id_, seq, live, posts = self.open.get()
        return OpenEpisode(id_, seq, json.loads(live), json.loads(posts))

    def _keep(self, episode: OpenEpisode | None, past: tuple) -> None:
        if episode is None:
            self.open.clear()
            _only_timer(self.handle, None)
        else:
            self.open.update((episode.id, episode.seq, json.dumps(episode.live), json.dumps(sorted(episode.posts))))
            _only_timer(self.handle, episode.until // 1000 + 1)
        self.past.update(past)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        held = [Row(late=False, threat=r["stance"] == "threat", **r.asDict()) for r in rows if r["stance"] in ("threat", "clear")]
        held.sort(key=lambda r: (r.us, r.source_id, r.evidence_id, not r.threat, r.ttl))
        own = {(r.source_id, r.evidence_id) for r in held if r.threat}
        episode = self._held()
        last, id_, seq = self.past.get() if self.past.exists() else (None, None, 0)
        for r in held:
            late = last is not None and r.us < last
            last = r.us if last is None else max(last, r.us)
            if late:
                r = Row(**(r.asDict() | {"late": True}))
            if r.threat:
                if episode and r.us > episode.until:
                    yield episode.row("expired", episode.until)
                    id_, seq, episode = episode.id, episode.seq, None
                if episode is None and late and r.us + r.ttl * 1_000_000 < last:
                    # it was over before what is known; only the log that closed last can say so
                    if id_ is not None:
                        seq += 1
                        yield Row(log_id=id_, seq=seq, kind="corrected", at_us=r.us, source_id=r.source_id, evidence_id=r.evidence_id, reason=LATE)
                    continue
                opened = episode is None
                episode = episode or OpenEpisode(f"{self.version}/{key[0]}/{key[1]}/{r.evidence_id}")
                if episode.renewed(r):
                    kind = "issued" if opened else "corrected" if late else "superseded"
                    yield episode.row(kind, r.us, r.source_id, r.evidence_id, LATE if late else None)
            elif (r.source_id, r.evidence_id) not in own and episode:
                if late:
                    yield episode.row("corrected", r.us, r.source_id, r.evidence_id, "late_all_clear")
                elif episode.withdrawn(r):
                    yield episode.row("retracted", r.us, r.source_id, r.evidence_id, "source_all_clear")
                    id_, seq, episode = episode.id, episode.seq, None
        self._keep(episode, (last, id_, seq))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        episode = self._held()
        if episode and episode.until // 1000 + 1 <= timerValues.getCurrentWatermarkInMs():
            yield episode.row("expired", episode.until)
            self._keep(None, (self.past.get()[0], episode.id, episode.seq))

    def close(self) -> None:
        pass


def event_log(rows: DataFrame, policy: FusionPolicy, delay: str = "10 minutes") -> DataFrame:
    """The assessments' events as they happen: issued, superseded, retracted, expired, numbered within each assessment.

    ``rows`` are flat: class, key, source_id, evidence_id, observed_at, ttl and stance. An assessment expires once
    the watermark has passed its end. A report that comes late renews the open assessment and is logged as
    ``corrected``; where its time is over, it corrects the log that closed last. A late all-clear is logged and
    undoes nothing. A post's rows of one place are to come in one batch, so that it can contradict itself.
    """
    marked = rows.withWatermark("observed_at", delay).select("class", "key", "source_id", "evidence_id", F.unix_micros("observed_at").alias("us"), F.col("ttl").cast("long").alias("ttl"), "stance", "observed_at")
    return marked.groupBy("class", "key").transformWithState(EpisodeLog(policy.version), LOGGED, "Append", "EventTime")


def _time(us: int) -> datetime:
    return EPOCH + timedelta(microseconds=us)


def _micros(at: datetime) -> int:
    return (at - EPOCH) // timedelta(microseconds=1)


def statements(mentions: list[dict]) -> list[dict]:
    """Mentions of some posts as reports in their order, with contradicted all-clears marked, as ``tracks.reports`` makes them."""
    grouped: dict[tuple, list[dict]] = {}
    for m in mentions:
        grouped.setdefault((m["us"], m["source_id"], m["evidence_id"], m["statement"], m["alone"], m["turn"]), []).append(m)
    out = []
    for key in sorted(grouped, key=lambda k: (*k[:3], k[3] is not None, k[3] or 0, *k[4:])):
        own = grouped[key]
        places: dict[str, dict] = {}
        for m in sorted(own, key=lambda m: (m["place"]["order"], m["place"]["id"], m["place"]["via"], m["place"]["name"] or "")):
            places.setdefault(m["place"]["id"], m["place"])
        best = min(own, key=lambda m: (m["best"]["plain"], m["best"]["rank"]))["best"]
        counts = [m["count"] for m in own if m["count"] is not None]
        out.append({n: own[0][n] for n in ("source_id", "evidence_id", "statement", "class", "stance")} | {"observed_at": _time(key[0]), "kind": best["kind"], "count": max(counts, default=None), "ref": {"source_id": key[1], "evidence_id": key[2]}, "places": list(places.values())})
    threatened: dict[tuple, set] = {}
    for r in out:
        if r["stance"] == "threat":
            threatened.setdefault((r["source_id"], r["evidence_id"]), set()).update(p["id"] for p in r["places"])
    return [r | {"contradicted": r["stance"] == "clear" and not threatened.get((r["source_id"], r["evidence_id"]), set()).isdisjoint(p["id"] for p in r["places"])} for r in out]


class TrackLog(StatefulProcessor):
    """The live tracks of one (class, cluster), each an entry of a map that goes when the track ends."""

    def __init__(self, policy: FusionPolicy):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getMapState("live", "n long", "track string")
        self.walked = handle.getValueState("walked", "begun long, last_us long")

    def _walk(self, hazard: str) -> tuple[tracks.Walk, int | None]:
        walk, last = tracks.Walk(self.policy, hazard, timezone.utc), None
        if self.walked.exists():
            walk.begun, last = self.walked.get()
            walk.live = {n: _track(text) for (n,), (text,) in self.live.iterator()}
            walk.due = min(map(walk._due, walk.live.values()), default=datetime.max.replace(tzinfo=timezone.utc))
        return walk, last

    def _done(self, walk: tracks.Walk, before: dict[int, tracks.Track], last: int) -> Iterator[Row]:
        for n in before.keys() - walk.live.keys():
            self.live.removeKey((n,))
        for n, track in walk.live.items():
            if before.get(n) is not track:
                self.live.updateValue((n,), (_text(track),))
        self.walked.update((walk.begun, last))
        _only_timer(self.handle, math.ceil(_micros(walk.due) / 1000) if walk.live else None)
        for out in walk.out:
            if e := out["event"]:
                ref = e["evidence"] or {}
                yield Row(log_id=e["track_id"], seq=e["seq"], kind=e["kind"], at_us=_micros(e["effective_at"]), source_id=ref.get("source_id"), evidence_id=ref.get("evidence_id"), reason=None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        walk, last = self._walk(key[0])
        before = dict(walk.live)
        for report in statements([r.asDict(True) for r in rows]):
            last = max(_micros(report["observed_at"]), last if last is not None else -(1 << 62))
            report["observed_at"] = _time(last)
            walk.age(report["observed_at"])
            walk.take(report)
        yield from self._done(walk, before, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        walk, last = self._walk(key[0])
        before = dict(walk.live)
        walk.age(_time(timerValues.getCurrentWatermarkInMs() * 1000))
        yield from self._done(walk, before, last)

    def close(self) -> None:
        pass


_TIMES = ("first", "last")


def _text(track: tracks.Track) -> str:
    """A live track as JSON, without its path and evidence, which its events don't need."""
    held = track._asdict() | {n: _micros(getattr(track, n)) for n in _TIMES} | {"path": None, "refs": None}
    return json.dumps(held)


def _track(text: str) -> tracks.Track:
    held = json.loads(text)
    held |= {n: _time(held[n]) for n in _TIMES} | {"post": tuple(held["post"]), "sources": tuple(held["sources"])}
    return tracks.Track(**held)


def track_log(observations: DataFrame, policy: FusionPolicy, delay: str = "10 minutes", cluster: str | None = None) -> DataFrame:
    """The tracks' events as they happen: started, moved, quiet, stale, neutralized, cleared, numbered within each track.

    A class is one key, or a class's clusters of places are, if a column of ``observations`` names them (see
    ``tracks.clusters``, over the places that a deployment knows). Silences are noticed by timers once the watermark has
    passed them. The rows of a post are to come in one batch; a report that comes after newer ones counts as of the newest time.
    """
    rows = tracks.mentions(observations.withWatermark("observed_at", delay), policy, () if cluster is None else (cluster,))
    named = F.lit("") if cluster is None else F.col(cluster)
    marked = rows.select("*", named.alias("walk"), F.unix_micros("observed_at").alias("us")).drop("ref").withColumn("place", F.col("place").dropFields("cells"))
    return marked.groupBy("class", "walk").transformWithState(TrackLog(policy), LOGGED, "Append", "EventTime")
