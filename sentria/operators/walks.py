"""Walks over many reports: what ``tracks.Walk`` does report by report, on columns.

Reports come in Arrow batches, and events leave as columns: evidence is taken from
the batch it came in and never becomes Python objects. Live tracks are
found by the names of their places; all of them are looked at only where a report speaks of more
objects than are known there. A walk keeps live tracks, not their paths or evidence:
these are gathered from the events, by Spark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime
from functools import lru_cache
from typing import NamedTuple
from zoneinfo import ZoneInfo

import pyarrow as pa

from ..params import SPECIFIC, FusionPolicy
from . import tracks

EVENTS = ("started", "moved", "quiet", "stale", "neutralized", "cleared")
STARTED, MOVED, QUIET, STALE, NEUTRALIZED, CLEARED = range(6)
NO_COUNT = -(1 << 31)
NEVER = 1 << 62


class Place(NamedTuple):
    id: str
    name: str | None
    via: bool
    region: bool
    cells: list | None
    lon: float | None
    lat: float | None
    radius_km: float | None


class Said(NamedTuple):
    """The places of a report: where it is, where it goes, and all names."""

    here: Place
    aim: Place | None
    ids: tuple[str, ...]


@lru_cache(maxsize=20_000)
def said(text: str) -> Said:
    places = []
    for p in json.loads(text):
        spot = p["spot"]
        places.append(Place(p["id"], p.get("name"), p["via"], p["region"], p.get("cells"), spot.get("lon"), spot.get("lat"), spot.get("radius_km")))
    return Said(places[0], next((p for p in reversed(places) if not p.via), None), tuple(dict.fromkeys(p.id for p in places)))


class Followed:
    """A live track."""

    __slots__ = ("n", "id", "kind", "unknown", "first", "position", "last", "target", "post", "sources", "active", "seq", "steps")

    def names(self) -> tuple[str, ...]:
        return (self.position.id,) if self.target is None or self.target.id == self.position.id else (self.position.id, self.target.id)


def _metres(track: Followed, here: Place) -> int:
    p = track.position
    return int(tracks._distance_km(p.lon, p.lat, here.lon, here.lat) * 1000)


class Told:
    """Events and ended tracks since the last batch that left, by column."""

    def __init__(self) -> None:
        self.events: tuple[list, ...] = ([], [], [], [], [], [], [], [])  # key, n, id, seq, event, time, row, place
        self.ends: list[tuple] = []


class ColumnWalk:
    """The live tracks of one class, cluster and island."""

    def __init__(self, policy: FusionPolicy, key: tuple, told: Told):
        self.policy, self.rules, self.key, self.told = policy, policy.tracks, key, told
        self.live: dict[int, Followed] = {}
        self.named: dict[str, dict[int, Followed]] = {}
        self.begun, self.due = 0, -NEVER
        self.quiet_after, self.stale_after = self.rules.quiet_s[key[0]] * 1_000_000, self.rules.stale_s * 1_000_000

    def _tell(self, t: Followed, event: int, at: int, row: int | None, place: Place | None) -> None:
        t.seq += 1
        for column, value in zip(self.told.events, (self.key, t.n, t.id, t.seq, event, at, row, place), strict=True):
            column.append(value)
        due = t.last + (self.quiet_after if t.active else self.stale_after)
        if due < self.due:
            self.due = due

    def _enter(self, t: Followed) -> None:
        for name in t.names():
            self.named.setdefault(name, {})[t.n] = t

    def _leave(self, t: Followed) -> None:
        for name in t.names():
            there = self.named[name]
            del there[t.n]
            if not there:
                del self.named[name]

    def _end(self, t: Followed, event: int, at: int, row: int | None) -> None:
        self._tell(t, event, at, row, None)
        self._leave(t)
        del self.live[t.n]
        self.told.ends.append((self.key, t, EVENTS[event]))

    def age(self, now: int) -> None:
        if now < self.due:
            return
        due, quiet, stale = NEVER, self.quiet_after, self.stale_after
        for t in list(self.live.values()):
            if t.active and t.last + quiet <= now:
                t.active = False
                self._tell(t, QUIET, t.last + quiet, None, None)
            if not t.active and t.last + stale <= now:
                self._end(t, STALE, t.last + stale, None)
            else:
                due = min(due, t.last + (quiet if t.active else stale))
        self.due = due

    def clear(self, row: int, at: int, source: str, places: Said) -> None:
        for name in places.ids:
            for t in list(self.named.get(name, {}).values()):
                if source in t.sources:
                    t.sources = tuple(s for s in t.sources if s != source)
                    if not t.sources:
                        self._end(t, CLEARED, at, row)

    def _within(self, t: Followed, here: Place, at: int) -> bool:
        reach = tracks.range_km(self.rules, t.kind, (at - t.last) / 1_000_000)
        p = t.position
        return reach is not None and tracks._distance_km(p.lon, p.lat, here.lon, here.lat) <= reach + p.radius_km + here.radius_km

    def neutralized(self, row: int, at: int, kind: str, count: int | None, places: Said) -> None:
        here, wanted = places.here, 1 if count is None else count
        there = self.named.get(here.id, {})
        found = [t for t in there.values() if not t.unknown and t.kind == kind]
        if 0 <= wanted <= len(found):
            found.sort(key=lambda t: (_metres(t, here), t.id, t.n))
        else:
            found = [t for t in self.live.values() if not t.unknown and (t.n in there or self._within(t, here, at))]
            found.sort(key=lambda t: (t.kind != kind, t.n not in there, _metres(t, here), t.id, t.n))
        for t in found[:wanted]:
            self._end(t, NEUTRALIZED, at, row)

    def threat(self, row: int, at: int, source: str, evidence: str, where: str, kind: str, count: int | None, places: Said) -> None:
        here, aim, post = places.here, places.aim, (source, evidence)
        chosen = [t for t in self.named.get(here.id, {}).values() if t.post != post]
        if aim is not None and aim.id != here.id:
            chosen += [t for t in self.named.get(aim.id, {}).values() if t.target is not None and t.target.id == aim.id and here.id not in t.names() and t.post != post]
        if count is None:
            if not chosen:
                near = [t for t in self.live.values() if t.post != post and self._within(t, here, at)]
                chosen = [min(near, key=lambda t: (_metres(t, here), t.id, t.n))] if near else []
            new = int(not chosen)
        else:
            if len(chosen) != count:
                rank = lambda t: (_metres(t, here), t.id, t.n)
                chosen.sort(key=rank)
                if not 0 <= count < len(chosen):
                    same = {t.n for t in chosen}
                    chosen += sorted((t for t in self.live.values() if t.post != post and t.n not in same and self._within(t, here, at)), key=rank)
                chosen = chosen[:count]
            new = count - len(chosen)
        for t in chosen:
            if kind in SPECIFIC and t.kind not in SPECIFIC:
                t.kind = kind
            target = t.target if aim is None else aim
            if t.position.id != here.id or (t.target is None) != (target is None) or target is not None and t.target.id != target.id:
                self._leave(t)
                t.position, t.target = here, target
                self._enter(t)
            else:
                t.position, t.target = here, target
            if source not in t.sources:
                t.sources = (*t.sources, source)
            t.last, t.post, t.active = at, post, True
            t.steps += 1
            self._tell(t, MOVED, at, row, here)
        for i in range(1, new + 1):
            t = Followed()
            self.begun += 1
            t.n, t.id, t.kind, t.unknown, t.first, t.last = self.begun, f"{self.policy.version}/track/{self.key[0]}/{evidence}#{where}#{i}", kind, count is None, at, at
            t.position, t.target, t.post, t.sources, t.active, t.seq, t.steps = here, aim, post, (source,), True, 0, 1
            self.live[t.n] = t
            self._enter(t)
            self._tell(t, STARTED, at, row, here)

    def finish(self, now: int) -> None:
        self.age(now)
        self.told.ends += ((self.key, t, "active" if t.active else "quiet") for t in self.live.values())


#: Columns of a walk's reports, besides its keys and what only orders them.
READ = ("observed_at", "source_id", "evidence_id", "turn", "kind", "count", "contradicted", "where", "said", "ref")


def _values(column: pa.Array) -> list:
    return column.to_numpy(zero_copy_only=False).tolist()


def _coded(column: pa.Array, make=None) -> list:  # noqa: ANN001
    """Values of which few differ, each made once."""
    encoded = column.dictionary_encode()
    known = encoded.dictionary.to_pylist()
    if make is not None:
        known = [make(v) for v in known]
    return [known[i] for i in encoded.indices.to_numpy().tolist()]


def column_walks(policy: FusionPolicy, now: datetime, schema: pa.Schema):
    """Walks over batches that are sorted by class, cluster, island and the order of reports; gives rows of ``tracks.WALKED``."""
    event_type, track_type = schema.field("event").type, schema.field("track").type

    def placed(places: list[Place | None], kind: pa.DataType) -> pa.Array:
        """Places as structs, each made once."""
        own: dict[int, int] = {}
        kept: list[Place] = []
        at = []
        for p in places:
            if p is None:
                at.append(None)
                continue
            number = own.get(id(p))
            if number is None:
                number = own[id(p)] = len(kept)
                kept.append(p)
            at.append(number)
        return pa.array([{"id": p.id, "name": p.name} for p in kept], kind).take(pa.array(at, pa.int32()))

    def keyed(keys: list[tuple]) -> list[pa.Array]:
        distinct = list(dict.fromkeys(keys))
        at = pa.array([0] * len(keys), pa.int32()) if len(distinct) == 1 else pa.array(list(map({k: i for i, k in enumerate(distinct)}.get, keys)), pa.int32())
        return [pa.array([k[c] for k in distinct], schema.field(c).type).take(at) for c in range(3)]

    def events(told: Told, refs: pa.Array | None) -> pa.RecordBatch:
        keys, numbers, ids, seqs, kinds, times, rows, places = told.events
        kind_of = {f.name: f.type for f in event_type}
        taken = pa.nulls(len(ids), kind_of["evidence"]) if refs is None else refs.take(pa.array(rows, pa.int32())).cast(kind_of["evidence"])
        event = pa.StructArray.from_arrays(
            [pa.array(ids, pa.string()), pa.array(seqs, pa.int32()), pa.array(EVENTS, pa.string()).take(pa.array(kinds, pa.int32())), pa.array(times, pa.int64()).cast(kind_of["effective_at"]), taken], fields=list(event_type)
        )
        return pa.RecordBatch.from_arrays([*keyed(keys), pa.array(numbers, pa.int64()), event, placed(places, schema.field("place").type), pa.nulls(len(ids), track_type)], schema=schema)

    def ends(told: Told) -> pa.RecordBatch:
        rows = told.ends
        own = [t for _, t, _ in rows]
        kind_of = {f.name: f.type for f in track_type}
        here, there = [t.position for t in own], [t.target for t in own]
        time = lambda name: pa.array([getattr(t, name) for t in own], pa.int64()).cast(kind_of[f"{name}_at" if name == "first" else "last_seen_at"])
        circles = lambda places, kind: pa.array([None if p is None else {"lon": p.lon, "lat": p.lat} for p in places], kind)
        columns = {
            "track_id": [t.id for t in own], "policy_version": [policy.version] * len(own), "class": [k[0] for k, _, _ in rows], "kind": [t.kind for t in own], "count_unknown": [t.unknown for t in own],
            "position": placed(here, kind_of["position"]), "target": placed(there, kind_of["target"]), "motion": ["unknown" if p is None else "heading" for p in there], "steps": [t.steps for t in own],
            "status": [s for _, _, s in rows], "first_at": time("first"), "last_seen_at": time("last"), "center": circles(here, kind_of["center"]), "radius_km": [p.radius_km for p in here],
            "target_center": circles(there, kind_of["target_center"]), "target_radius_km": [None if p is None else p.radius_km for p in there],
            "region": [next((p.cells for p in (t.target, t.position) if p and p.region), None) for t in own], "position_region": [p.region for p in here], "target_region": [bool(p and p.region) for p in there],
        }
        made = [c if isinstance(c, pa.Array) else pa.array(c, kind_of[n]) for n, c in columns.items()]
        track = pa.StructArray.from_arrays(made, fields=list(track_type))
        nothing = [pa.nulls(len(own), schema.field(n).type) for n in ("event", "place")]
        return pa.RecordBatch.from_arrays([*keyed([k for k, _, _ in rows]), pa.array([t.n for t in own], pa.int64()), *nothing, track], schema=schema)

    def sent(told: Told, refs: pa.Array | None) -> Iterator[pa.RecordBatch]:
        if told.events[0]:
            yield events(told, refs)
        if told.ends:
            yield ends(told)
        for column in (*told.events, told.ends):
            column.clear()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, own, key, end = Told(), None, None, 0
        for batch in batches:
            column = lambda name, b=batch: b.column(b.schema.get_field_index(name))
            zone = column("observed_at").type.tz
            last = now if now.tzinfo else now.replace(tzinfo=ZoneInfo(zone or "UTC"))
            end = round((last - datetime(1970, 1, 1, tzinfo=ZoneInfo("UTC"))) / tracks.MICROSECOND)
            keys = zip(_coded(column("class")), _coded(column("cluster")), _values(column("island")), strict=True)
            rows = zip(
                keys, _values(column("observed_at").cast(pa.int64())), _coded(column("source_id")), _values(column("evidence_id")), _values(column("turn")), _coded(column("kind")),
                _values(column("count").fill_null(NO_COUNT)), _values(column("contradicted")), _values(column("where")), _coded(column("said"), said), strict=True,
            )
            for row, (of, at, source, evidence, turn, kind, count, contradicted, where, places) in enumerate(rows):
                if of != key:
                    if own is not None:
                        own.finish(end)
                    own, key = ColumnWalk(policy, of, told), of
                own.age(at)
                if turn == 0:
                    own.threat(row, at, source, evidence, where, kind, None if count == NO_COUNT else count, places)
                elif turn == 1:
                    own.neutralized(row, at, kind, None if count == NO_COUNT else count, places)
                elif not contradicted:
                    own.clear(row, at, source, places)
            yield from sent(told, column("ref"))
        if own is not None:
            own.finish(end)
            yield from sent(told, None)

    return walk
