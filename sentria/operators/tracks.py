"""Tracks: reports about moving objects, matched to what is already followed.

Observations become reports by aggregation. Whatever compares two tracks, or a
track and a report, needs one class; a place in common, or a distance that an object may
cover before it is stale; and no silence of ``stale_s`` in between. So
reports fall into clusters: connected components of the places that they name, linked
where a report names both (its position and its target, all places of an all-clear) and where they lie within
reach of each other. Each cluster is cut again at its own silences into
islands. Reports are dealt by class, cluster and island, and walked in time order.
A walk keeps live tracks only; a track leaves it when it ends.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, tzinfo
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType, _parse_datatype_string

from ..functions import shapes, sphere
from ..params import EARTH_KM, KINDS, SPECIFIC, FusionPolicy, TrackPolicy
from ..schemas import EVIDENCE_REF, TRACK, TRACK_EVENT
from .episodes import evidence_ref, hazard_class, is_region, rank_of
from .footprint import outcome
from .runs import fold_runs, map_rows
from .shared import written

#: Stances in the order in which reports of one moment are taken.
TURNS = ("threat", "neutralized", "clear")
NO_ORDER = 65535


@F.pandas_udf(StructType([StructField(n, DoubleType()) for n in ("lon", "lat", "radius_km")]))
def region_circle(cells: pd.Series) -> pd.DataFrame:
    """Centroid of a region's cells and the radius of a circle as large; null for none of this grid."""

    return pd.DataFrame([_circle(None if c is None else tuple(c)) for c in cells], columns=["lon", "lat", "radius_km"])


@lru_cache(maxsize=1000)
def _circle(listed: tuple | None) -> tuple:
    """Kept for the regions that were asked for last: many observations name the same one."""
    try:
        known = [shapes.parsed(c) for c in listed]
        return shapes.centroid({c for _, c in known}, known[0][0])
    except (shapes.Refused, TypeError, IndexError):
        return (None, None, None)


def spot(policy: FusionPolicy) -> Column:
    """``struct<lon, lat, radius_km>`` of an observation; null if it has no place to follow."""
    g = F.col("geometry")
    at = sphere.position(F.get(g["coordinates"], F.lit(0)), F.get(g["coordinates"], F.lit(1)))
    ring = sphere.ring_of(F.get(g["rings"], F.lit(0)))
    middle = sphere.mean_position(ring)
    circle = lambda p, r: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"), r.cast("double").alias("radius_km"))
    found = (
        F.when(g["type"] == "point", circle(at, F.lit(policy.point_radius_km)))
        .when(g["type"] == "polygon", circle(middle, sphere.mean_distance_km(middle, ring)))
        .when((g["type"] == "cells") & is_region(F.col("provenance.place_id")), region_circle(g["cells"]))
    )
    return F.when(F.col("provenance.place_id").isNotNull() & sphere.valid_geometry(g), found)


def mentions(observations: DataFrame, policy: FusionPolicy, more: tuple[str, ...] = ()) -> DataFrame:
    """Observations that have a place to follow, as the mentions of which ``reports`` makes statements, with ``more`` of their columns. Expressions only."""
    p = F.col("provenance")
    return observations.withColumn("spot", spot(policy)).filter("spot is not null").select(
        "observed_at", "source_id", p["evidence_id"].alias("evidence_id"), p["statement"].alias("statement"),
        F.when(p["statement"].isNull(), p["place_id"]).otherwise("").alias("alone"), hazard_class(F.col("kind")).alias("class"), rank_of(F.col("stance"), TURNS).alias("turn"), "stance",
        F.struct((~F.col("kind").isin(*SPECIFIC)).alias("plain"), rank_of(F.col("kind"), KINDS).alias("rank"), F.col("kind").alias("kind")).alias("best"), "count", evidence_ref().alias("ref"),
        F.struct(
            F.coalesce(p["place_order"], F.lit(NO_ORDER)).alias("order"), p["place_id"].alias("id"), F.coalesce(p["place_role"] == "via", F.lit(False)).alias("via"),
            p["place_name"].alias("name"), "spot", is_region(p["place_id"]).alias("region"), F.col("geometry.cells").alias("cells"),
        ).alias("place"), *more,
    )


def reports(observations: DataFrame, policy: FusionPolicy) -> DataFrame:
    """One row for each statement of a post and class: kind, count, and places in their order.

    A place named twice keeps its first mention by order, role and kind.
    """
    # dealt once, by post: what compares statements of a post finds them together
    rows = mentions(observations, policy).repartition("source_id", "evidence_id", "class")
    key = ["observed_at", "source_id", "evidence_id", "statement", "alone", "class", "turn", "stance"]
    # places of one statement of one post: a handful
    gathered = rows.groupBy(*key).agg(F.array_sort(F.collect_set("place")).alias("named"), F.min("best").alias("best"), F.max("count").alias("count"), F.min("ref").alias("ref"))
    first = F.filter("named", lambda p, i: ~F.exists(F.slice("named", F.lit(1), i), lambda q: q["id"] == p["id"]))
    return gathered.withColumn("places", first).withColumn("kind", F.col("best.kind")).drop("best", "named")


def with_contradictions(rows: DataFrame) -> DataFrame:
    """Adds ``contradicted`` to clears whose own post threatens one of their places, in the same class. A window holds one post's reports."""
    post = Window.partitionBy("source_id", "evidence_id", "class")
    taken = F.flatten(F.collect_list(F.when(F.col("stance") == "threat", F.col("places.id"))).over(post))
    return rows.withColumn("contradicted", (F.col("stance") == "clear") & F.coalesce(F.arrays_overlap("places.id", taken), F.lit(False)))


def islands(observations: DataFrame, rules: TrackPolicy) -> DataFrame:
    """``class, bucket, island`` of observations: a class's times between silences after which all is stale."""
    return silences(observations.select(hazard_class(F.col("kind")).alias("class"), "observed_at"), ["class"], rules)


def silences(rows: DataFrame, keys: list[str], rules: TrackPolicy) -> DataFrame:
    """``keys, bucket, island``: times in buckets as long as the silence after which all is stale, numbered between such silences of a key.

    Two reports of one bucket are closer than that, so only the first and last of
    each bucket count. The table has four rows a day for each key, whatever
    the number of rows.
    """
    second = F.unix_micros("observed_at")
    spans = rows.select(*keys, second.alias("us")).groupBy(*keys, bucket_of(F.col("us"), rules.stale_s).alias("bucket")).agg(F.min("us").alias("first"), F.max("us").alias("last"))
    by_time = Window.partitionBy(*keys).orderBy("bucket")
    silent = F.col("first") - F.lag("last").over(by_time) >= rules.stale_s * 1_000_000
    return spans.withColumn("new", F.coalesce(silent, F.lit(False))).select(*keys, "bucket", F.count_if("new").over(by_time).alias("island"))


CLUSTER = "class string, id string, cluster string"


def clusters(seen: DataFrame, rules: TrackPolicy) -> DataFrame:
    """``class, id, cluster`` of the places that reports name first.

    Places and their links are reduced to distinct ones before they meet: a class's are one
    task's work, bounded by the places there are (a vocabulary), whatever the number of
    reports. Neighbours are found by boxes as wide as the class's objects reach (in
    space, so that there are no poles or edges), hence in proportion to the places.
    """
    here, aim = F.element_at("places", 1), F.try_element_at(F.filter("places", lambda p: ~p["via"]), F.lit(-1))
    named = F.when(F.col("stance") == "clear", F.col("places.id")).when((F.col("stance") == "threat") & aim.isNotNull(), F.array(aim["id"])).otherwise(F.array(here["id"]))
    links = seen.select("class", "kind", here["id"].alias("id"), here["spot"].alias("spot"), F.explode(named).alias("other")).distinct()

    def fold(rows: Iterable[dict]) -> Iterator[dict]:
        held = list(rows)
        roots = connected(held, rules)
        yield from ({"class": held[0]["class"], "id": i, "cluster": root} for i, root in roots.items())

    return fold_runs(links, ["class"], ["id", "other", "kind"], fold, CLUSTER)


def connected(links: list[dict], rules: TrackPolicy) -> dict[str, str]:
    """For each place of one class, the least id of its cluster. Links have ``id, spot, other, kind``."""
    reaches = [r for kind in {x["kind"] for x in links} if (r := range_km(rules, kind, rules.stale_s)) is not None]
    root: dict[object, object] = {}

    def find(x: object) -> object:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(a: object, b: object) -> None:
        a, b = find(a), find(b)
        root[a] = b

    for x in links:
        join(("id", x["id"]), ("id", x["other"]))
    if reaches:
        wide = max(reaches) + 2 * max(x["spot"]["radius_km"] for x in links)
        boxes = set()
        for x in links:
            lon, lat = math.radians(x["spot"]["lon"]), math.radians(x["spot"]["lat"])
            at = (math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat))
            box = tuple(math.floor(EARTH_KM * c / wide) for c in at)
            boxes.add(box)
            join(("id", x["id"]), ("box", box))
        for a, b, c in boxes:
            for near in ((a + i, b + j, c + k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)):
                if near in boxes:
                    join(("box", (a, b, c)), ("box", near))
    least: dict[object, str] = {}
    ids = sorted({x["id"] for x in links} | {x["other"] for x in links})
    for i in ids:
        least.setdefault(find(("id", i)), i)
    return {i: least[find(("id", i))] for i in ids}


def bucket_of(us: Column, seconds: int) -> Column:
    return F.floor(us / (seconds * 1_000_000))


def distance_km(a: dict, b: dict) -> float:
    return _distance_km(a["lon"], a["lat"], b["lon"], b["lat"])


@lru_cache(maxsize=100_000)
def _distance_km(lon: float, lat: float, to_lon: float, to_lat: float) -> float:
    p, q = math.radians(lat), math.radians(to_lat)
    chord = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(to_lon - lon) / 2) ** 2
    return 2 * EARTH_KM * math.asin(math.sqrt(chord))


#: A list that grows at its end by (what was before, item), so that no change copies it.
Chain = tuple["Chain | None", object] | None


def unrolled(chain: Chain) -> list:
    out = []
    while chain is not None:
        chain, item = chain
        out.append(item)
    return out[::-1]


class Track(NamedTuple):
    """What is known of one object; a change makes a new one."""

    n: int  # among the tracks of its walk: posts that are edited may give an id twice
    id: str
    hazard: str
    kind: str
    unknown: bool
    first: datetime
    position: dict
    last: datetime
    path: Chain  # of (place, time)
    target: dict | None
    post: tuple[str, str]
    sources: tuple[str, ...]
    refs: Chain
    status: str = "active"
    seq: int = 0

    def names(self) -> tuple[str, ...]:
        return (self.position["id"], self.target["id"]) if self.target else (self.position["id"],)


def range_km(rules: TrackPolicy, kind: str, seconds: float) -> float | None:
    """Kilometres a kind may cover in a time, the margin included; None for kinds that are matched at their own places only."""
    glide = rules.bomb_reach_km if kind == "air.guided_bomb" else None
    flown = rules.speed_kmh[kind] * max(0.0, seconds) / 3600 if kind in rules.speed_kmh else glide
    return None if flown is None else flown + rules.margin_km


#: How well a track fits a report, best first: other kind (of what was ended), not the same place, metres, id, number.
Fit = tuple[bool, bool, int, str, int]


def fits(live: Iterable[Track], report: dict, rules: TrackPolicy) -> list[Fit]:
    """The tracks that a report may speak of, for threats and for what was ended alike, the best first."""
    ended, here, aim, at = report["stance"] == "neutralized", report["places"][0], aimed_at(report), report["observed_at"]
    post, place, spot, aimed, out = (report["source_id"], report["evidence_id"]), here["id"], here["spot"], None if ended or aim is None else aim["id"], []
    for track in live:
        if track.unknown if ended else track.post == post:
            continue
        target = track.target["id"] if track.target else None
        same = place == track.position["id"] or target is not None and (place == target or aimed == target)
        reach = 0.0 if same else range_km(rules, track.kind, (at - track.last).total_seconds())
        if reach is not None:
            km = distance_km(track.position["spot"], spot)
            if same or km <= reach + track.position["spot"]["radius_km"] + spot["radius_km"]:
                out.append((ended and track.kind != report["kind"], not same, int(km * 1000), track.id, track.n))
    return sorted(out)


def taken(found: list[Fit], report: dict) -> list[int]:
    """The tracks that it does speak of: as many as it counts, or one; an uncounted threat speaks of all at its place."""
    if report["count"] is None and report["stance"] == "threat":
        found = [f for f in found if not f[1]] or found[:1]
    else:
        found = found[: 1 if report["count"] is None else report["count"]]
    return [f[4] for f in found]


def aimed_at(report: dict) -> dict | None:
    """The last place of a report that isn't passed by only."""
    return next((p for p in reversed(report["places"]) if not p["via"]), None)


def moved(track: Track, report: dict) -> Track:
    at, source = report["observed_at"], report["source_id"]
    kind = report["kind"] if report["kind"] in SPECIFIC and track.kind not in SPECIFIC else track.kind
    sources = track.sources if source in track.sources else (*track.sources, source)
    return track._replace(kind=kind, position=report["places"][0], last=at, path=(track.path, (report["places"][0], at)), target=aimed_at(report) or track.target, post=(source, report["evidence_id"]), sources=sources, status="active")


class Walk:
    """The live tracks of a class; ``out`` gathers events, and tracks that have ended."""

    def __init__(self, policy: FusionPolicy, hazard: str, zone: tzinfo | None):
        self.policy, self.rules = policy, policy.tracks
        self.live: dict[int, Track] = {}
        self.begun = 0
        self.out: list[dict] = []
        self.quiet_after, self.stale_after = timedelta(seconds=policy.tracks.quiet_s[hazard]), timedelta(seconds=policy.tracks.stale_s)
        self.due = datetime.min.replace(tzinfo=zone)  # nothing changes by age before

    def _keep(self, track: Track, event: str, at: datetime, ref: dict | None) -> None:
        """Every change of a track ends here: its event, its evidence, and whether it is still followed."""
        track = track._replace(seq=track.seq + 1, refs=track.refs if ref is None or event == "started" else (track.refs, ref))
        self.out.append({"track": None, "event": {"track_id": track.id, "seq": track.seq, "kind": event, "effective_at": at, "evidence": ref}})
        if track.status in ("active", "quiet"):
            self.live[track.n] = track
            self.due = min(self.due, self._due(track))
        else:
            self.live.pop(track.n, None)
            self.out.append(finished(track, self.policy))

    def _due(self, track: Track) -> datetime:
        return track.last + (self.quiet_after if track.status == "active" else self.stale_after)

    def age(self, now: datetime) -> None:
        if now < self.due:
            return
        for track in list(self.live.values()):
            while track.n in self.live and (due := self._due(track)) <= now:
                status = "quiet" if track.status == "active" else "stale"
                self._keep(track._replace(status=status), status, due, None)
                track = self.live.get(track.n, track)
        self.due = min(map(self._due, self.live.values()), default=datetime.max.replace(tzinfo=now.tzinfo))

    def take(self, report: dict) -> None:
        at, ref, stance = report["observed_at"], report["ref"], report["stance"]
        if stance == "clear":
            named = {p["id"] for p in report["places"]}
            for track in [] if report["contradicted"] else list(self.live.values()):
                if report["source_id"] in track.sources and not named.isdisjoint(track.names()):
                    left = track._replace(sources=tuple(s for s in track.sources if s != report["source_id"]))
                    if left.sources:
                        self.live[track.n] = left
                    else:
                        self._keep(left._replace(status="cleared"), "cleared", at, ref)
            return
        chosen = taken(fits(self.live.values(), report, self.rules), report)
        for number in chosen:
            track = self.live[number]
            if stance == "threat":
                self._keep(moved(track, report), "moved", at, ref)
            else:
                self._keep(track._replace(status="neutralized"), "neutralized", at, ref)
        if stance == "threat":
            self._start(report, int(not chosen) if report["count"] is None else report["count"] - len(chosen))

    def _start(self, report: dict, new: int) -> None:
        position, at = report["places"][0], report["observed_at"]
        where = position["id"] if report["statement"] is None else str(report["statement"])
        for n in range(1, new + 1):
            name = f"{self.policy.version}/track/{report['class']}/{report['evidence_id']}#{where}#{n}"
            post = (report["source_id"], report["evidence_id"])
            self.begun += 1
            self._keep(Track(self.begun, name, report["class"], report["kind"], report["count"] is None, at, position, at, (None, (position, at)), aimed_at(report), post, (report["source_id"],), (None, report["ref"])), "started", at, report["ref"])


def finished(t: Track, policy: FusionPolicy) -> dict:
    named = lambda p: None if p is None else {"id": p["id"], "name": p["name"]}
    circle = lambda p: (None, None) if p is None else ({"lon": p["spot"]["lon"], "lat": p["spot"]["lat"]}, p["spot"]["radius_km"])
    return {
        "event": None,
        "track": {
            "track_id": t.id, "policy_version": policy.version, "class": t.hazard, "kind": t.kind, "count_unknown": t.unknown, "position": named(t.position), "target": named(t.target),
            "motion": "unknown" if t.target is None else "heading", "path": [{"id": p["id"], "name": p["name"], "at": at} for p, at in unrolled(t.path)], "status": t.status, "first_at": t.first,
            "last_seen_at": t.last, "evidence": unrolled(t.refs), "center": circle(t.position)[0], "radius_km": circle(t.position)[1], "target_center": circle(t.target)[0], "target_radius_km": circle(t.target)[1],
            "region": next((p["cells"] for p in (t.target, t.position) if p and p["region"]), None), "position_region": t.position["region"], "target_region": bool(t.target and t.target["region"]),
        },
    }


FOLDED = f"track struct<{TRACK}, region array<string>, position_region boolean, target_region boolean>, event struct<{TRACK_EVENT}>"


def track_fold(policy: FusionPolicy, now: datetime):
    """The fold over one island's reports in order: tracks as they end, and events."""

    def fold(rows: Iterable[dict]) -> Iterator[dict]:
        walk, end = None, now
        for row in rows:
            zone = row["observed_at"].tzinfo
            walk = walk or Walk(policy, row["class"], zone)
            end = now.replace(tzinfo=zone) if now.tzinfo is None else now
            walk.age(row["observed_at"])
            walk.take(row)
            yield from walk.out
            walk.out.clear()
        if walk:
            walk.age(end)
            yield from walk.out
            for track in walk.live.values():
                yield finished(track, policy)

    return fold


def with_cells(tracks: DataFrame, policy: FusionPolicy, now: datetime) -> DataFrame:
    """Adds ``cells`` and ``region_cells`` of the finished tracks, by the age of what is known.

    A live track covers the corridor to its target, or a disc; its circle grows
    with the time since its last report. If that is too large, its own disc remains. Tracks may be those of ``ended``.
    """
    rules, size = policy.tracks, policy.resolution

    def cells_of(row: dict) -> list[str]:
        if row["status"] not in ("active", "quiet") or row["position_region"]:
            return []
        at = (row["center"]["lon"], row["center"]["lat"])
        ring = shapes.around(*at, row["here_km"], policy.disc_vertices)
        if row["heads_on"]:
            ring = row["ring"] and [(p["lon"], p["lat"]) for p in row["ring"]]
        for shape in (ring, shapes.around(*at, row["radius_km"], policy.disc_vertices)):
            found = outcome(lambda s=shape: shapes.texts(shapes.expanded(shapes.polygon([s], size, rules.max_cells), policy.edge_rings, rules.max_cells), size)) if shape else {"cells": None}
            if found["cells"] is not None:
                return found["cells"]
        return []

    def region_of(row: dict) -> list[str]:
        if row["status"] not in ("active", "quiet") or not row["region"]:
            return []
        grown = outcome(lambda: shapes.texts(shapes.expanded({shapes.parsed(c)[1] for c in row["region"]}, policy.edge_rings, rules.max_cells), shapes.parsed(row["region"][0])[0]))
        return grown["cells"] if grown["cells"] is not None else row["region"]

    def finish(row: dict) -> Iterator[dict]:
        kept = {n: v for n, v in row.items() if n not in ("here_km", "heads_on", "ring", "region", "position_region", "target_region")}
        yield kept | {"cells": {"resolution": size, "cells": cells_of(row)}, "region_cells": {"resolution": size, "cells": region_of(row)}}

    cells = "struct<resolution:int,cells:array<string>>"
    by = lambda values: F.create_map(*(F.lit(x) for item in values.items() for x in item))
    floor = F.element_at(by(rules.floor_km), F.col("class"))
    hours = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("last_seen_at")) / 3.6e9)
    flown = F.least(F.coalesce(F.try_element_at(by(rules.speed_kmh), F.col("kind")), F.lit(0.0)) * hours, F.lit(rules.cap_km))
    live = F.col("status").isin("active", "quiet") & ~F.col("position_region")
    heads_on = live & F.col("target").isNotNull() & (F.col("target.id") != F.col("position.id")) & ~F.col("target_region")
    there = sphere.corridor("center.lon", "center.lat", F.col("here_km"), "target_center.lon", "target_center.lat", F.greatest(F.col("target_radius_km"), floor), policy.disc_vertices)
    shaped = tracks.withColumn("here_km", F.greatest(F.col("radius_km") + flown, floor)).withColumn("heads_on", F.coalesce(heads_on, F.lit(False)))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tracks.schema if f.name not in ("region", "position_region", "target_region"))
    return map_rows(shaped.withColumn("ring", F.when(F.col("heads_on"), there)), finish, f"{kept}, cells {cells}, region_cells {cells}")


def dealt(observations: DataFrame, policy: FusionPolicy) -> DataFrame:
    """Reports with the ``class, cluster, island`` that they are walked in, and with contradicted all-clears marked.

    Clusters and silences are small tables; written, the planner knows their size, and
    reports are not shuffled (nor gathered at a few places) to meet them, unless these are large.
    """
    rules = policy.tracks
    seen = written(with_contradictions(reports(observations, policy)).withColumn("bucket", bucket_of(F.unix_micros("observed_at"), rules.stale_s)), "reports")
    placed = seen.withColumn("id", F.element_at("places", 1)["id"]).join(written(clusters(seen, rules), "clusters"), ["class", "id"]).drop("id")
    return placed.join(written(silences(placed, ["class", "cluster"], rules), "silences"), ["class", "cluster", "bucket"])


MICROSECOND = timedelta(microseconds=1)
_ENDED = TRACK.replace("path array<struct<id:string,name:string,at:timestamp>>", "steps int").replace(f"evidence array<{EVIDENCE_REF}>, ", "")
#: Rows of a walk: an event of the nth track with the place that it moved to, or the track as it ended or is.
WALKED = f"class string, cluster string, island bigint, n bigint, event struct<{TRACK_EVENT}>, place struct<id:string,name:string>, track struct<{_ENDED}, region array<string>, position_region boolean, target_region boolean>"


def walked(observations: DataFrame, policy: FusionPolicy, now: datetime) -> DataFrame:
    """``WALKED`` rows: each class, cluster and island is walked in the order of its reports."""
    from .walks import READ, column_walks

    keys, order = ["class", "cluster", "island"], ["observed_at", "source_id", "evidence_id", "statement", "alone", "turn"]
    known = dealt(observations.filter(F.col("observed_at") <= F.lit(now)), policy)
    told = known.withColumn("where", F.coalesce(F.col("statement").cast("string"), F.element_at("places", 1)["id"])).withColumn("said", F.to_json("places"))
    parsed = _parse_datatype_string(WALKED)
    assert isinstance(parsed, StructType)
    narrow = told.select(*keys, "statement", "alone", *READ).repartition(*keys).sortWithinPartitions(*keys, *order)
    return narrow.mapInArrow(column_walks(policy, now, to_arrow_schema(parsed)), parsed)


def ended(observations: DataFrame, policy: FusionPolicy, now: datetime) -> DataFrame:
    """Tracks as they ended or are, with the number of ``steps`` of their paths: for those who need neither path nor evidence."""
    return walked(observations, policy, now).filter("track is not null").select("track.*")


def with_histories(rows: DataFrame) -> DataFrame:
    """Tracks of ``WALKED`` rows with their paths and evidence, from their events."""
    e = F.col("event")
    step = F.struct(e["seq"].alias("seq"), F.when(F.col("place").isNotNull(), F.struct(F.col("place.id").alias("id"), F.col("place.name").alias("name"), e["effective_at"].alias("at"))).alias("step"), e["evidence"].alias("ref"))
    told = rows.groupBy("class", "cluster", "island", "n").agg(F.first("track", ignorenulls=True).alias("track"), F.array_sort(F.collect_list(F.when(e.isNotNull(), step))).alias("told"))
    some = lambda name: F.filter(F.transform("told", lambda x: x[name]), lambda x: x.isNotNull())
    more = ["region", "position_region", "target_region"]
    names = [f.name for f in _parse_datatype_string(TRACK).fields]
    return told.select(*(some("step").alias(n) if n == "path" else some("ref").alias(n) if n == "evidence" else F.col("track")[n].alias(n) for n in [*names, *more]))


def follow(observations: DataFrame, policy: FusionPolicy, now: datetime) -> tuple[DataFrame, DataFrame]:
    """Tracks (without cells; see ``with_cells``) and their events."""
    rows = walked(observations, policy, now)
    return with_histories(rows), rows.filter("event is not null").select("event.*")
