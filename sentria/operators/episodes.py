"""Episodes: a window of observations becomes assessments and their event log.

A pure function of observations, policy and evaluation time. Rows are
classified by expressions, dealt by (class, place) and by the island of time between
gaps that no report outlives, and cut into episodes by windows in one
total order, so any order of the input gives equal rows. Rows are narrow: the
cells of an assessment are covered when it is finished, from its first report.
``episode_fold`` is the same row by row, for a bounded window without Spark.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sphere import valid_geometry
from ..params import CLASS_OF, CLASSES, KINDS, REGION_PREFIX, STANCES, FusionPolicy
from ..schemas import EVIDENCE_REF
from .footprint import with_footprint, with_problem


class Assessed(NamedTuple):
    assessments: DataFrame
    events: DataFrame
    skipped: DataFrame


def rank_of(value: Column, names: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*map(F.lit, names)), value).cast("int") - 1


def hazard_class(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in CLASS_OF.items() for x in pair]), kind)


def is_region(place_id: Column) -> Column:
    return F.coalesce(place_id.startswith(REGION_PREFIX), F.lit(False))


def skip_code() -> Column:
    """Why an observation doesn't take part: geometry first, then region, then cover."""
    return F.when(~valid_geometry(F.col("geometry")), "invalid_geometry").when(is_region(F.col("provenance.place_id")), "region")


def place_key() -> Column:
    return F.coalesce("provenance.place_id", F.concat(F.lit("cells:"), F.coalesce("first_cell", F.lit("none"))))


def evidence_ref() -> Column:
    return F.struct("source_id", F.col("provenance.evidence_id").alias("evidence_id"), F.col("provenance.evidence_url").alias("url"), "observed_at")


def contradicted(rows: DataFrame) -> DataFrame:
    """Adds ``contradicted``: a clear whose own post also threatens its class and place. A window holds one post's rows."""
    post = Window.partitionBy("source_id", "evidence_id", "class", "key")
    return rows.withColumn("contradicted", (F.col("stance") == "clear") & F.max((F.col("stance") == "threat").cast("int")).over(post).cast("boolean"))


def usable(observations: DataFrame, policy: FusionPolicy, now: datetime) -> tuple[DataFrame, DataFrame]:
    """Rows for the fold, and ``skipped``; later rows than ``now`` are in neither."""
    seen = observations.filter(F.col("observed_at") <= F.lit(now)).withColumn("code", skip_code())
    located = with_problem(seen.filter("code is null"), policy)
    skipped = seen.filter("code is not null").select(F.col("provenance.evidence_id").alias("evidence_id"), "code").unionByName(
        located.filter("error is not null").select(F.col("provenance.evidence_id").alias("evidence_id"), F.col("error").alias("code"))
    )
    ready = located.filter("error is null").select(
        "source_id", F.col("provenance.evidence_id").alias("evidence_id"), hazard_class(F.col("kind")).alias("class"), place_key().alias("key"), "stance", "kind", "ttl", "observed_at",
        F.coalesce(F.col("provenance.place_role") != "via", F.lit(True)).alias("aimed"), F.col("provenance.place_id").alias("place_id"), F.col("provenance.place_name").alias("place_name"),
        "geometry", evidence_ref().alias("ref"),
        rank_of(F.col("stance"), STANCES).alias("stance_rank"), rank_of(F.col("kind"), KINDS).alias("kind_rank"), F.coalesce("provenance.place_order", F.lit(65535)).alias("place_order"),
    )
    return contradicted(ready), skipped


def skipped_in_order(skipped: DataFrame) -> DataFrame:
    """``skipped`` by evidence and code, dealt by ranges: for those who write or show it. ``usable`` itself doesn't sort."""
    return skipped.orderBy("evidence_id", "code")


#: Order within (class, key). The last four break ties that the policy leaves to input order.
ORDER = ["observed_at", "source_id", "evidence_id", "stance_rank", "kind_rank", "ttl", "place_order", "aimed"]
#: Rows of one place are cut into islands at gaps between buckets of so many seconds.
BUCKET_S = 6 * 3600


def with_islands(rows: DataFrame) -> DataFrame:
    """Adds ``island``: the number of gaps before a row, in its class and place, after which no earlier report is valid.

    First and last times and the longest validity of each bucket tell, so that the
    window holds four rows a day for each place, not the place's rows.
    """
    us = F.unix_micros("observed_at")
    bucketed = rows.withColumn("bucket", F.floor(us / (BUCKET_S * 1_000_000)))
    spans = bucketed.groupBy("class", "key", "bucket").agg(F.min(us).alias("first"), F.max(us + F.col("ttl").cast("long") * 1_000_000).alias("until"))
    by_time = Window.partitionBy("class", "key").orderBy("bucket")
    over = F.col("first") > F.max("until").over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    numbered = spans.withColumn("new", F.coalesce(over, F.lit(False))).select("class", "key", "bucket", F.count_if("new").over(by_time).alias("island"))
    return bucketed.join(numbered, ["class", "key", "bucket"]).drop("bucket")


class _Episode:
    """One open episode of a (class, place)."""

    def __init__(self, row: dict, policy: FusionPolicy):
        self.id = f"{policy.version}/{row['class']}/{row['key']}/{row['evidence_id']}"
        self.first, self.policy = row, policy
        self.live: dict[str, datetime] = {}
        self.kinds: set[str] = set()
        self.aimed = False
        self.refs: list[dict] = []
        self.seen: set[tuple] = set()
        self.seq, self.until = 0, row["observed_at"]

    def event(self, kind: str, at: datetime, ref: dict | None, reason: str | None = None) -> dict:
        self.seq += 1
        return {"assessment": None, "event": {"assessment_id": self.id, "seq": self.seq, "kind": kind, "effective_at": at, "evidence": ref, "reason": reason}}

    def report(self, row: dict) -> Iterator[dict]:
        at = row["observed_at"]
        self.aimed |= row["aimed"]
        self.kinds.add(row["kind"])
        self.live = {s: u for s, u in self.live.items() if u >= at} | {row["source_id"]: at + timedelta(seconds=row["ttl"])}
        self.until = max(self.live.values())
        post = (row["source_id"], row["evidence_id"])
        if post not in self.seen:
            self.seen.add(post)
            self.refs.append(row["ref"])
            yield self.event("superseded" if self.seq else "issued", at, row["ref"])

    def withdraw(self, row: dict) -> bool:
        """Take a source that still speaks out; whether none is left."""
        at, source = row["observed_at"], row["source_id"]
        if self.live.get(source, datetime.min.replace(tzinfo=at.tzinfo)) < at:
            return False
        self.live = {s: u for s, u in self.live.items() if s != source and u >= at}
        if self.live:
            self.until = max(self.live.values())
        return not self.live

    def finished(self, status: str, until: datetime, as_of: datetime) -> dict:
        active = sorted(s for s, u in self.live.items() if u > as_of) if status != "retracted" else []
        place = {"id": self.first["place_id"], "name": self.first["place_name"]} if self.first["place_id"] is not None else None
        return {
            "event": None,
            "assessment": {
                "assessment_id": self.id, "policy_version": self.policy.version, "class": self.first["class"], "kinds": sorted(self.kinds, key=KINDS.index), "place": place,
                "proximity": "target" if self.aimed else "nearby", "geometry": self.first["geometry"],
                "valid_from": self.first["observed_at"], "valid_until": until, "status": status, "revision": len(self.refs),
                "likelihood": "high" if len(active) >= 2 else "moderate", "corroboration_count": len(active), "active_sources": active, "evidence": self.refs,
            },
        }


def episode_fold(policy: FusionPolicy, now: datetime):
    """The fold over one (class, place)'s rows in order: finished assessments and events."""

    def fold(rows: Iterable[dict]) -> Iterator[dict]:
        now_ = now
        open_: _Episode | None = None
        for row in rows:
            at = row["observed_at"]
            now_ = now if now.tzinfo or not at.tzinfo else now.replace(tzinfo=at.tzinfo)
            if row["stance"] == "threat":
                if open_ and at > open_.until:
                    yield open_.event("expired", open_.until, None)
                    yield open_.finished("expired", open_.until, at)
                    open_ = None
                open_ = open_ or _Episode(row, policy)
                yield from open_.report(row)
            elif row["stance"] == "clear" and open_ and not row["contradicted"] and open_.withdraw(row):
                yield open_.event("retracted", at, row["ref"], "source_all_clear")
                yield open_.finished("retracted", open_.until, at)
                open_ = None
        if open_:
            if open_.until <= now_:
                yield open_.event("expired", open_.until, None)
                yield open_.finished("expired", open_.until, now_)
            else:
                yield open_.finished("active", open_.until, now_)

    return fold


#: After all rows of its moment.
LAST = (1 << 31) - 1
_KEYS = ("class", "key", "island")


def with_episodes(rows: DataFrame) -> DataFrame:
    """Rows of ``with_islands`` that take part, with the ``episode`` of their class, place and island.

    A source speaks from a threat until its validity ends or its own next row, be that a threat or an all-clear.
    So what is open before a row is the largest of these ends so far: a threat
    after it starts an episode, and an all-clear at which it ends takes the last source out. Adds ``n`` (place in
    order), ``starts``, ``retracts``, ``until_us`` (of a threat), ``stays`` (its source doesn't change that), ``before_us`` (validity
    of the source's row before) and ``fresh`` (first of its post in the episode). Windows only: nothing is held for a place.
    """
    told = rows.filter("stance = 'threat' or stance = 'clear' and not contradicted").withColumn("us", F.unix_micros("observed_at"))
    numbered = told.withColumn("n", F.row_number().over(Window.partitionBy(*_KEYS).orderBy(*ORDER))).withColumn("until_us", F.when(F.col("stance") == "threat", F.col("us") + F.col("ttl").cast("long") * 1_000_000))
    own, here = Window.partitionBy(*_KEYS, "source_id").orderBy("n"), Window.partitionBy(*_KEYS).orderBy("n")
    moment = lambda us, n: F.struct(us.alias("us"), n.alias("n"))
    at = moment(F.col("us"), F.col("n"))
    heard = numbered.withColumn("next", F.lead(at).over(own)).withColumn("before_us", F.lag("until_us").over(own))
    ends = F.when(F.col("until_us").isNotNull(), F.least("next", moment(F.col("until_us"), F.lit(LAST))))
    spoken = heard.withColumn("ends", ends).withColumn("open", F.max("ends").over(here.rowsBetween(Window.unboundedPreceding, -1)))
    marked = spoken.withColumn("starts", (F.col("stance") == "threat") & F.coalesce(F.col("open") < at, F.lit(True))).withColumn("retracts", (F.col("stance") == "clear") & F.coalesce(F.col("open") == at, F.lit(False)))
    counted = marked.withColumn("episode", F.count_if("starts").over(here.rowsBetween(Window.unboundedPreceding, 0))).withColumn("stays", F.coalesce(F.col("ends.n") == LAST, F.lit(False)))
    post = Window.partitionBy(*_KEYS, "episode", "source_id", "evidence_id", "stance").orderBy("n")
    taken = counted.filter("episode > 0 and (stance = 'threat' or retracts)")
    return taken.withColumn("fresh", (F.col("stance") == "threat") & (F.row_number().over(post) == 1)).drop("next", "ends", "open")


def _id(policy: FusionPolicy, evidence_id: Column) -> Column:
    return F.concat(F.lit(f"{policy.version}/"), "class", F.lit("/"), "key", F.lit("/"), evidence_id)


def _valid_until() -> Column:
    """Of an episode's rows: as the source that was taken out last said, or as those say that were not."""
    return F.coalesce(F.max(F.when(F.col("retracts"), F.col("before_us"))), F.max(F.when(F.col("stays"), F.col("until_us"))))


def _assessments(rows: DataFrame, policy: FusionPolicy, now: datetime) -> DataFrame:
    """Rows of ``with_episodes`` as assessments, with the geometry of the first of each; what isn't asked for is not gathered."""
    now_us, threat = F.unix_micros(F.lit(now).cast("timestamp")), F.col("stance") == "threat"
    first = lambda column: F.first(F.when(F.col("starts"), column), ignorenulls=True)
    found = rows.groupBy(*_KEYS, "episode").agg(
        first(F.col("evidence_id")).alias("evidence_id"), first(F.col("place_id")).alias("place_id"), first(F.col("place_name")).alias("place_name"), first(F.col("geometry")).alias("geometry"),
        first(F.col("observed_at")).alias("valid_from"), F.max(F.when(threat, F.col("aimed"))).alias("aimed"), F.max("retracts").alias("retracted"), _valid_until().alias("until_us"), F.count_if("fresh").cast("int").alias("revision"),
        F.array_sort(F.collect_set(F.when(threat, F.struct("kind_rank", "kind")))).alias("kinds"), F.collect_set(F.when(F.col("stays") & (F.col("until_us") > now_us), F.col("source_id"))).alias("live"),
        F.array_sort(F.collect_list(F.when(F.col("fresh"), F.struct("n", "ref")))).alias("told"),
    )
    active = F.when(F.col("retracted"), F.array().cast("array<string>")).otherwise(F.array_sort("live"))
    return found.withColumn("active", active).select(
        _id(policy, F.col("evidence_id")).alias("assessment_id"), F.lit(policy.version).alias("policy_version"), "class", F.col("kinds.kind").alias("kinds"),
        F.when(F.col("place_id").isNotNull(), F.struct(F.col("place_id").alias("id"), F.col("place_name").alias("name"))).alias("place"), F.when(F.col("aimed"), "target").otherwise("nearby").alias("proximity"), "geometry",
        "valid_from", F.timestamp_micros("until_us").alias("valid_until"), F.when(F.col("retracted"), "retracted").when(F.col("until_us") <= now_us, "expired").otherwise("active").alias("status"), "revision",
        F.when(F.size("active") >= 2, "high").otherwise("moderate").alias("likelihood"), F.size("active").alias("corroboration_count"), F.col("active").alias("active_sources"), F.col("told.ref").alias("evidence"),
    )


def _events(rows: DataFrame, policy: FusionPolicy, now: datetime) -> DataFrame:
    """Events of rows of ``with_episodes``; an episode's first row tells that it expired."""
    now_us, whole = F.unix_micros(F.lit(now).cast("timestamp")), Window.partitionBy(*_KEYS, "episode")
    known = rows.withColumn("seq", F.count_if("fresh").over(whole.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)).cast("int")).withColumn("posts", F.count_if("fresh").over(whole).cast("int"))
    known = known.withColumn("id", F.first(F.when(F.col("starts"), F.col("evidence_id")), ignorenulls=True).over(whole)).withColumn("retracted", F.max("retracts").over(whole)).withColumn("end_us", F.max(F.when(F.col("stays"), F.col("until_us"))).over(whole))
    event = lambda seq, kind, at, ref, reason: F.struct(seq.alias("seq"), kind.alias("kind"), at.alias("effective_at"), ref.alias("evidence"), reason.cast("string").alias("reason"))
    nothing = F.lit(None)
    told = F.array(
        F.when(F.col("fresh"), event(F.col("seq"), F.when(F.col("seq") == 1, "issued").otherwise("superseded"), F.col("observed_at"), F.col("ref"), nothing)),
        F.when(F.col("retracts"), event(F.col("posts") + 1, F.lit("retracted"), F.col("observed_at"), F.col("ref"), F.lit("source_all_clear"))),
        F.when(F.col("starts") & ~F.col("retracted") & (F.col("end_us") <= now_us), event(F.col("posts") + 1, F.lit("expired"), F.timestamp_micros("end_us"), F.when(F.lit(False), F.col("ref")), nothing)),
    )
    return known.select(_id(policy, F.col("id")).alias("assessment_id"), F.explode(F.array_compact(told)).alias("e")).select("assessment_id", "e.*")


def assess(observations: DataFrame, policy: FusionPolicy, now: datetime) -> Assessed:
    """Assessments, events and skipped rows. Sorted output: ``assessments_sorted`` and ``events_sorted``."""
    rows, skipped = usable(observations, policy, now)
    told = with_episodes(with_islands(rows.filter("stance <> 'neutralized'")))
    found = with_footprint(_assessments(told, policy, now), policy)
    covered = found.withColumn("cells", F.struct(F.lit(policy.resolution).alias("resolution"), F.col("footprint.cells").alias("cells")))
    columns = ["cells" if n == "geometry" else n for n in found.columns if n != "footprint"]
    return Assessed(covered.select(*columns), _events(told, policy, now), skipped)


def assessments_sorted(df: DataFrame) -> DataFrame:
    return df.orderBy("valid_from", "assessment_id")


def events_sorted(df: DataFrame) -> DataFrame:
    return df.orderBy("effective_at", "assessment_id", "seq")


__all__ = ["Assessed", "CLASSES", "EVIDENCE_REF", "assess", "assessments_sorted", "events_sorted", "episode_fold", "usable"]
