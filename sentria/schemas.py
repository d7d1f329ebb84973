"""Row types of the engine as Spark DDL."""

from __future__ import annotations

EVIDENCE = (
    "source_id string, external_id string, published_at timestamp, edited boolean, text string, "
    "media array<struct<kind:string,url:string>>, forwarded_from string, provenance struct<url:string,collector:string>"
)
PLACE_MENTION = "struct<place_id:string,name:string,lat:double,lon:double,reach_km:int,role:string>"
READING = (
    "source_id string, external_id string, published_at timestamp, url string, forwarded boolean, statement int, kind string, "
    f"kind_inherited boolean, phase string, count int, places array<{PLACE_MENTION}>, unresolved array<string>"
)
GEOMETRY = "struct<type:string,coordinates:array<double>,rings:array<array<array<double>>>,resolution:int,cells:array<string>>"
OBSERVATION_PROVENANCE = (
    "struct<evidence_id:string,evidence_url:string,normalizer:string,matched:array<string>,place_id:string,place_name:string,"
    "place_role:string,statement:int,place_order:int>"
)
OBSERVATION = f"source_id string, kind string, stance string, count int, observed_at timestamp, geometry {GEOMETRY}, ttl int, confidence string, provenance {OBSERVATION_PROVENANCE}"
EVIDENCE_REF = "struct<source_id:string,evidence_id:string,url:string,observed_at:timestamp>"
ASSESSMENT = (
    "assessment_id string, policy_version string, class string, kinds array<string>, place struct<id:string,name:string>, proximity string, "
    "cells struct<resolution:int,cells:array<string>>, valid_from timestamp, valid_until timestamp, status string, revision int, likelihood string, "
    f"corroboration_count int, active_sources array<string>, evidence array<{EVIDENCE_REF}>"
)
ASSESSMENT_EVENT = f"assessment_id string, seq int, kind string, effective_at timestamp, evidence {EVIDENCE_REF}, reason string"
TRACK = (
    "track_id string, policy_version string, class string, kind string, count_unknown boolean, position struct<id:string,name:string>, "
    "target struct<id:string,name:string>, motion string, path array<struct<id:string,name:string,at:timestamp>>, status string, first_at timestamp, "
    f"last_seen_at timestamp, evidence array<{EVIDENCE_REF}>, center struct<lon:double,lat:double>, radius_km double, "
    "target_center struct<lon:double,lat:double>, target_radius_km double"
)
TRACK_EVENT = f"track_id string, seq int, kind string, effective_at timestamp, evidence {EVIDENCE_REF}"
SKIPPED = "evidence_id string, code string"

SOURCE_ID = r"^[a-z0-9_.-]+:[a-z0-9_.-]+$"
EXTERNAL_ID = r"^[\x21-\x7e]+$"
