"""Named parameter sets. Policies are versioned; a version never changes its values."""

from __future__ import annotations

from dataclasses import dataclass, field

EARTH_KM = 6371.0088
REGION_PREFIX = "ua-adm1:"

#: Hazard kinds of observations in vocabulary order (fixed values).
KINDS = ("air.ballistic_missile", "air.missile", "air.attack_drone", "air.jet_drone", "air.guided_bomb")
#: Class of each kind (fixed values).
CLASS_OF = {
    "air.attack_drone": "drone",
    "air.jet_drone": "drone",
    "air.guided_bomb": "bomb",
    "air.missile": "missile",
    "air.ballistic_missile": "missile",
}
#: Classes in order of declaration, which is also their sort order.
CLASSES = ("drone", "bomb", "missile")
#: Kinds that say more than others of their class.
SPECIFIC = ("air.jet_drone", "air.ballistic_missile")
STANCES = ("threat", "clear", "neutralized")


class UnknownPolicy(ValueError):
    """No policy has this version."""


@dataclass(frozen=True)
class TrackPolicy:
    quiet_s: dict[str, int] = field(default_factory=lambda: {"drone": 3600, "bomb": 1800, "missile": 1800})
    stale_s: int = 21600
    #: km/h; a kind without speed never reaches another place
    speed_kmh: dict[str, float] = field(default_factory=lambda: {"air.attack_drone": 200.0, "air.jet_drone": 700.0, "air.missile": 1000.0})
    bomb_reach_km: float = 70.0
    margin_km: float = 10.0
    cap_km: float = 40.0
    floor_km: dict[str, float] = field(default_factory=lambda: {"drone": 15.0, "bomb": 15.0, "missile": 25.0})
    max_cells: int = 3000


@dataclass(frozen=True)
class FusionPolicy:
    version: str = "fusion.v1"
    resolution: int = 6
    edge_rings: int = 1
    max_cells: int = 400
    point_radius_km: float = 10.0
    disc_vertices: int = 48
    tracks: TrackPolicy = field(default_factory=TrackPolicy)


@dataclass(frozen=True)
class GridProfile:
    """Resolutions that a deployment uses: for broadcasts, and for proximity and map aggregation."""

    broadcast: int
    proximity: int


GRID_PROFILES = {"current": GridProfile(7, 8)}

POLICIES = {"fusion.v1": FusionPolicy()}


def policy(version: str) -> FusionPolicy:
    if version not in POLICIES:
        raise UnknownPolicy(f"unknown policy {version!r}")
    return POLICIES[version]


#: Minutes that a report of the role reader stays valid, by kind and for what ends a threat (fixed values).
BRIDGE_TTL_MIN = {"drone": 30, "guided_bomb": 15, "cruise_missile": 20, "ballistic_missile": 20, "missile": 20, "clear": 10}
#: The same for the point reader.
POINT_TTL_MIN = {"air.ballistic_missile": 15, "air.missile": 30, "air.attack_drone": 60, "air.jet_drone": 30, "air.guided_bomb": 15, "clear": 10}
#: Reader kinds to contract kinds.
CONTRACT_KIND = {
    "drone": "air.attack_drone",
    "guided_bomb": "air.guided_bomb",
    "cruise_missile": "air.missile",
    "ballistic_missile": "air.ballistic_missile",
    "missile": "air.missile",
}

MAX_EVIDENCE, MAX_OBSERVATIONS, MAX_COVER_CELLS, MAX_REGION_CELLS = 500, 5000, 400, 5000
MAX_TEXT_CHARS = 500
