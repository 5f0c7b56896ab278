"""Tables' columns and the search configuration."""

from __future__ import annotations

from dataclasses import dataclass, replace

ZONES = ("title", "summary", "description", "conditions", "interventions", "inclusion", "exclusion")
TITLE, SUMMARY, DESCRIPTION, CONDITIONS, INTERVENTIONS, INCLUSION, EXCLUSION = range(7)
ZONE_BASE = 10_000_000
ITEM_GAP = 64
MOST_TF = 255
NO_MAX_AGE = 999.0
CHAMPIONS = 500
# Weights of the zones in a posting's champion impact.
CHAMPION_WEIGHTS = (3.0, 1.0, 0.3, 3.0, 1.0, 1.0, 0.0)
TFS = [f"tf{z}" for z in range(7)]
ZLENS = [f"zlen{z}" for z in range(7)]

TRIAL = (
    "doc bigint, id string, title string, official string, summary string, description string, conditions array<string>, "
    "interventions array<string>, inclusion string, exclusion string, gender string, min_age double, max_age double, "
    "status string, phase string, type string"
)


@dataclass(frozen=True)
class Config:
    """Search settings; the defaults are fixed values."""

    model: str = "bm25f"
    abbrev: bool = True
    negation: bool = True
    family: bool = True
    zone_w: tuple[float, ...] = (2.0, 1.0, 0.5, 2.0, 0.5, 1.0, 0.0)
    zone_b: tuple[float, ...] = (0.5, 0.75, 0.75, 0.5, 0.5, 0.75, 0.75)
    k1: float = 1.2
    b: float = 0.75
    k3: float = 8.0
    max_terms: int = 0
    champions: bool = False
    params: str = "off"
    soft: float = 0.5
    exc_w: float = 0.0
    neg_w: float = 0.0
    pen_ratio: float = 0.0
    prf_docs: int = 0
    prf_terms: int = 10
    prf_w: float = 0.5
    neural: bool = False
    rerank_k: int = 100
    alpha: float = 0.5
    inc_view: float = 0.4
    exc_view: float = 0.1
    elig_w: float = 0.2
    k: int = 20

    def but(self, **changes) -> Config:
        return replace(self, **changes)
