"""Settings: thresholds and budgets, immutable, with environment overrides."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace


def within(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must lie between {low} and {high}, not at {value}")


def falling(name: str, values: tuple[float, ...]) -> None:
    if list(values) != sorted(values, reverse=True):
        raise ValueError(f"{name} must not rise: {values}")


def parsed(text: str, now):
    """A setting's text as the kind of value it has now; a tuple's items are separated by commas."""
    if isinstance(now, bool):
        return text.strip().lower() in ("1", "true", "yes")
    if isinstance(now, tuple):
        kind = type(now[0]) if now else str
        return tuple(kind(x.strip()) for x in text.split(",") if x.strip())
    return type(now)(text)


@dataclass(frozen=True)
class EngineSettings:
    profile: str = "balanced"
    max_rows: int = 1_000_000
    max_findings: int = 50
    fail_fast: bool = False
    enabled_modules: tuple[str, ...] = ()
    disabled_modules: tuple[str, ...] = ()
    cohesion: float = 0.46
    evidence_share: float = 0.60

    def __post_init__(self):
        if self.profile not in ("balanced", "full"):
            raise ValueError(f"unknown profile {self.profile!r}")
        within("max_rows", self.max_rows, 100, float("inf"))
        within("max_findings", self.max_findings, 1, 500)
        within("cohesion", self.cohesion, 0, 1)
        within("evidence_share", self.evidence_share, 0, 1)


#: Fixed values below: the thresholds and budgets that decide severities, detections and samples.
@dataclass(frozen=True)
class IntegritySettings:
    missing: tuple[float, float, float, float] = (0.50, 0.30, 0.10, 0.05)
    empty: float = 0.99
    duplicates: tuple[float, float, float, float] = (0.20, 0.10, 0.05, 0.01)
    constant: float = 0.9999
    near_constant: float = 0.95
    high_cardinality: float = 0.90
    low_cardinality: int = 2
    id_unique: float = 0.95
    #: Name parts that mark an identifier column.
    id_patterns: tuple[str, ...] = ("id", "uuid", "uid", "key", "code", "identifier", "index", "pk", "serial", "number", "num", "no")
    #: Rows whose text values are typed; 0: all.
    type_sample: int = 0
    numeric_text: float = 0.80
    mixed_minority: float = 0.01
    missing_r: float = 0.70
    missing_min_ratio: float = 0.01
    missing_rows: int = 50_000

    def __post_init__(self):
        for name in ("missing", "duplicates"):
            falling(name, getattr(self, name))
        for name in (
            "empty",
            "constant",
            "near_constant",
            "high_cardinality",
            "numeric_text",
            "mixed_minority",
            "missing_r",
            "missing_min_ratio",
        ):
            within(name, getattr(self, name), 0, 1)


@dataclass(frozen=True)
class RelationshipSettings:
    pearson: float = 0.80
    spearman: float = 0.80
    redundancy: float = 0.95
    strong: float = 0.90
    community: float = 0.75
    mutual_information: float = 0.20
    vif: tuple[float, float] = (10.0, 5.0)
    min_rows: int = 30
    pearson_rows: int = 50_000
    spearman_rows: int = 25_000
    vif_rows: int = 50_000
    candidates: int = 200
    mi_rows: int = 5_000
    mi_columns: int = 150
    mi_pairs: int = 500
    neighbours: int = 3
    #: Names that mark a target column.
    target_names: tuple[str, ...] = ("target", "label", "class", "response", "outcome", "y")

    def __post_init__(self):
        falling("vif", self.vif)
        for name in ("pearson", "spearman", "redundancy", "strong", "community"):
            within(name, getattr(self, name), 0, 1)
        for name in (
            "min_rows",
            "pearson_rows",
            "spearman_rows",
            "vif_rows",
            "candidates",
            "mi_rows",
            "mi_columns",
            "mi_pairs",
            "neighbours",
        ):
            within(name, getattr(self, name), 1, float("inf"))


@dataclass(frozen=True)
class CompressionSettings:
    algorithm: str = "louvain"
    edge: float = 0.18
    max_bucket: int = 250
    repeats: int = 3
    resolution: float = 1.0
    seed: int = 42

    def __post_init__(self):
        if self.algorithm not in ("louvain", "greedy_modularity", "connected_components"):
            raise ValueError(f"unknown community algorithm {self.algorithm!r}")
        within("edge", self.edge, 0, 1)
        within("repeats", self.repeats, 1, 100)


@dataclass(frozen=True)
class Settings:
    engine: EngineSettings = field(default_factory=EngineSettings)
    integrity: IntegritySettings = field(default_factory=IntegritySettings)
    relationship: RelationshipSettings = field(default_factory=RelationshipSettings)
    compression: CompressionSettings = field(default_factory=CompressionSettings)

    @property
    def full(self) -> bool:
        return self.engine.profile == "full"

    @classmethod
    def from_environment(cls, prefix: str = "SIFTER_") -> Settings:
        """Overrides such as SIFTER_ENGINE__PROFILE=full or SIFTER_INTEGRITY__MISSING=0.5,0.3,0.1,0.05; values out of range are refused."""
        made = cls()
        for part in fields(made):
            group = getattr(made, part.name)
            texts = {f.name: os.environ.get(f"{prefix}{part.name}__{f.name}".upper()) for f in fields(group)}
            changes = {k: parsed(v, getattr(group, k)) for k, v in texts.items() if v is not None}
            made = replace(made, **{part.name: replace(group, **changes)})
        return made
