"""Engine configuration: validated once, hashed, and carried as a literal column."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields
from datetime import date
from pathlib import Path

from .errors import ConfigError


@dataclass(frozen=True)
class ClassGroups:
    """Which scene classes 0..11 count as what; every class is in exactly one group."""

    # The groups of the classes.
    nodata: tuple[int, ...] = (0,)
    defective: tuple[int, ...] = (1,)
    shadow: tuple[int, ...] = (2, 3)
    clear: tuple[int, ...] = (4, 5, 6)
    unclassified: tuple[int, ...] = (7,)
    cloud: tuple[int, ...] = (8, 9, 10)
    snow: tuple[int, ...] = (11,)

    def __post_init__(self) -> None:
        members = sorted(c for f in fields(self) for c in getattr(self, f.name))
        if members != list(range(12)):
            raise ConfigError("class groups must hold each of the classes 0 to 11 once")


@dataclass(frozen=True)
class Config:
    start: date
    end: date
    aois: tuple[str, ...] = ()
    collection: str = "default"
    data_dir: str = "data"
    horizon_days: int = 60
    late_overlap_days: int = 7
    min_clear: float = 0.8
    min_coverage: float = 0.95
    classes: ClassGroups = field(default_factory=ClassGroups)

    def __post_init__(self) -> None:
        if self.end < self.start:
            raise ConfigError("end lies before start")
        if len(set(self.aois)) != len(self.aois):
            raise ConfigError("an entity is listed twice")
        if "ALL" in self.aois:
            raise ConfigError("'ALL' names the pool of entities and cannot be one")
        if self.horizon_days <= 0 or self.late_overlap_days < 0:
            raise ConfigError("horizon_days must be positive and late_overlap_days not negative")
        for name in ("min_clear", "min_coverage"):
            if not 0 <= getattr(self, name) <= 1:
                raise ConfigError(f"{name} must lie in [0, 1]")

    @property
    def config_hash(self) -> str:
        """SHA-256 of all settings as canonical JSON: rows of different settings coexist."""
        text = json.dumps(asdict(self), sort_keys=True, separators=(",", ":"), default=str)
        return hashlib.sha256(text.encode()).hexdigest()

    @property
    def n_start_days(self) -> int:
        return (self.end - self.start).days - self.horizon_days + 1

    def require_horizon(self) -> None:
        if self.n_start_days < 1:
            raise ConfigError("the period is shorter than the horizon")


def load_config(path: str | Path) -> Config:
    """Read a YAML or JSON file; unknown keys are errors."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text()) or {}
    known = {f.name for f in fields(Config)}
    if extra := set(raw) - known:
        raise ConfigError(f"unknown settings: {', '.join(sorted(extra))}")
    for key in ("start", "end"):
        if isinstance(raw.get(key), str):
            raw[key] = date.fromisoformat(raw[key])
    if "aois" in raw:
        raw["aois"] = tuple(raw["aois"])
    if "classes" in raw:
        raw["classes"] = ClassGroups(**{k: tuple(v) for k, v in raw["classes"].items()})
    return Config(**raw)
