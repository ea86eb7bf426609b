"""Settings and their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from .operators.cluster import Limits as ClusterLimits
from .operators.naming import Affixes
from .operators.pii import Override


@dataclass
class QueryLimits:
    max_rows: int = 50
    max_cell_chars: int = 256
    max_payload_bytes: int = 16384
    max_statements: int = 10
    timeout_seconds: float = 30


@dataclass
class Config:
    data_dir: str | None = None
    database: str | None = None
    scope: list[str] = field(default_factory=list)
    query: QueryLimits = field(default_factory=QueryLimits)
    cluster: ClusterLimits = field(default_factory=ClusterLimits)
    affixes: Affixes = field(default_factory=Affixes)
    pii_overrides: list[Override] = field(default_factory=list)
    blob_overrides: set[str] = field(default_factory=set)
    rank_hints: list[str] = field(default_factory=list)
    profile_top_n: int = 25
    profile_freshness_hours: int = 24
    auto_profile: bool = True
    max_full_profile_bytes: int | None = None  # beyond it a profile reads a sample
    budget_bytes: int | None = None  # ceiling of one session's scans


_PARTS = {"query": QueryLimits, "cluster": ClusterLimits, "affixes": Affixes}


def from_dict(data: dict) -> Config:
    """Unknown keys are errors: a misspelt limit must not be silently absent."""
    out = Config()
    for k, v in data.items():
        if k not in Config.__dataclass_fields__:
            raise ValueError(f"unknown setting {k}")
        if k in _PARTS:
            unknown = set(v) - set(_PARTS[k].__dataclass_fields__)
            if unknown:
                raise ValueError(f"unknown setting {k}.{min(unknown)}")
            v = _PARTS[k](**v)
        elif k == "pii_overrides":
            v = [Override(**x) for x in v]
        elif k == "blob_overrides":
            v = {x.lower() for x in v}
        setattr(out, k, v)
    return out


def load(path: str | Path) -> Config:
    """From YAML; a missing file means defaults."""
    p = Path(path)
    if not p.exists():
        return Config()
    import yaml

    return from_dict(yaml.safe_load(p.read_text()) or {})
