"""Parameters of the operators. Frozen, so that a run can be described by their values."""

from __future__ import annotations

from dataclasses import dataclass, field

US = 1_000_000


@dataclass(frozen=True)
class GroupConfig:
    """Session, pair, bracket and expiry limits; seconds."""

    session_gap: float = 4 * 3600
    pair_window: float = 3600
    bracket_max_gap: float = 15
    bracket_max_count: int = 7
    bracket_min_span: float = 0.5
    usable_after: int = 1_104_537_600  # 2005-01-01 UTC
    utility_expiry: float = 30 * 86_400
    utility_full_age: float = 180 * 86_400


@dataclass(frozen=True)
class QualityConfig:
    broken_uniformity: float = 0.995
    broken_clip: float = 0.97
    bad_sharpness: float = 12.0
    bad_clip: float = 0.15


@dataclass(frozen=True)
class NearConfig:
    """Steps of (gap in seconds, greatest distance), by increasing gap."""

    steps: tuple[tuple[float, float], ...] = ((3, 0.45), (120, 0.35), (3600, 0.25))
    max_gap: float = 86_400


@dataclass(frozen=True)
class PrintParams:
    revision: int = 2
    crop: str = "scaleFill"


@dataclass(frozen=True)
class Engine:
    group: GroupConfig = field(default_factory=GroupConfig)
    near: NearConfig = field(default_factory=NearConfig)
    quality: QualityConfig = field(default_factory=QualityConfig)
    prints: PrintParams = field(default_factory=PrintParams)
