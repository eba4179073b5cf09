"""Thresholds of all detectors in one place."""

from __future__ import annotations

from dataclasses import dataclass, field

from finsieve import vocab


@dataclass(frozen=True)
class DetectionOptions:
    """Settings handed to the detectors; defaults are the production thresholds."""

    ring_min_hops: int = 3
    ring_max_hops: int = 5
    ring_window_hours: int = 168
    max_travel_speed_kmh: float = 900.0
    location_ttl_hours: int = 24
    blacklist: tuple[str, ...] = field(default=vocab.BLACKLIST_KEYWORDS)
    critical_words: tuple[str, ...] = field(default=vocab.CRITICAL_KEYWORDS)
    critical_score: float = vocab.CRITICAL_SCORE
    reporting_limit: float = 10_000.0
    structuring_band: float = 0.10
    structuring_min_count: int = 3
    velocity_count_24h: int = 10
    mule_unique_senders_7d: int = 5
    high_value_amount: float = 150_000.0

    def __post_init__(self) -> None:
        if not 2 <= self.ring_min_hops <= self.ring_max_hops <= 10:
            raise ValueError("ring hops must satisfy 2 <= min <= max <= 10")
        if self.max_travel_speed_kmh <= 0:
            raise ValueError("max_travel_speed_kmh must be positive")
