"""Thresholds of the track strategy (fixed values; they decide results)."""

from __future__ import annotations

from dataclasses import dataclass

SECOND = 1_000_000_000


@dataclass(frozen=True)
class Strategy:
    future_tolerance: int = 1 * SECOND
    max_age: int = 30 * SECOND
    max_accuracy: float = 80.0
    first_good: float = 20.0
    first_relaxed: float = 30.0
    first_forced: float = 50.0
    first_weak: float = 80.0
    ordinary: float = 30.0
    still_metres: float = 5.0
    still_factor: float = 1.5
    impossible_speed: float = 12.0
    transport_speed: float = 3.5
    transport_top_speed: float = 45.0
    transport_metres: float = 60.0
    transport_metres_with_speed: float = 20.0
    transport_seconds: float = 10.0
    keepalive: int = 30 * SECOND
    gap: int = 120 * SECOND
    recovery_stable: int = 15 * SECOND
    recovery_speed: float = 2.5
    recovery_metres: float = 12.0
    # Rest handling.
    rest_speed: float = 0.5
    rest_radius: float = 15.0
    rest_factor: float = 1.5
    evidence_window: int = 5 * SECOND
    evidence_summaries: int = 2
    evidence_samples: int = 12
    evidence_ratio: float = 0.75
    rest_points: int = 2
    rest_nanos: int = 20 * SECOND
    moving_points: int = 2
    far_metres: float = 20.0
    moving_metres: float = 8.0
    latest_still_age: int = 2 * SECOND
    block_score: float = 0.70
    block_rms: float = 0.10
    motion_kept: int = 8


DEFAULT = Strategy()
EARTH_RADIUS = 6_371_000.0
