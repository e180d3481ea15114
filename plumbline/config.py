"""Thresholds used by the checks, the rubric and the claim audit."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    # The published default thresholds.
    alpha: float = 0.05
    fdr_q: float = 0.05
    small_d: float = 0.2
    large_d: float = 0.8
    large_r: float = 0.5
    min_n: int = 30
    warning_n: int = 50
    target_power: float = 0.80
    max_vif: float = 5.0
    min_attenuation: float = 0.7
    min_r2: float = 0.0
    leakage_importance: float = 0.95
    max_null_rate: float = 0.02
    number_tolerance: float = 0.02
    pass_score: float = 0.85
    warning_score: float = 0.5


DEFAULTS = Thresholds()

# Roles that drive the checks and the segment report.
NULL_CHECK_ROLES = ("metric", "date", "quantity", "price")
NEGATIVE_CHECK_ROLES = ("metric", "price", "quantity")
SEGMENT_ROLES = ("segment", "region", "product", "channel")
