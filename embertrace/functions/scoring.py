"""Risk and severity lookups."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from embertrace.config import EngineConfig
from embertrace.functions.common import lookup

# --- fixed values: risk points and severities by rule level ------------------
RISK_BY_LEVEL = {"informational": 2, "low": 5, "medium": 10, "high": 20, "critical": 35}
RISK_OTHER_LEVEL = 5
CHAIN_BONUS = 15
RISK_MAX = 100
SEVERITY_BY_LEVEL = {"informational": 1, "low": 3, "medium": 5, "high": 7, "critical": 10}
SEVERITY_OTHER_LEVEL = 5
HIGH_RISK_SCORE = 50
CRITICAL_SCORE = 75
# --- end of fixed values ------------------------------------------------------


def risk_points(level: Column) -> Column:
    return lookup(RISK_BY_LEVEL, F.lower(level), RISK_OTHER_LEVEL)


def rule_severity(level: Column, config: EngineConfig) -> Column:
    """Severity of a rule; observed semantics do not know ``informational``."""
    known = dict(SEVERITY_BY_LEVEL)
    if not config.documented:
        del known["informational"]
    return lookup(known, F.lower(level), SEVERITY_OTHER_LEVEL)


def risk_level(score: Column, config: EngineConfig) -> Column:
    return (
        F.when(score >= config.risk_critical, "CRITICAL")
        .when(score >= config.risk_high, "HIGH")
        .when(score >= config.risk_medium, "MEDIUM")
        .otherwise("LOW")
    )
