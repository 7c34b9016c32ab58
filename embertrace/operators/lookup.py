"""Filters, point lookups and top-k lists over the stored tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from embertrace.config import EngineConfig


def get_alerts(
    alerts: DataFrame, entity_name: str | None = None, since: datetime | None = None, chain_id: str | None = None,
    min_severity: int = 0, is_replay: bool | None = None, limit: int | None = 200,
) -> DataFrame:
    """Alerts by any mix of filters, newest first (C26, G2). ``limit=None`` lists all."""
    if entity_name:
        alerts = alerts.filter(F.col("entity_name") == entity_name)
    if since:
        alerts = alerts.filter(F.col("timestamp") >= F.lit(since))
    if chain_id:
        alerts = alerts.filter(F.col("chain_id") == chain_id)
    if min_severity:
        alerts = alerts.filter(F.col("severity") >= min_severity)
    if is_replay is not None:
        alerts = alerts.filter(F.col("is_replay") == is_replay)
    listed = alerts.orderBy(F.desc("timestamp"), "alert_id")
    return listed if limit is None else listed.limit(limit)


def get_chains(
    chains: DataFrame, entity_name: str | None = None, is_escalated: bool | None = None, min_risk: int = 0,
    limit: int | None = 100,
) -> DataFrame:
    """Chains by any mix of filters, last updated first."""
    if entity_name:
        chains = chains.filter(F.col("entity_name") == entity_name)
    if is_escalated is not None:
        chains = chains.filter(F.col("is_escalated") == is_escalated)
    if min_risk:
        chains = chains.filter(F.col("risk_score") >= min_risk)
    listed = chains.orderBy(F.desc("updated_at"), "chain_id")
    return listed if limit is None else listed.limit(limit)


def get_entities(entities: DataFrame, min_risk: int = 0, limit: int | None = 500) -> DataFrame:
    """Entities by risk, highest first."""
    listed = entities.filter(F.col("risk_score") >= min_risk).orderBy(F.desc("risk_score"), "name")
    return listed if limit is None else listed.limit(limit)


def critical_entities(entities: DataFrame, config: EngineConfig) -> DataFrame:
    return get_entities(entities, config.risk_critical, limit=None)


def escalated_chains(chains: DataFrame) -> DataFrame:
    return chains.filter("is_escalated").orderBy(F.desc("risk_score"), "chain_id")


def chain_alerts(alerts: DataFrame, chains: DataFrame, limit: int | None = 500) -> DataFrame:
    """Alerts of the given chains, the newest ``limit`` of each, or all."""
    from embertrace.operators.store import per_key_newest

    chosen = alerts.join(chains.select("chain_id"), "chain_id", "left_semi")
    if limit is None:
        return chosen
    return per_key_newest(chosen, ["chain_id"], [F.desc("timestamp"), F.col("alert_id")], limit)


def entity_chains(chains: DataFrame, entity_name: str, limit: int | None = 50) -> DataFrame:
    return get_chains(chains, entity_name=entity_name, limit=limit)


def by_key(table: DataFrame, key: str, value: str) -> DataFrame:
    """Point lookup."""
    return table.filter(F.col(key) == value)


def get_rules(rules: DataFrame, enabled_only: bool = True) -> DataFrame:
    return (rules.filter("enabled") if enabled_only else rules).orderBy("title", "rule_id")


def replay_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    return runs.orderBy(F.desc_nulls_last("started_at"), "job_id").limit(limit)


def with_archive(hot: DataFrame, cold: DataFrame, key: str) -> DataFrame:
    """Hot rows, and stored rows whose key is not hot."""
    return hot.unionByName(cold.join(hot.select(key), key, "left_anti"))


def alert_summary(alerts: DataFrame) -> DataFrame:
    return alerts.select(
        "alert_id", "timestamp", "rule_title", "entity_name", "entity_host", "severity", "chain_id", "mitre_id",
        "chain_stage", "is_replay",
    )


def entity_summary(entities: DataFrame) -> DataFrame:
    from embertrace.functions.scoring import CRITICAL_SCORE, HIGH_RISK_SCORE

    return entities.select(
        "entity_id", "name", "type", "host", "risk_score", "risk_level", "total_alerts", "total_chains", "last_seen",
        (F.col("risk_score") >= CRITICAL_SCORE).alias("is_critical"),
        (F.col("risk_score") >= HIGH_RISK_SCORE).alias("is_high_risk"),
    )


def chain_summary(chains: DataFrame) -> DataFrame:
    return chains.select(
        "chain_id", "entity_name", "risk_score", "risk_level", "link_count", "stage_progression", "started_at",
        "updated_at", "is_escalated", "duration_minutes",
    )
