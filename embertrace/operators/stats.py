"""Counts and totals over the tables of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from embertrace.config import EngineConfig


def alert_count_by_rule(alerts: DataFrame, limit: int = 20) -> DataFrame:
    return (
        alerts.groupBy("rule_title").agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "rule_title").limit(limit)
    )


def rule_match_counts(matches: DataFrame, alerts: DataFrame, rules: DataFrame) -> DataFrame:
    """Matches and alerts per rule; rules that never fired count zero."""
    counts = matches.groupBy("rule_id").agg(F.count("*").alias("matches")).join(
        alerts.groupBy("rule_id").agg(F.count("*").alias("alerts")), "rule_id", "left"
    )
    zero = F.lit(0).cast("bigint")
    return rules.select("rule_id", "rule_title").join(counts, "rule_id", "left").select(
        "rule_id", "rule_title", F.coalesce("matches", zero).alias("matches"), F.coalesce("alerts", zero).alias("alerts")
    )


def _count(table: DataFrame, only: Column | None = None) -> Column:
    """Row count of a table (or of its rows that satisfy ``only``) as a scalar subquery."""
    return table.agg(F.count("*") if only is None else F.count_if(only)).scalar()


def _critical(config: EngineConfig) -> Column:
    return F.col("risk_score") >= config.risk_critical


def store_stats(
    alerts: DataFrame, chains: DataFrame, entities: DataFrame, rules: DataFrame, config: EngineConfig
) -> DataFrame:
    """One row of totals."""
    return alerts.agg(F.count("*").alias("total_alerts")).withColumns({
        "total_chains": _count(chains),
        "escalated_chains": _count(chains, F.col("is_escalated")),
        "total_entities": _count(entities),
        "critical_entities": _count(entities, _critical(config)),
        "total_rules": _count(rules, F.col("enabled")),
    })


def detection_stats(events: DataFrame, matches: DataFrame, rules: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("events_evaluated")).withColumns({
        "total_matches": _count(matches),
        "rules_loaded": _count(rules),
        "rules_enabled": _count(rules, F.col("enabled")),
    })


def correlation_stats(alerts: DataFrame, chains: DataFrame, entities: DataFrame, config: EngineConfig) -> DataFrame:
    return alerts.agg(F.count("*").alias("alerts_generated")).withColumns({
        "entities_tracked": _count(entities),
        "critical_entities": _count(entities, _critical(config)),
        "active_chains": _count(chains),
        "chains_formed": _count(chains),
        "escalated_chains": _count(chains, F.col("is_escalated")),
        "escalations": _count(chains, F.col("is_escalated")),
    })


def ingest_totals(events: DataFrame, matches: DataFrame, alerts: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("events_processed")).withColumns({
        "rules_matched": _count(matches), "alerts_fired": _count(alerts),
    })


def rule_stats(events: DataFrame, matches: DataFrame, alerts: DataFrame) -> DataFrame:
    """The most alerting rules beside the engine's totals."""
    return alert_count_by_rule(alerts).withColumns({
        "total_matches": _count(matches), "events_evaluated": _count(events),
    })


def replay_totals(events: DataFrame, alerts: DataFrame, run: str = "run_id") -> DataFrame:
    """Progress and results per replay run."""
    totals = events.groupBy(run).agg(F.count("*").alias("total_events"), F.count_if("usable").alias("processed"))
    fired = alerts.groupBy(run).agg(
        F.count("*").alias("alerts_fired"),
        F.count_if("opens_chain").alias("chains_formed"),
        F.max("chain_position").alias("max_chain_position"),
    )
    zero = F.lit(0)
    progress = F.when(F.col("total_events") == 0, 0.0).otherwise(
        F.round(F.col("processed") / F.col("total_events") * 100, 1)
    )
    return totals.join(fired, run, "left").select(
        run, "total_events", "processed", progress.alias("progress_pct"),
        F.coalesce("alerts_fired", zero.cast("bigint")).alias("alerts_fired"),
        F.coalesce("chains_formed", zero.cast("bigint")).alias("chains_formed"),
        F.coalesce("max_chain_position", zero).alias("max_chain_position"),
    )
