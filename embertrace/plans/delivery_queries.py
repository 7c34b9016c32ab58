"""Queries over tables that were built delivery by delivery, with late rows and a repeated batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from embertrace.plans.oracle import on_alerts, on_tables
from embertrace.plans.registry import query
from embertrace.plans.runs import delivered


@query(on_alerts("""SELECT alert_id, entity_name, chain_id, chain_position, is_new_link, entity_risk_before, entity_risk_after,
    chain_risk_before, chain_risk_after, is_escalated, entity_host FROM alerts"""))
def late_alerts(spark, sf_dir):
    """Alerts after three deliveries, the last of them late by up to the whole time span."""
    return delivered(spark, sf_dir).read("alerts").select(
        "alert_id", "entity_name", "chain_id", "chain_position", "is_new_link", "entity_risk_before", "entity_risk_after",
        "chain_risk_before", "chain_risk_after", "is_escalated", "entity_host",
    )


@query(on_tables("""SELECT chain_id, entity_name, entity_host, started_at, updated_at, risk_score, risk_level, is_escalated,
    link_count, alert_count, stage_progression, duration_minutes FROM chains"""))
def late_chains(spark, sf_dir):
    """Chains after the deliveries."""
    return delivered(spark, sf_dir).read("chains").select(
        "chain_id", "entity_name", "entity_host", "started_at", "updated_at", "risk_score", "risk_level", "is_escalated",
        "link_count", "alert_count", "stage_progression", "duration_minutes",
    )


@query(on_tables("""SELECT entity_id, name, type, host, first_seen, last_seen, risk_score, risk_level, peak_risk, total_alerts,
    active_chain_id, total_chains FROM entities"""))
def late_entities(spark, sf_dir):
    """Entities after the deliveries."""
    return delivered(spark, sf_dir).read("entities").select(
        "entity_id", "name", "type", "host", "first_seen", "last_seen", "risk_score", "risk_level", "peak_risk", "total_alerts",
        "active_chain_id", "total_chains",
    )


@query(on_tables("SELECT chain_id, risk_score, link_count, alert_count FROM chains"))
def chain_change_feed(spark, sf_dir):
    """The chains that a reader of the change feed ends up with: the last word on each, unless it was taken back."""
    store = delivered(spark, sf_dir)
    feed = store.read_with_commits("chain_changes")
    last = feed.groupBy("chain_id").agg(F.max_by(F.struct("change", "risk_score", "link_count", "alert_count"), "commit").alias("last"))
    return last.filter("last.change = 'update'").select("chain_id", "last.risk_score", "last.link_count", "last.alert_count")
