"""Roll alerts up into the ``chains`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from embertrace.config import EngineConfig
from embertrace.functions.scoring import risk_level
from embertrace.operators.chains import ORDER
from embertrace.operators.narrate import (
    chain_narrative, investigation_sql, lookback_start, minutes_between, stage_progression,
)


def chain_times(alerts: DataFrame) -> DataFrame:
    """Start of the chain and its last update as of each alert.

    Partitioned like the fold that made the chains, so nothing is shuffled.
    """
    so_far = (
        Window.partitionBy("entity_name", "island", "chain_id").orderBy(*ORDER)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return alerts.withColumns({
        "chain_started_at": F.min("timestamp").over(so_far),
        "chain_updated_at": F.max(F.when(F.col("is_new_link"), F.col("timestamp"))).over(so_far),
    })


def chain_links(alerts: DataFrame, config: EngineConfig) -> DataFrame:
    """One row per chain link (F3): the alerts that added a rule to their chain."""
    since = lookback_start(F.col("timestamp"), config)
    return alerts.filter("is_new_link").select(
        "chain_id", F.col("chain_position").alias("position"), "alert_id", "timestamp", "rule_title", "chain_stage",
        "mitre_id", "entity_name", "severity",
        investigation_sql(F.col("entity_name"), since).alias("investigation_sql"),
    )


def chain_rollup(alerts: DataFrame, config: EngineConfig) -> DataFrame:
    """The ``chains`` table plus derived list-view columns.

    An array holds one entry per link, and a chain has at most one link per
    rule title; repeats only enter counts and sums.
    """
    since = lookback_start(F.col("timestamp"), config)
    link = F.struct(
        F.col("chain_position").alias("position"), "alert_id", "timestamp", "rule_title", "chain_stage", "mitre_id",
        "entity_name", "severity", investigation_sql(F.col("entity_name"), since).alias("investigation_sql"),
    )
    order = F.struct(*ORDER)
    new = F.col("is_new_link")
    new_order = F.when(new, order)
    chains = alerts.groupBy("chain_id").agg(
        F.first("entity_name").alias("entity_name"),
        F.min_by("entity_type", order).alias("entity_type"),
        F.min_by("entity_host", order).alias("entity_host"),
        F.min("timestamp").alias("started_at"),
        F.max(F.when(new, F.col("timestamp"))).alias("updated_at"),
        F.max("chain_risk_after").alias("risk_score"),
        F.max("is_escalated").alias("is_escalated"),
        F.count_if(new).cast("int").alias("link_count"),
        F.count("*").alias("alert_count"),
        F.array_sort(F.collect_list(F.when(new, link))).alias("links"),
        F.max_by("chain_risk_before", new_order).alias("risk_at_last_link"),
        F.max_by(F.col("is_escalated") & ~F.col("escalates"), new_order).alias("escalated_before_last_link"),
    )
    return (
        chains.withColumn("stages_seen", F.array_distinct(F.transform("links", lambda item: item["chain_stage"])))
        .withColumn("risk_level", risk_level(F.col("risk_score"), config))
        .withColumn("duration_minutes", minutes_between(F.col("started_at"), F.col("updated_at")))
        .withColumn("is_confirmed", F.col("link_count") >= config.chain_min_rules)
        .withColumn("stage_progression", stage_progression(F.col("stages_seen")))
        .withColumn("narrative", chain_narrative())
        .withColumn("ai_summary", F.lit(None).cast("string"))
        .drop("risk_at_last_link", "escalated_before_last_link")
    )


CHAIN_COLUMNS = [
    "chain_id", "entity_name", "entity_type", "entity_host", "started_at", "updated_at", "risk_score", "risk_level",
    "stages_seen", "is_escalated", "link_count", "links", "narrative", "ai_summary",
]
