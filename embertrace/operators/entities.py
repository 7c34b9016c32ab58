"""Entity attributes and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from embertrace.config import EngineConfig
from embertrace.functions.common import stable_id, truthy
from embertrace.functions.scoring import risk_level


def first_known(matches: DataFrame) -> DataFrame:
    """Per entity: type and domain of its first match, first non-empty host and
    when that host became known, first and last time matched.

    Cooled-down matches count too. One map-side combined aggregation.
    """
    order = F.struct("t", "event_id")
    host = truthy(F.col("host"))
    return matches.groupBy("entity_name").agg(
        F.min_by("entity_type", order).alias("first_type"),
        F.min_by("domain", order).alias("first_domain"),
        F.min_by("host", F.when(host.isNotNull(), order)).alias("first_host"),
        F.min(F.when(host.isNotNull(), order)).alias("host_known"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
    )


def attach_entity(alerts: DataFrame, entities: DataFrame) -> DataFrame:
    """Entity type, host and domain as known when the alert was raised (D3)."""
    slim = entities.select("entity_name", "first_type", "first_domain", "first_host", "host_known")
    joined = alerts.join(slim, "entity_name", "left")
    return joined.withColumn(
        "entity_host", F.when(F.col("host_known") <= F.struct("t", "event_id"), F.col("first_host"))
    ).withColumn("entity_type", F.coalesce("first_type", "entity_type")).drop(
        "first_type", "first_domain", "first_host", "host_known"
    )


def ordered_values(alerts: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct values of ``column`` per entity in first-seen order.

    Reduced to one row per (entity, value) before anything is collected, so an
    array holds at most one entry per rule.
    """
    order = F.struct("t", "event_id", "rule_ordinal")
    firsts = (
        alerts.filter(F.col(column).isNotNull()).groupBy("entity_name", column).agg(F.min(order).alias("_first"))
    )
    listed = firsts.groupBy("entity_name").agg(F.sort_array(F.collect_list(F.struct("_first", column))).alias("_l"))
    return listed.select("entity_name", F.transform("_l", lambda item: item[column]).alias(name))


#: What :func:`entity_profiles` reads of an alert.
PROFILE_COLUMNS = [
    "entity_name", "t", "event_id", "rule_ordinal", "opens_chain", "entity_risk_after", "chain_id", "rule_title", "mitre_id",
    "mitre_tactic",
]


def entity_profiles(alerts: DataFrame, known: DataFrame, config: EngineConfig) -> DataFrame:
    """The ``entities`` table.

    The id lists of a profile are relations here: select from ``alerts`` and
    ``chains`` by entity name.
    """
    order = F.struct("t", "event_id", "rule_ordinal")
    totals = alerts.groupBy("entity_name").agg(
        F.count("*").alias("total_alerts"),
        F.count_if("opens_chain").alias("total_chains"),
        F.max_by("entity_risk_after", order).alias("risk_score"),
        F.max("entity_risk_after").alias("peak_risk"),
        F.max_by("chain_id", order).alias("active_chain_id"),
    )
    profile = known.join(totals, "entity_name")
    for column, name in (
        ("rule_title", "rules_fired"), ("mitre_id", "techniques_seen"), ("mitre_tactic", "tactics_seen")
    ):
        profile = profile.join(ordered_values(alerts, column, name), "entity_name", "left")
    empty = F.array().cast("array<string>")
    return profile.select(
        stable_id(F.col("entity_name")).alias("entity_id"),
        F.col("entity_name").alias("name"),
        F.col("first_type").alias("type"),
        F.col("first_host").alias("host"),
        F.col("first_domain").alias("domain"),
        "first_seen", "last_seen", "risk_score",
        risk_level(F.col("risk_score"), config).alias("risk_level"),
        "peak_risk", "total_alerts", F.coalesce("rules_fired", empty).alias("rules_fired"), "active_chain_id",
        "total_chains", F.coalesce("techniques_seen", empty).alias("techniques_seen"),
        F.coalesce("tactics_seen", empty).alias("tactics_seen"),
    )


def timeline(alerts: DataFrame, config: EngineConfig) -> DataFrame:
    """Newest ``max_timeline`` entries of every entity.

    Spark applies the row-number limit before the shuffle as well, so a busy
    entity sends at most that many rows from each task.
    """
    newest = Window.partitionBy("entity_name").orderBy(
        F.desc("t"), F.desc("event_id"), F.desc("rule_ordinal")
    )
    step = F.concat(F.lit(" | Chain step "), F.col("chain_position"))
    return (
        alerts.withColumn("newest", F.row_number().over(newest))
        .filter(F.col("newest") <= config.max_timeline)
        .select(
            "entity_name", "newest", "timestamp", F.lit("alert").alias("entry_type"),
            F.concat(F.lit("⚠ "), F.col("rule_title"), step, F.lit(" - Risk now "), F.col("entity_risk_after"),
                     F.lit("/100")).alias("description"),
            "alert_id", "chain_id", "severity", "rule_title", "mitre_id",
        )
    )
