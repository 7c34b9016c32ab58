"""The batch pipeline: events and rules in, alert, chain and entity tables out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from embertrace.config import EngineConfig
from embertrace.functions.common import micros, stable_id
from embertrace.operators import chain_table, chains, entities, narrate, risk
from embertrace.operators.cooldown import apply_cooldown, one_per_alert
from embertrace.operators.detect import compile_rules, match_events
from embertrace.sources.rules import Rule, rule_attributes
from embertrace.staging import stage

_CARRIED = ["rule_ordinal", "rule_id", "title_key", "risk_points"]


def find_matches(events: DataFrame, rules: list[Rule], config: EngineConfig) -> DataFrame:
    """Matches in the flat form that correlation reads.

    Rule texts stay out of it: only what the folds need is carried through the
    shuffles, the rest joins the surviving alerts.
    """
    compiled = compile_rules(events.sparkSession, rules, config)
    attributes = rule_attributes(events.sparkSession, rules).select(*_CARRIED)
    return (
        match_events(events, compiled, config)
        .join(attributes, "rule_ordinal")
        .select(
            "event_id", "timestamp", micros(F.col("timestamp")).alias("t"), "source",
            F.col("entity.name").alias("entity_name"), F.col("entity.type").alias("entity_type"),
            F.col("entity.host").alias("host"), F.col("entity.domain").alias("domain"), "raw_payload",
            *_CARRIED, stable_id("event_id", "rule_id").alias("alert_id"),
        )
    )


def score_alerts(matches: DataFrame, config: EngineConfig, initial: DataFrame | None = None) -> DataFrame:
    """Stored matches to alerts with their chain and the risk around them; further columns are carried along."""
    fired = stage(apply_cooldown(matches, config), "fired")
    chained = chains.add_chain_risk(chains.assign_chains(fired, config), config)
    scored = stage(chain_table.chain_times(chained), "chained")
    return risk.add_entity_risk(scored, matches, config, initial)


def raise_alerts(
    matches: DataFrame, rules: list[Rule], config: EngineConfig, initial: DataFrame | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """Stored matches to alerts with chain, risk and entity columns.

    ``initial`` seeds the entities' risk (see :func:`add_entity_risk`), ``known`` are their attributes if ``matches``
    is only a part of their history.

    Shuffles: one by (entity, rule, time) and one by (entity, rule, island) for
    the cooldown, the same two by entity for chains, one by (entity, time) for risk.
    """
    alerts = score_alerts(matches, config, initial)
    alerts = entities.attach_entity(alerts, known if known is not None else entities.first_known(matches))
    texts = rule_attributes(matches.sparkSession, rules).drop("rule_id", "title_key", "risk_points")
    return alerts.join(texts, "rule_ordinal").withColumn("opens_chain", F.col("is_new_link") & (F.col("chain_position") == 1))


@dataclass(frozen=True)
class Correlated:
    """Result tables of one run."""

    matches: DataFrame
    alerts: DataFrame
    config: EngineConfig

    def chains(self) -> DataFrame:
        return chain_table.chain_rollup(self.alerts, self.config)

    def entities(self) -> DataFrame:
        return entities.entity_profiles(self.alerts, entities.first_known(self.matches), self.config)

    def alert_rows(self, is_replay: bool = False) -> DataFrame:
        """The ``alerts`` table in its stored form."""
        told = narrate.narrate(self.alerts, self.config)
        return told.select(
            "alert_id", "timestamp", "rule_id", "rule_title", "rule_level", "severity", "entity_name", "entity_type",
            "entity_host", "who", "what", "where_field", "when_field", "why", "how", "mitre_id", "mitre_tactic",
            "chain_stage", "chain_id", "chain_position", "source", F.lit(is_replay).alias("is_replay"),
            F.lit(None).cast("string").alias("ai_explanation"), F.col("raw_payload").alias("raw_event"),
        )


def correlate(events: DataFrame, rules: list[Rule], config: EngineConfig) -> Correlated:
    """Run detection and correlation over an event table."""
    matches = stage(one_per_alert(find_matches(events, rules, config)), "matches")
    return Correlated(matches, raise_alerts(matches, rules, config), config)
