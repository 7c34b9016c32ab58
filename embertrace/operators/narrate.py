"""Who, what, where, when, why and how of an alert, and the story of a chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from embertrace.config import EngineConfig
from embertrace.functions.common import first_truthy, iso_utc, truthy
from embertrace.functions.scoring import risk_level


def display_name(name: Column, host: Column) -> Column:
    return F.when(truthy(host).isNotNull(), F.concat(name, F.lit("@"), host)).otherwise(name)


def who(config: EngineConfig) -> Column:
    """Entity and its risk as it stood before this alert."""
    score = F.col("entity_risk_before")
    return F.concat(
        display_name(F.col("entity_name"), F.col("entity_host")), F.lit(" ["), F.upper("entity_type"),
        F.lit("] Risk "), score, F.lit("/100 ("), risk_level(score, config), F.lit(") | Chain: "),
        F.col("chain_position"), F.lit(" steps"),
    )


def what() -> Column:
    technique = F.coalesce(F.concat(F.lit(" ["), F.col("mitre_id"), F.lit("]")), F.lit(""))
    tactic = F.coalesce(F.concat(F.lit(" - "), F.col("mitre_tactic")), F.lit(""))
    return F.concat(
        F.col("rule_summary"), technique, tactic, F.lit(". Rule: '"), F.col("rule_title"), F.lit("' (level: "),
        F.col("rule_level"), F.lit("). Source: "), F.col("source"), F.lit("."),
    )


def where() -> Column:
    domain = F.coalesce(F.concat(F.lit("\\"), truthy(F.col("domain"))), F.lit(""))
    payload = F.col("raw_payload")
    target = first_truthy(payload["TargetHostName"], payload["target_host"], payload["destination"])
    return F.concat(
        domain, F.coalesce(truthy(F.col("host")), F.lit("unknown host")),
        F.coalesce(F.concat(F.lit(" → "), target), F.lit("")),
    )


def when_text() -> Column:
    now = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss 'UTC'")
    chained = F.concat(
        now, F.lit(" - Chain started at "), F.date_format("chain_started_at", "HH:mm:ss 'UTC'"), F.lit(" ("),
        F.format_string("%.1f", minutes_between(F.col("chain_started_at"), F.col("chain_updated_at"))),
        F.lit(" minutes ago, step "), F.col("chain_position"), F.lit(" of chain)"),
    )
    first = F.concat(now, F.lit(" (first detection on this entity)"))
    return F.when(F.col("chain_position") > 1, chained).otherwise(first)


def minutes_between(start: Column, end: Column) -> Column:
    """Elapsed minutes to one decimal."""
    return F.round((F.unix_micros(end) - F.unix_micros(start)) / F.lit(60_000_000), 1)


def investigation_sql(entity: Column, since: Column) -> Column:
    """SELECT that lists the entity's alerts since a moment, oldest first."""
    quoted = F.replace(entity, F.lit("'"), F.lit("''"))
    return F.concat(
        F.lit("SELECT alert_id, timestamp, rule_title, entity_name, entity_host, severity, what, why, chain_id "
              "FROM alerts WHERE entity_name = '"), quoted, F.lit("' AND timestamp >= '"), iso_utc(since),
        F.lit("' ORDER BY timestamp ASC;"),
    )


def lookback_start(ts: Column, config: EngineConfig) -> Column:
    return ts - F.make_dt_interval(mins=F.lit(config.lookback_minutes))


def how(config: EngineConfig) -> Column:
    sql = investigation_sql(F.col("entity_name"), lookback_start(F.col("timestamp"), config))
    places = " and ".join(f"{name} at {address}" for name, address in config.cross_references)
    return F.concat(
        F.lit("Run this investigation query to pull all related alerts:\n\n"), sql,
        F.lit(f"\n\nThen cross-reference with {places} for full context on "),
        display_name(F.col("entity_name"), F.col("entity_host")), F.lit("."),
    )


def narrate(alerts: DataFrame, config: EngineConfig) -> DataFrame:
    """Add the six narrative columns. ``why`` comes with the rule attributes."""
    return alerts.withColumns({
        "who": who(config), "what": what(), "where_field": where(), "when_field": when_text(), "how": how(config),
    })


def stage_progression(stages: Column) -> Column:
    return F.concat_ws(" → ", stages)


def chain_narrative() -> Column:
    """Text of a chain row: summary, escalation if any, then numbered steps.

    Shown as of the last link. The escalation line gives the risk the chain had
    when that link was added.
    """
    host = F.coalesce(F.concat(F.lit(" on "), truthy(F.col("entity_host"))), F.lit(""))
    count = F.col("link_count")
    progression = truthy(stage_progression(F.col("stages_seen")))
    # Text is rebuilt when a link is added, and the escalation test comes after,
    # so a chain that escalates on its last link does not say so yet.
    told = F.col("escalated_before_last_link")
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("Attack chain detected on "), F.col("entity_name"), host, F.lit(".")),
        F.concat(count, F.lit(" distinct rule"), F.when(count != 1, "s").otherwise(""), F.lit(" fired over "),
                 F.format_string("%.1f", F.col("duration_minutes")), F.lit(" minutes.")),
        F.concat(F.lit("Observed progression: "), F.coalesce(progression, F.lit("Unknown progression")), F.lit(".")),
        F.when(told, F.concat(F.lit("Entity risk score reached "), F.col("risk_at_last_link"),
                              F.lit("/100 - CRITICAL escalation triggered."))),
        F.lit(""),
    )
    step = lambda link: F.concat(
        F.lit("  "), link["position"], F.lit(". "), F.date_format(link["timestamp"], "HH:mm:ss 'UTC'"), F.lit(" - "),
        link["chain_stage"], F.coalesce(F.concat(F.lit(" ["), link["mitre_id"], F.lit("]")), F.lit("")),
        F.lit(": "), link["rule_title"],
    )
    return F.concat_ws("\n", lines, F.concat_ws("\n", F.transform("links", step)))
