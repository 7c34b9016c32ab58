"""Queries over the pipeline steps: detection, cooldown, chains, risk, narration."""

from __future__ import annotations

from pyspark.sql import functions as F

from embertrace.functions.scoring import risk_level
from embertrace.operators import chain_table, entities, narrate, risk
from embertrace.operators.chains import add_chain_risk, assign_chains
from embertrace.operators.cooldown import apply_cooldown, one_per_alert
from embertrace.operators.detect import detect
from embertrace.operators.investigate import lookback_context
from embertrace.plans.binding import bound_events, bundled_rules
from embertrace.plans.oracle import DAY_US, LOSS as _LOSS, RISK_LEVEL, decay_fold, on_alerts, on_chained, on_fired, on_hits, on_tables
from embertrace.plans.pipeline import correlate, find_matches, score_alerts
from embertrace.plans.registry import query
from embertrace.plans.runs import CONFIG, fresh_matches, fresh_run, store
from embertrace.staging import stage


@query(on_hits("SELECT event_id, rule_id, ord AS rule_ordinal, entity_name, timestamp FROM hits"))
def detect_matches(spark, sf_dir):
    """Every (event, rule) match."""
    return fresh_matches(spark, sf_dir).select("event_id", "rule_id", "rule_ordinal", "entity_name", "timestamp")


@query(on_hits("""SELECT event_id, title AS rule_title, level AS rule_level, severity, pts AS risk_points, mitre_id,
    tactic AS mitre_tactic, stage AS chain_stage, summary AS rule_summary FROM hits"""))
def match_enrich(spark, sf_dir):
    """Matches with the attributes of their rule."""
    return detect(bound_events(spark, sf_dir), bundled_rules(spark), CONFIG).select(
        "event_id", "rule_title", "rule_level", "severity", "risk_points", "mitre_id", "mitre_tactic", "chain_stage",
        "rule_summary",
    )


@query(on_fired("SELECT alert_id, event_id, entity_name, ord AS rule_ordinal, timestamp FROM fired"))
def cooldown_alerts(spark, sf_dir):
    """Matches that survive the cooldown."""
    fired = apply_cooldown(stage(one_per_alert(fresh_matches(spark, sf_dir)), "matches"), CONFIG)
    return fired.select("alert_id", "event_id", "entity_name", "rule_ordinal", "timestamp")


@query(on_hits("SELECT alert_id, entity_name, CAST(before AS INTEGER) AS points_before FROM fold",
               decay_fold("SELECT * FROM hits", "pts")))
def cooldown_off_repeats(spark, sf_dir):
    """Every event delivered twice, no cooldown: each match is one alert, folded through the large path."""
    config = CONFIG.with_(cooldown_seconds=0, chain_min_rules=1_000, fold_limit=1)
    events = bound_events(spark, sf_dir)
    run = correlate(events.unionByName(events), bundled_rules(spark), config)
    return run.alerts.select("alert_id", "entity_name", F.col("entity_risk_before").alias("points_before"))


def _chained(spark, sf_dir):
    fired = stage(apply_cooldown(stage(one_per_alert(fresh_matches(spark, sf_dir)), "matches"), CONFIG), "fired")
    return assign_chains(fired, CONFIG)


@query(on_chained("SELECT alert_id, entity_name, chain_id, chain_position, is_new_link FROM chained"))
def chain_assign(spark, sf_dir):
    """Chain, position and link flag of every alert."""
    return _chained(spark, sf_dir).select("alert_id", "entity_name", "chain_id", "chain_position", "is_new_link")


@query(on_chained("SELECT alert_id, chain_position FROM chained"))
def alert_chain_position(spark, sf_dir):
    return _chained(spark, sf_dir).select("alert_id", "chain_position")


@query(on_alerts("""SELECT alert_id, chain_id, delta AS risk_delta, chain_risk_before, chain_risk_after
    FROM alerts"""))
def chain_risk_running(spark, sf_dir):
    """Risk of the chain before and after each alert."""
    return add_chain_risk(_chained(spark, sf_dir), CONFIG).select(
        "alert_id", "chain_id", "risk_delta", "chain_risk_before", "chain_risk_after"
    )


@query(on_alerts("""SELECT chain_id, bool_or(is_escalated) AS is_escalated,
    min(timestamp) FILTER (trips) AS escalated_at, min(chain_position) FILTER (trips) AS at_position
    FROM alerts GROUP BY chain_id"""))
def chain_escalation(spark, sf_dir):
    """Whether, when and at which step each chain escalated."""
    scored = add_chain_risk(_chained(spark, sf_dir), CONFIG)
    return scored.groupBy("chain_id").agg(
        F.max("is_escalated").alias("is_escalated"),
        F.min(F.when(F.col("escalates"), F.col("timestamp"))).alias("escalated_at"),
        F.min(F.when(F.col("escalates"), F.col("chain_position"))).alias("at_position"),
    )


@query(on_alerts("""SELECT chain_id, chain_position AS position, alert_id, timestamp, title AS rule_title,
    stage AS chain_stage, mitre_id, entity_name, severity,
    'SELECT alert_id, timestamp, rule_title, entity_name, entity_host, severity, what, why, chain_id FROM alerts '
    || 'WHERE entity_name = ''' || entity_name || ''' AND timestamp >= '''
    || strftime(timestamp - INTERVAL 60 MINUTE, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'' ORDER BY timestamp ASC;'
    AS investigation_sql
    FROM alerts WHERE is_new_link"""))
def chain_links(spark, sf_dir):
    """One row per link of every chain."""
    return chain_table.chain_links(fresh_run(spark, sf_dir).alerts, CONFIG)


def _scored(spark, sf_dir, config):
    """Alerts with their risk, from matches without the columns that only texts and profiles need."""
    found = find_matches(bound_events(spark, sf_dir), bundled_rules(spark), config)
    slim = found.drop("source", "entity_type", "host", "domain", "raw_payload")
    return score_alerts(stage(one_per_alert(slim), "matches"), config)


@query(on_chained("""SELECT alert_id, entity_name, CAST(least(100, sum(delta) OVER e - delta) AS INTEGER)
    AS entity_risk_before, CAST(least(100, sum(delta) OVER e) AS INTEGER) AS entity_risk_after
    FROM chained WINDOW e AS (PARTITION BY entity_name ORDER BY n)"""))
def entity_risk_running(spark, sf_dir):
    """Entity risk around each alert with decay switched off."""
    return _scored(spark, sf_dir, CONFIG.with_(decay_interval_hours=0)).select(
        "alert_id", "entity_name", "entity_risk_before", "entity_risk_after"
    )


@query(on_alerts("SELECT alert_id, entity_risk_before AS risk_shown FROM alerts"))
def risk_before_alert(spark, sf_dir):
    return store(spark, sf_dir).context.select("alert_id", F.col("entity_risk_before").alias("risk_shown"))


@query(on_alerts(f"""SELECT alert_id, entity_risk_after AS risk_score,
    {RISK_LEVEL.format("entity_risk_after")} AS risk_level FROM alerts""", ), name="risk_level")
def risk_level_of_alerts(spark, sf_dir):
    """Risk level after each alert."""
    return store(spark, sf_dir).context.select(
        "alert_id", F.col("entity_risk_after").alias("risk_score"),
        risk_level(F.col("entity_risk_after"), CONFIG).alias("risk_level"),
    )


@query(on_alerts("SELECT alert_id, entity_name, entity_host, 'user' AS entity_type FROM alerts"))
def entity_attach(spark, sf_dir):
    """Entity host and type as known at each alert."""
    s = store(spark, sf_dir)
    bare = s.context.drop("entity_host")
    return entities.attach_entity(bare, entities.first_known(s.matches)).select(
        "alert_id", "entity_name", "entity_host", "entity_type"
    )


@query(on_alerts("SELECT entity_name, first_host, first_seen, last_seen FROM first_match"))
def entity_first_host(spark, sf_dir):
    """First known host, first and last match of every entity."""
    return entities.first_known(fresh_matches(spark, sf_dir)).select(
        "entity_name", "first_host", "first_seen", "last_seen"
    )


@query(on_tables(f"""
    SELECT name, risk_score AS score_before, s AS risk_score, {RISK_LEVEL.format("s")} AS risk_level, peak_risk,
           ticks AS decay_ticks
    FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY i DESC) AS newest FROM steps) WHERE newest = 1
    """, f"""due AS (
        SELECT name, risk_score, peak_risk, greatest(0, epoch_us(TIMESTAMP '2024-02-20 00:00:00') // {DAY_US}
               - ((epoch_us(last_seen) + {DAY_US} + {DAY_US} - 1) // {DAY_US}) + 1) AS ticks
        FROM entities
    ), steps AS (
        SELECT name, risk_score, peak_risk, ticks, CAST(0 AS BIGINT) AS i, CAST(risk_score AS BIGINT) AS s FROM due
        UNION ALL
        SELECT name, risk_score, peak_risk, ticks, i + 1, greatest(0, s - {_LOSS.format("s")}) FROM steps
        WHERE i < ticks
    )"""))
def risk_decay(spark, sf_dir):
    """Entity scores decayed to a later day."""
    profiles = store(spark, sf_dir).entities.withColumn("score_before", F.col("risk_score"))
    moved = risk.decay_entities(profiles, F.lit("2024-02-20 00:00:00").cast("timestamp"), CONFIG)
    return moved.select(
        "name", "score_before", F.col("risk_score").cast("bigint").alias("risk_score"), "risk_level", "peak_risk",
        "decay_ticks",
    )


@query(on_alerts("""SELECT alert_id, entity_risk_before AS decayed_risk_before, entity_risk_after AS decayed_risk_after
    FROM alerts"""))
def entity_risk_decayed(spark, sf_dir):
    """Entity risk around each alert with daily decay between alerts."""
    alerts = _scored(spark, sf_dir, CONFIG)
    return alerts.select("alert_id", F.col("entity_risk_before").alias("decayed_risk_before"),
                         F.col("entity_risk_after").alias("decayed_risk_after"))


@query(on_alerts("""
    SELECT entity_name, newest, timestamp, 'alert' AS entry_type, alert_id, chain_id, severity, title AS rule_title,
        mitre_id, '⚠ ' || title || ' | Chain step ' || chain_position || ' - Risk now ' || entity_risk_after || '/100'
        AS description
    FROM (SELECT *, CAST(row_number() OVER (
        PARTITION BY entity_name ORDER BY t DESC, event_id DESC, ord DESC) AS INTEGER) AS newest FROM alerts)
    WHERE newest <= 500"""))
def entity_timeline(spark, sf_dir):
    """Newest 500 timeline entries of every entity."""
    return entities.timeline(store(spark, sf_dir).context, CONFIG)


@query(on_alerts("""
    SELECT a.alert_id, count(*) AS lookback_alerts, CAST(count(DISTINCT b.title) AS INTEGER) AS lookback_rules
    FROM alerts a JOIN alerts b ON b.entity_name = a.entity_name AND b.t BETWEEN a.t - 3600000000 AND a.t
    GROUP BY a.alert_id"""))
def investigate_lookback(spark, sf_dir):
    """Size of the hour of alerts that an analyst would pull for each alert."""
    return lookback_context(store(spark, sf_dir).context, CONFIG).select(
        "alert_id", "lookback_alerts", "lookback_rules"
    )


# --- narration -----------------------------------------------------------------

_MINUTES = "printf('%.1f', round((epoch_us(chain_updated_at) - epoch_us(chain_started_at)) / 60000000.0, 1))"


@query(on_alerts(f"""SELECT alert_id, entity_name || '@' || entity_host || ' [USER] Risk ' || entity_risk_before
    || '/100 (' || {RISK_LEVEL.format("entity_risk_before")} || ') | Chain: ' || chain_position || ' steps' AS who
    FROM alerts"""))
def narrate_who(spark, sf_dir):
    return store(spark, sf_dir).alerts.select("alert_id", "who")


@query(on_alerts("""SELECT alert_id, summary || coalesce(' [' || mitre_id || ']', '') || ' - ' || tactic
    || '. Rule: ''' || title || ''' (level: ' || level || '). Source: hostlog.' AS what FROM alerts"""))
def narrate_what(spark, sf_dir):
    return store(spark, sf_dir).alerts.select("alert_id", "what")


@query(on_alerts("SELECT alert_id, host AS where_field FROM alerts"))
def narrate_where(spark, sf_dir):
    return store(spark, sf_dir).alerts.select("alert_id", "where_field")


@query(on_alerts(f"""SELECT alert_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S UTC') || CASE WHEN chain_position > 1
    THEN ' - Chain started at ' || strftime(chain_started_at, '%H:%M:%S UTC') || ' (' || {_MINUTES}
         || ' minutes ago, step ' || chain_position || ' of chain)'
    ELSE ' (first detection on this entity)' END AS when_field FROM alerts"""))
def narrate_when(spark, sf_dir):
    return store(spark, sf_dir).alerts.select("alert_id", "when_field")


@query(on_alerts("""SELECT alert_id, 'Sigma rule ''' || title || ''' fired.' || chr(10) || CASE ord
    WHEN 0 THEN '  action: error' || chr(10) || 'Condition: selection'
    WHEN 1 THEN '  action: purchase' || chr(10) || '  severity: [4, 5, 6, 7, 8, 9, 10]' || chr(10)
                || 'Condition: selection'
    WHEN 2 THEN '  action: signup' || chr(10) || '  k|re: ^[0-9]$' || chr(10) || 'Condition: all of sel_*'
    WHEN 3 THEN '  selection: [{''action'': ''click''}, {''action'': ''view''}]' || chr(10) || '  severity: 0' || chr(10)
                || 'Condition: selection and not filter'
    ELSE '  action: click' || chr(10) || '  k|startswith: 4' || chr(10) || 'Condition: selection' END
    || chr(10) || chr(10) || 'Rule file: ' || file AS why FROM alerts"""))
def narrate_why(spark, sf_dir):
    return store(spark, sf_dir).alerts.select("alert_id", "why")


@query(on_alerts("""SELECT alert_id, 'Run this investigation query to pull all related alerts:' || chr(10) || chr(10)
    || 'SELECT alert_id, timestamp, rule_title, entity_name, entity_host, severity, what, why, chain_id FROM alerts '
    || 'WHERE entity_name = ''' || entity_name || ''' AND timestamp >= '''
    || strftime(timestamp - INTERVAL 60 MINUTE, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'' ORDER BY timestamp ASC;'
    || chr(10) || chr(10) || 'Then cross-reference with the host log store at http://localhost:8000 and '
    || 'the network sensor at http://localhost:8001 for full context on ' || entity_name || '@' || entity_host || '.'
    AS how FROM alerts"""))
def narrate_how(spark, sf_dir):
    return store(spark, sf_dir).alerts.select("alert_id", "how")


@query(on_tables("""
    SELECT c.chain_id,
        'Attack chain detected on ' || c.entity_name || ' on ' || c.entity_host || '.' || chr(10)
        || c.link_count || ' distinct rule' || CASE WHEN c.link_count <> 1 THEN 's' ELSE '' END || ' fired over '
        || printf('%.1f', c.duration_minutes) || ' minutes.' || chr(10)
        || 'Observed progression: ' || c.stage_progression || '.' || chr(10)
        || CASE WHEN l.told THEN 'Entity risk score reached ' || l.risk || '/100 - CRITICAL escalation triggered.'
                || chr(10) ELSE '' END
        || chr(10) || s.steps AS narrative
    FROM chains c
    JOIN (SELECT chain_id, arg_max(chain_risk_before, n) AS risk, arg_max(told, n) AS told
          FROM (SELECT *, coalesce(bool_or(trips) OVER (PARTITION BY chain_id ORDER BY n
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS told FROM alerts)
          WHERE is_new_link GROUP BY chain_id) l USING (chain_id)
    JOIN (SELECT chain_id, string_agg('  ' || chain_position || '. ' || strftime(timestamp, '%H:%M:%S UTC') || ' - '
                || stage || coalesce(' [' || mitre_id || ']', '') || ': ' || title, chr(10) ORDER BY n) AS steps
          FROM alerts WHERE is_new_link GROUP BY chain_id) s USING (chain_id)"""))
def chain_narrative(spark, sf_dir):
    return store(spark, sf_dir).chains.select("chain_id", "narrative")


@query(on_tables("SELECT chain_id, stage_progression FROM chains"))
def chain_stages(spark, sf_dir):
    """Stages of each chain in first-seen order."""
    return store(spark, sf_dir).chains.select(
        "chain_id", narrate.stage_progression(F.col("stages_seen")).alias("stage_progression")
    )


@query(on_tables("SELECT chain_id, duration_minutes FROM chains"))
def chain_duration(spark, sf_dir):
    return store(spark, sf_dir).chains.select(
        "chain_id", narrate.minutes_between(F.col("started_at"), F.col("updated_at")).alias("duration_minutes")
    )
