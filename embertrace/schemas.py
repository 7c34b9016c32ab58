"""Table and envelope schemas, and the enumerations they are checked against."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: enumerations of the event and alert model -----------------
ENTITY_TYPES = ("user", "host", "ip", "service")
EVENT_TYPES = ("auth", "process", "network", "config", "dns", "file", "registry", "other")
RISK_LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
REPLAY_STATUSES = ("idle", "running", "paused", "complete", "error")
UNKNOWN_STAGE = "Unknown"
# --- end of fixed values ------------------------------------------------------

_STR, _INT, _BOOL, _TS = T.StringType(), T.IntegerType(), T.BooleanType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


PAYLOAD = T.MapType(_STR, _STR)

EVENT_SCHEMA = _struct(
    event_id=_STR,
    timestamp=_TS,
    source=_STR,
    entity=_struct(name=_STR, type=_STR, host=_STR, domain=_STR),
    event=_struct(type=_STR, action=_STR, severity=_INT, outcome=_STR),
    mitre=_struct(
        technique_id=_STR, technique_name=_STR, tactic=_STR, tactic_id=_STR, chain_stage=_STR
    ),
    raw_payload=PAYLOAD,
)

ALERTS_SCHEMA = _struct(
    alert_id=_STR, timestamp=_TS, rule_id=_STR, rule_title=_STR, rule_level=_STR, severity=_INT,
    entity_name=_STR, entity_type=_STR, entity_host=_STR,
    who=_STR, what=_STR, where_field=_STR, when_field=_STR, why=_STR, how=_STR,
    mitre_id=_STR, mitre_tactic=_STR, chain_stage=_STR, chain_id=_STR, chain_position=_INT,
    source=_STR, is_replay=_BOOL, ai_explanation=_STR, raw_event=PAYLOAD,
)

CHAIN_LINK = _struct(
    position=_INT, alert_id=_STR, timestamp=_TS, rule_title=_STR, chain_stage=_STR,
    mitre_id=_STR, entity_name=_STR, severity=_INT, investigation_sql=_STR,
)

CHAINS_SCHEMA = _struct(
    chain_id=_STR, entity_name=_STR, entity_type=_STR, entity_host=_STR,
    started_at=_TS, updated_at=_TS, risk_score=_INT, risk_level=_STR,
    stages_seen=T.ArrayType(_STR), is_escalated=_BOOL, link_count=_INT,
    links=T.ArrayType(CHAIN_LINK), narrative=_STR, ai_summary=_STR,
)

# alert_ids, chain_ids and the timeline grow without bound for a busy entity, so
# they are relations (alerts, chains, timeline rows) keyed by entity_name here.
ENTITIES_SCHEMA = _struct(
    entity_id=_STR, name=_STR, type=_STR, host=_STR, domain=_STR,
    first_seen=_TS, last_seen=_TS, risk_score=_INT, risk_level=_STR, peak_risk=_INT,
    total_alerts=T.LongType(), rules_fired=T.ArrayType(_STR), active_chain_id=_STR,
    total_chains=T.LongType(), techniques_seen=T.ArrayType(_STR), tactics_seen=T.ArrayType(_STR),
)

RULES_SCHEMA = _struct(
    rule_id=_STR, title=_STR, description=_STR, author=_STR, status=_STR, level=_STR,
    tags=T.ArrayType(_STR), mitre_id=_STR, mitre_tactic=_STR, chain_stage=_STR,
    logsource=_STR, detection=_STR, condition=_STR, fields=T.ArrayType(_STR),
    file_path=_STR, loaded_at=_TS, match_count=T.LongType(), enabled=_BOOL,
)

REPLAY_RUNS_SCHEMA = _struct(
    job_id=_STR, file_name=_STR, file_path=_STR, status=_STR, speed=T.DoubleType(),
    total_events=T.LongType(), processed=T.LongType(), alerts_fired=T.LongType(),
    chains_formed=T.LongType(), max_chain_position=_INT,
    started_at=_TS, completed_at=_TS, error=_STR,
)
