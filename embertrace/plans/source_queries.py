"""Queries for the record loader, the normaliser and the rule catalog.

Raw records and rule documents are derived from the provided tables, one per
row, in every layout the readers accept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from embertrace.config import EngineConfig
from embertrace.operators.detect import rule_problems
from embertrace.operators.lookup import get_rules
from embertrace.operators.store import upsert
from embertrace.plans.binding import bound_events, read_table
from embertrace.plans.oracle import on_events
from embertrace.plans.registry import query
from embertrace.sources.json_logs import explode_documents
from embertrace.sources.normalise import normalise, validate_events
from embertrace.sources.rules import describe_rules, enabled_rules, parse_rules, rules_table

CONFIG = EngineConfig()


@query(on_events("""
    SELECT event_id, CAST(pos AS INTEGER) AS record_no, id + 1000 * pos AS number, action AS label
    FROM ev, (VALUES (0), (1)) AS p(pos) WHERE id % 6 IN (0, 1, 3, 4) OR pos = 0"""))
def load_json_formats(spark, sf_dir):
    """Records of documents in every accepted layout, one document per event."""
    n = F.col("event_id").cast("bigint")

    def record(at: int):
        fields = F.struct((n + 1000 * at).alias("number"), F.col("event.action").alias("label"))
        return F.to_json(fields)

    one, two, nl = record(0), record(1), F.lit("\n")
    layout = n % 6
    content = (
        F.when(layout == 0, F.concat(F.lit("["), one, F.lit(", "), two, F.lit("]")))
        .when(layout == 1, F.concat(F.lit('{"events": ['), one, F.lit(",\n"), two, F.lit("]}\n")))
        .when(layout == 2, one)
        .when(layout == 3, F.concat(one, nl, nl, F.lit("not json\n5\n[1, 2]\n"), two, nl))
        .when(layout == 4, F.concat(F.lit("[\n  "), one, F.lit(",\n  "), two, F.lit("\n]")))
        .otherwise(F.concat(F.lit('{"note": "x", "results": [\n'), one, F.lit("\n]}")))
    )
    documents = bound_events(spark, sf_dir).select("event_id", content.alias("content"))
    fields = F.from_json("raw", "number bigint, label string")
    return explode_documents(documents).select("event_id", "record_no", fields["number"].alias("number"),
                                               fields["label"].alias("label"))


# --- normaliser ------------------------------------------------------------------

_MESSAGES = ["user logon seen", "cmd started", "http get", "hklm key", "delete it", "nothing"]


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw JSON record per event, in one of eight layouts."""
    ev = bound_events(spark, sf_dir).select(
        F.col("event_id").cast("bigint").alias("n"), F.col("entity.name").alias("who"),
        F.col("entity.host").alias("machine"), F.col("event.action").alias("act"), F.col("event.severity").alias("sev"),
        F.col("raw_payload")["k"].cast("int").alias("k"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("at"),
    )
    v, n, k = F.col("n") % 8, F.col("n"), F.col("k")

    def only(*layouts: int, value=None):
        return F.when(v.isin(*layouts), value if value is not None else F.lit(None))

    at, who_, machine, sev = F.col("at"), F.col("who"), F.col("machine"), F.col("sev")
    sev_text = sev.cast("string")
    entity = (
        F.when(v == 0, F.struct(who_.alias("actor"), F.lit("").alias("name"), F.lit("user").alias("type"),
                                machine.alias("target"), F.lit(None).cast("string").alias("host")))
        .when(v == 5, F.struct(F.lit(None).cast("string").alias("actor"), who_.alias("name"),
                               F.lit("service").alias("type"), F.lit(None).cast("string").alias("target"),
                               machine.alias("host")))
    )
    event = (
        F.when(v == 0, F.struct(F.lit("auth").alias("type"), F.col("act").alias("action"), sev_text.alias("severity"),
                                F.lit("success").alias("outcome")))
        .when(v == 5, F.struct(F.lit("weird").alias("type"), F.lit(None).cast("string").alias("action"),
                               sev_text.alias("severity"), F.lit(None).cast("string").alias("outcome")))
    )
    message = F.get(F.array(*[F.lit(m) for m in _MESSAGES]), (n % 6).cast("int"))
    windows_id = F.get(F.array(*[F.lit(i) for i in ("4624", "4688", "3", "4657", "9999")]), (k % 5))
    raw = F.to_json(F.struct(
        only(0, 5, 6, value=at).alias("timestamp"),
        only(1, value=at).alias("TimeCreated"),
        only(2, value=at).alias("time"),
        F.when((v == 3) & (n % 40 != 11), at).alias("@timestamp"),
        F.when(v == 4, at).when(v == 7, F.lit("not a time")).alias("eventTime"),
        entity.alias("entity"),
        event.alias("event"),
        only(1, value=who_).alias("user"),
        only(2, value=who_).alias("username"),
        only(3, value=who_).alias("TargetUserName"),
        F.when((v == 4) & (n % 40 != 20), who_).alias("SubjectUserName"),
        only(6, value=F.concat(F.lit("10.0.0."), k)).alias("src_user"),
        only(7, value=who_).alias("actor"),
        only(1, value=machine).alias("host"),
        F.when(v == 2, F.when(k < 50, who_).otherwise(machine)).alias("hostname"),
        only(3, value=machine).alias("Computer"),
        only(6, value=F.lit("sensor7")).alias("source"),
        only(4, value=machine).alias("WorkstationName"),
        only(1, value=sev_text).alias("severity"),
        F.when(v == 2, "7.9").when(v == 3, sev_text).alias("Level"),
        F.when(v == 1, "process").when(v == 2, "weird").alias("event_type"),
        only(3, value=windows_id).alias("EventID"),
        only(1, 2, value=F.col("act")).alias("action"),
        only(3, 4, value=F.col("act")).alias("EventType"),
        only(2, value=F.lit("failure")).alias("outcome"),
        only(3, value=F.lit("CORP")).alias("Domain"),
        only(2, 3, 4, 5, 6, value=message).alias("message"),
        F.when(v == 0, F.struct(F.lit("T1110").alias("technique_id"), F.lit("Credential Access").alias("tactic")))
        .alias("mitre"),
        F.when(v == 4, F.create_map(F.lit("LogonType"), k.cast("string"))).alias("raw_payload"),
    ))
    broken = F.when(n % 40 == 6, F.concat(F.lit('{"entity":null,'), F.substr(raw, F.lit(2)))).when(
        n % 40 == 14, F.concat(F.lit("["), raw, F.lit("]"))
    ).otherwise(raw)
    return ev.select(F.col("n").cast("string").alias("id"), broken.alias("raw"))


def _normalised(spark: SparkSession, sf_dir: str, config: EngineConfig = CONFIG) -> DataFrame:
    return normalise(raw_records(spark, sf_dir), config, event_id=F.col("id"), index=F.col("id"))


_NORMAL = """norm AS (
    SELECT *, CASE WHEN id % 40 = 14 THEN 'not an object' WHEN id % 40 = 6 THEN 'block is not an object'
                   WHEN v = 7 THEN 'unreadable timestamp' WHEN v = 3 AND id % 40 = 11 THEN 'no timestamp' END AS reject
    FROM (SELECT *, id % 8 AS v, list_extract(['user logon seen', 'cmd started', 'http get', 'hklm key', 'delete it',
          'nothing'], CAST(id % 6 AS INTEGER) + 1) AS message FROM ev)
), fields AS (
    SELECT event_id, reject, CASE WHEN reject IS NULL OR reject = 'block is not an object' THEN timestamp END AS timestamp,
        CASE WHEN reject = 'not an object' THEN 'unknown_' || event_id
             WHEN v = 6 THEN '10.0.0.' || ki WHEN v = 4 AND id % 40 = 20 THEN 'unknown_' || event_id
             ELSE entity_name END AS name,
        CASE WHEN reject = 'not an object' OR v IN (6, 7) THEN NULL
             WHEN v = 2 AND ki < 50 THEN entity_name ELSE host END AS host,
        CASE WHEN reject = 'not an object' THEN 'user' WHEN v = 5 THEN 'service' WHEN v = 6 THEN 'ip'
             WHEN v = 2 AND ki < 50 THEN 'host' ELSE 'user' END AS entity_type,
        CASE WHEN v = 3 THEN 'CORP' END AS domain,
        CASE WHEN reject = 'not an object' THEN 0 WHEN v IN (0, 1, 3, 5) THEN sev ELSE 0 END AS severity,
        CASE WHEN reject = 'not an object' THEN NULL WHEN v IN (0, 1, 2, 3, 4) THEN action END AS action,
        CASE WHEN v = 0 THEN 'success' WHEN v = 2 THEN 'failure' END AS outcome,
        CASE WHEN reject = 'not an object' THEN (CASE message WHEN 'user logon seen' THEN 'auth'
                 WHEN 'cmd started' THEN 'process' WHEN 'http get' THEN 'network' WHEN 'hklm key' THEN 'registry'
                 WHEN 'delete it' THEN 'file' ELSE 'other' END)
             WHEN v = 0 THEN 'auth' WHEN v = 1 THEN 'process'
             WHEN v = 7 THEN 'other'
             WHEN v = 3 AND ki % 5 = 0 THEN 'auth' WHEN v = 3 AND ki % 5 = 1 THEN 'process'
             WHEN v = 3 AND ki % 5 = 2 THEN 'network' WHEN v = 3 AND ki % 5 = 3 THEN 'registry'
             WHEN v = 4 THEN 'auth'
             WHEN message = 'user logon seen' THEN 'auth' WHEN message = 'cmd started' THEN 'process'
             WHEN message = 'http get' THEN 'network' WHEN message = 'hklm key' THEN 'registry'
             WHEN message = 'delete it' THEN 'file' ELSE 'other' END AS event_type,
        CASE WHEN v = 0 THEN 'T1110' END AS technique_id, CASE WHEN v = 0 THEN 'Credential Access' END AS tactic
    FROM norm
)"""


def _on_fields(columns: str) -> str:
    return on_events(f"SELECT {columns} FROM fields", _NORMAL)


@query(_on_fields("event_id, reject AS reject_reason, timestamp, name, host, entity_type, domain, severity, action, "
                  "outcome, event_type, technique_id, tactic, 'Unknown' AS chain_stage"))
def normalise_events(spark, sf_dir):
    """Every envelope field and the reject reason of every raw record."""
    return _normalised(spark, sf_dir).select(
        "event_id", "reject_reason", "timestamp", "entity.name", "entity.host",
        F.col("entity.type").alias("entity_type"), "entity.domain", "event.severity", "event.action", "event.outcome",
        F.col("event.type").alias("event_type"), "mitre.technique_id", "mitre.tactic", "mitre.chain_stage",
    )


@query(_on_fields("event_id, timestamp"))
def norm_timestamp(spark, sf_dir):
    return _normalised(spark, sf_dir).select("event_id", "timestamp")


@query(_on_fields("event_id, name"))
def norm_entity_name(spark, sf_dir):
    return _normalised(spark, sf_dir).select("event_id", "entity.name")


@query(_on_fields("event_id, host"))
def norm_host(spark, sf_dir):
    return _normalised(spark, sf_dir).select("event_id", "entity.host")


@query(_on_fields("event_id, entity_type"))
def norm_entity_type(spark, sf_dir):
    return _normalised(spark, sf_dir).select("event_id", F.col("entity.type").alias("entity_type"))


@query(_on_fields("event_id, severity"))
def norm_severity(spark, sf_dir):
    return _normalised(spark, sf_dir).select("event_id", "event.severity")


@query(_on_fields("event_id, event_type"))
def norm_event_type(spark, sf_dir):
    return _normalised(spark, sf_dir).select("event_id", F.col("event.type").alias("event_type"))


@query(on_events("""SELECT event_id, CASE
    WHEN id % 40 = 14 THEN 'other' WHEN v = 0 THEN 'auth' WHEN v = 1 THEN 'process' WHEN v NOT IN (2, 5) THEN 'other'
    WHEN message = 'user logon seen' THEN 'auth' WHEN message = 'cmd started' THEN 'process'
    WHEN message = 'http get' THEN 'network' WHEN message = 'hklm key' THEN 'registry' WHEN message = 'delete it' THEN 'file'
    ELSE 'other' END AS event_type FROM norm""", _NORMAL))
def infer_event_type(spark, sf_dir):
    """Event types in observed semantics: only a stated but unknown type is inferred."""
    observed = _normalised(spark, sf_dir, CONFIG.with_(semantics="observed"))
    return observed.select("event_id", F.col("event.type").alias("event_type"))


@query(on_events("""SELECT event_id, CASE id % 10 WHEN 1 THEN 'unknown source' WHEN 2 THEN 'entity name is missing'
    WHEN 3 THEN 'unknown entity type' WHEN 5 THEN 'unknown event type' WHEN 6 THEN 'timestamp is missing' END AS problem,
    CASE id % 10 WHEN 5 THEN 'weird' ELSE 'other' END AS event_type,
    CASE id % 10 WHEN 4 THEN 0 ELSE sev END AS severity FROM ev"""))
def ingest_validate(spark, sf_dir):
    """Validation result of live events, some of them damaged."""
    n = F.col("event_id").cast("bigint") % 10
    none = F.lit(None)
    damaged = bound_events(spark, sf_dir).withColumns({
        "source": F.when(n == 1, "bogus").otherwise(F.col("source")),
        "timestamp": F.when(n != 6, F.col("timestamp")),
        "entity": F.col("entity").withField("name", F.when(n != 2, F.col("entity.name")))
        .withField("type", F.when(n == 3, "robot").otherwise(F.col("entity.type"))),
        "event": F.col("event")
        .withField("type", F.when(n == 4, none).when(n == 5, "weird").otherwise(F.col("event.type")))
        .withField("severity", F.when(n != 4, F.col("event.severity"))),
    })
    return validate_events(damaged, CONFIG).select(
        "event_id", "problem", F.col("event.type").alias("event_type"), "event.severity"
    )


# --- rule catalog ----------------------------------------------------------------

_TACTIC_TAGS = ["reconnaissance", "initial_access", "execution", "persistence", "privilege-escalation",
                "defense-evasion", "credential_access", "discovery", "lateral-movement", "collection", "exfiltration",
                "command-and-control", "impact", "stealth"]
_LEVELS = ["low", "medium", "High", "critical", "informational", "odd"]


def rule_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One YAML rule document per part, some of them unusable."""
    part = read_table(spark, sf_dir, "part")
    n, size = F.col("p_partkey"), F.col("p_size")
    tactic = F.get(F.array(*[F.lit(t) for t in _TACTIC_TAGS]), (n % len(_TACTIC_TAGS)).cast("int"))
    level = F.get(F.array(*[F.lit(x) for x in _LEVELS]), (size % len(_LEVELS)).cast("int"))
    technique = F.concat(F.lit("attack.t"), (F.lit(1000) + n % 1000).cast("string"),
                         F.when(n % 3 == 0, ".001").otherwise(""))
    nl = F.lit("\n")
    text = F.concat(
        F.when(n % 23 == 0, "").otherwise(F.concat(F.lit("title: Part rule "), n.cast("string"), nl)),
        F.when(size % 5 == 0, "").otherwise(
            F.concat(F.lit("description: Watch "), F.col("p_name"), F.lit(". Type "), F.col("p_type"), nl)),
        F.lit("level: "), level, nl,
        F.lit("tags: [attack."), tactic, F.lit(", "), technique, F.lit(", attack.g0001, cve.2024.1]\n"),
        F.lit("detection:\n  selection: {action: click, severity: "), size.cast("string"),
        F.lit("}\n  condition: selection\n"),
    )
    content = F.when(n % 17 == 5, "only a sentence").when(n % 19 == 7, "title: [unclosed").otherwise(text)
    return part.select(
        F.concat(F.lit("parts/rule_"), n.cast("string"), F.lit(".yml")).alias("file_path"), content.alias("content")
    )


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe_rules(parse_rules(rule_documents(spark, sf_dir)), CONFIG)


_CATALOG = """doc AS (
    SELECT p_partkey AS n, p_size AS size, 'parts/rule_' || p_partkey || '.yml' AS file_path, p_name, p_type,
        list_extract(['low', 'medium', 'High', 'critical', 'informational', 'odd'], CAST(p_size % 6 AS INTEGER) + 1) AS level,
        list_extract(['Reconnaissance', 'Initial Access', 'Execution', 'Persistence', 'Privilege Escalation',
            'Defense Evasion', 'Credential Access', 'Discovery', 'Lateral Movement', 'Collection', 'Exfiltration',
            'Command And Control', 'Impact', 'Stealth'], CAST(p_partkey % 14 AS INTEGER) + 1) AS tactic,
        NOT (p_partkey % 17 = 5 OR p_partkey % 19 = 7) AS ok
    FROM part
), cat AS (
    SELECT *, sha256(file_path || '|' || title) AS rule_id FROM (
        SELECT *, CASE WHEN n % 23 = 0 THEN 'rule_' || n ELSE 'Part rule ' || n END AS title,
            'T' || (1000 + n % 1000) || CASE WHEN n % 3 = 0 THEN '.001' ELSE '' END AS mitre_id,
            CASE tactic WHEN 'Command And Control' THEN 'Command & Control' WHEN 'Stealth' THEN 'Unknown'
                 ELSE tactic END AS stage,
            CASE size % 6 WHEN 0 THEN 3 WHEN 1 THEN 5 WHEN 2 THEN 7 WHEN 3 THEN 10 WHEN 4 THEN 1 ELSE 5 END AS severity,
            CASE size % 6 WHEN 0 THEN 5 WHEN 1 THEN 10 WHEN 2 THEN 20 WHEN 3 THEN 35 WHEN 4 THEN 2 ELSE 5 END AS points
        FROM doc)
)"""


def _on_catalog(sql: str) -> str:
    return f"WITH {_CATALOG} {sql}"


@query(_on_catalog("""SELECT file_path, CASE WHEN ok THEN 'ok' ELSE 'failed' END AS load_status,
    CASE WHEN ok THEN title END AS title, CASE WHEN ok THEN level END AS level,
    CASE WHEN ok THEN rule_id END AS rule_id, CASE WHEN ok THEN 'selection' END AS condition FROM cat"""))
def rules_catalog(spark, sf_dir):
    """Load result of every rule document."""
    return _catalog(spark, sf_dir).select("file_path", "load_status", "title", "level", "rule_id", "condition")


@query(_on_catalog("SELECT rule_id, mitre_id, tactic AS mitre_tactic FROM cat WHERE ok"))
def rule_mitre(spark, sf_dir):
    return _catalog(spark, sf_dir).filter("load_status = 'ok'").select("rule_id", "mitre_id", "mitre_tactic")


@query(_on_catalog("SELECT rule_id, tactic AS mitre_tactic, stage AS chain_stage FROM cat WHERE ok"))
def tactic_stage(spark, sf_dir):
    return _catalog(spark, sf_dir).filter("load_status = 'ok'").select("rule_id", "mitre_tactic", "chain_stage")


@query(_on_catalog("SELECT rule_id, level, severity, points AS risk_points FROM cat WHERE ok"))
def rule_severity(spark, sf_dir):
    return _catalog(spark, sf_dir).filter("load_status = 'ok'").select("rule_id", "level", "severity", "risk_points")


@query(_on_catalog("""SELECT rule_id, CASE WHEN size % 5 = 0 THEN title ELSE 'Watch ' || p_name END AS summary
    FROM cat WHERE ok"""))
def rule_summary(spark, sf_dir):
    return _catalog(spark, sf_dir).filter("load_status = 'ok'").select("rule_id", "summary")


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules table with every seventh rule switched off."""
    catalog = _catalog(spark, sf_dir)
    number = F.regexp_extract("file_path", r"(\d+)", 1).cast("bigint")
    off = catalog.filter("load_status = 'ok'").filter(number % 7 == 0).select("rule_id", F.lit(False).alias("enabled"))
    return rules_table(catalog, F.lit("2024-01-01").cast("timestamp"), off)


@query(_on_catalog("SELECT rule_id, title FROM cat WHERE ok AND n % 7 <> 0"))
def rules_enabled(spark, sf_dir):
    """Rules that take part in detection after overrides."""
    return enabled_rules(_rules(spark, sf_dir), CONFIG).select("rule_id", "title")


@query(_on_catalog("SELECT rule_id, title, level, n % 7 <> 0 AS enabled FROM cat WHERE ok ORDER BY title"))
def rules_list(spark, sf_dir):
    """All rules by title."""
    return get_rules(_rules(spark, sf_dir), enabled_only=False).select("rule_id", "title", "level", "enabled")


@query(_on_catalog("SELECT rule_id, title, level, mitre_id FROM cat WHERE ok AND title = 'Part rule 42'"))
def rule_by_id(spark, sf_dir):
    """Point lookup of one rule by id."""
    rule_id = F.sha2(F.lit("parts/rule_42.yml|Part rule 42"), 256)
    return _rules(spark, sf_dir).filter(F.col("rule_id") == rule_id).select("rule_id", "title", "level", "mitre_id")


@query(_on_catalog("""SELECT rule_id, title, CASE WHEN n % 3 = 0 THEN 'critical' ELSE level END AS level,
    CASE WHEN n % 3 = 0 THEN 2 ELSE 1 END AS version FROM cat WHERE ok"""))
def rules_upsert(spark, sf_dir):
    """Rules table after a reload that changed every third rule."""
    stored = _rules(spark, sf_dir).select("rule_id", "title", "level", "file_path").withColumn("version", F.lit(1))
    number = F.regexp_extract("file_path", r"(\d+)", 1).cast("bigint")
    changed = stored.filter(number % 3 == 0).withColumns({"level": F.lit("critical"), "version": F.lit(2)})
    return upsert(stored, changed, ["rule_id"], "version").drop("file_path")


@query("""SELECT sha256('suppliers/rule_' || s_suppkey || '.yml|Supplier rule ' || s_suppkey) AS rule_id,
    'Supplier rule ' || s_suppkey AS title, CASE s_suppkey % 4 WHEN 1 THEN 'unknown selection ''other'''
        WHEN 2 THEN 'no selection is called filter*' ELSE 'condition cannot be read: ''selection and and''' END AS problem
    FROM supplier WHERE s_suppkey % 4 <> 0""")
def rules_diagnostics(spark, sf_dir):
    """Why rules cannot be evaluated as written: one rule per supplier, three of four with a faulty condition."""
    n = F.col("s_suppkey")
    condition = F.get(F.array(*[F.lit(c) for c in ("selection", "selection and other", "1 of filter*", "selection and and")]),
                      (n % 4).cast("int"))
    files = read_table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("suppliers/rule_"), n.cast("string"), F.lit(".yml")).alias("file_path"),
        F.concat(F.lit("title: Supplier rule "), n.cast("string"), F.lit("\nlevel: low\ndetection:\n  selection: {severity: "),
                 F.col("s_nationkey").cast("string"), F.lit("}\n  condition: "), condition, F.lit("\n")).alias("content"))
    return rule_problems(describe_rules(parse_rules(files), CONFIG), CONFIG)
