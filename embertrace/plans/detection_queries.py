"""Queries for single field tests, conditions and the flattened event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from embertrace.config import EngineConfig
from embertrace.operators.detect import compile_rules, flatten_events, match_events
from embertrace.plans.binding import bound_events
from embertrace.plans.oracle import on_events
from embertrace.plans.registry import query
from embertrace.sources.rules import Rule


def rich_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bound events with a payload derived from the event: command line,
    addresses, ports and fields that only some events have."""
    payload, n = F.col("raw_payload"), F.col("event_id").cast("bigint")
    k = payload["k"].cast("int")
    user = F.substring_index("entity.name", "_", -1).cast("bigint")
    extra = F.create_map(
        F.lit("CommandLine"),
        F.concat(F.lit("C:\\Tools\\Run.exe -Mode "), F.col("event.action"), F.lit(" -Key="), payload["k"]),
        F.lit("IpAddress"),
        F.concat_ws(".", F.lit("10"), (user % 4).cast("string"), k.cast("string"), (n % 256).cast("string")),
        F.lit("ImagePath"), F.concat(F.lit("C:\\Apps\\"), F.col("event.action"), F.lit(".EXE")),
        F.lit("ParentImage"), F.lit("C:\\Windows\\explorer.exe"),
        F.lit("EventID"), (F.lit(4600) + k).cast("string"),
        F.lit("DestinationPort"), (F.lit(1000) + k).cast("string"),
        F.lit("peer6"), F.concat(F.lit("2001:db8:"), (k % 3).cast("string"), F.lit("::"), F.hex(n % 256)),
    )
    none = F.create_map().cast("map<string,string>")
    named = F.when(user % 3 == 0, F.create_map(F.lit("TargetUserName"), F.concat(F.lit("svc_"), user))).otherwise(none)
    odd = F.when(k % 2 == 1, F.create_map(F.lit("Note"), F.lit("Odd-One"))).otherwise(none)
    return bound_events(spark, sf_dir).withColumn("raw_payload", F.map_concat(payload, extra, named, odd))


_RICH = r"""rich AS (
    SELECT *, 'C:\Tools\Run.exe -Mode ' || action || ' -Key=' || k AS cmdline,
        '10.' || (user_id % 4) || '.' || ki || '.' || (id % 256) AS ip,
        CASE WHEN user_id % 3 = 0 THEN 'svc_' || user_id ELSE entity_name END AS usr,
        CASE WHEN ki % 2 = 1 THEN 'Odd-One' END AS note
    FROM ev)"""


def matching(spark: SparkSession, sf_dir: str, detection: dict, semantics: str = "documented") -> DataFrame:
    """Ids of the events that one rule matches."""
    config = EngineConfig(semantics=semantics)
    rule = Rule(0, "r", "r", "low", detection["condition"], detection, None, None, None, "Unknown", 3, 5, "r")
    compiled = compile_rules(spark, [rule], config)
    return match_events(rich_events(spark, sf_dir), compiled, config).select("event_id")


def _register(name: str, where: str, selection=None, condition: str = "selection", **selections) -> None:
    """Register a query for one rule, with the equivalent WHERE clause."""
    detection = {**({"selection": selection} if selection is not None else {}), **selections, "condition": condition}

    def run(spark, sf_dir):
        return matching(spark, sf_dir, detection)

    run.__doc__ = f"Events matching {detection}."
    query(on_events(f"SELECT event_id FROM rich WHERE {where}", _RICH), name=name)(run)


_register("pred_exact", "action = 'click'", {"action": "CLICK"})
_register("pred_contains", r"lower(cmdline) LIKE '%mode pur%'", {"CommandLine|contains": "Mode Pur"})
_register("pred_contains_all", "lower(cmdline) LIKE '%mode view%' AND lower(cmdline) LIKE '%key=7%'",
          {"CommandLine|contains|all": ["mode view", "key=7"]})
_register("pred_startswith", "k LIKE '4%' OR k LIKE '7%'", {"k|startswith": ["4", 7]})
_register("pred_endswith", "action IN ('signup', 'purchase')", {"ImagePath|endswith": ["signup.exe", "SE.EXE"]})
_register("pred_regex", r"regexp_matches(lower(cmdline), 'key=(1|2)\d$') OR action = 'error'",
          {"CommandLine|re": [r"key=(1|2)\d$", r"Mode\s(?P<what>ERR)or", "(unclosed"]})
_register("pred_cidr", "user_id % 4 = 1 OR (user_id % 4 = 2 AND ki BETWEEN 32 AND 63)",
          {"src_ip|cidr": ["10.1.0.0/16", "10.2.45.9/255.255.224.0", "not-a-network"]})
_register("pred_cidr6", "ki % 3 = 1", {"peer6|cidr": "2001:DB8:1::/48"})
_register("pred_windash", "lower(cmdline) LIKE '%.exe -mode click%'", {"cmd|windash": "/mode click"},
          condition="selection")
_register("pred_null", "note IS NULL", {"note|null": True})
_register("pred_any_value", "action IN ('click', 'error') AND ki IN (1, 2, 3)",
          {"action": ["click", "error"], "k": [1, 2, "3"]})
_register("pred_field_case", "ki = 25 OR note IS NOT NULL", [{"eVeNtId": 4625}, {"NOTE": "odd-one"}])
_register("pred_mapping_and", "action = 'view' AND sev BETWEEN 1 AND 2 AND k LIKE '%5'",
          {"action": "view", "severity": [1, 2], "k|endswith": 5})
_register("pred_list_or", "(action = 'view' AND sev = 1) OR k LIKE '99%'",
          [{"action": "view", "severity": 1}, {"k|startswith": "99"}])

_A, _B, _C, _D = {"action": ["click", "view"]}, {"severity": 0}, {"k|startswith": "4"}, {"note": "odd-one"}
_IS = {"a": "action IN ('click', 'view')", "b": "sev = 0", "c": "k LIKE '4%'", "d": "note IS NOT NULL"}


def _condition(name: str, condition: str, where: str) -> None:
    _register(name, where.format(**_IS), condition=condition, sel_a=_A, sel_b=_B, other_c=_C, other_d=_D)


_condition("cond_named", "other_c", "{c}")
_condition("cond_not", "not sel_a and other_c", "NOT {a} AND {c}")
_condition("cond_and", "sel_a and other_c and other_d", "{a} AND {c} AND {d}")
_condition("cond_or", "other_c or sel_a and not sel_b", "{c} OR ({a} AND NOT ({b}))")
_condition("cond_paren", "(other_c or other_d) and (sel_a or sel_b)", "({c} OR {d}) AND ({a} OR {b})")
_condition("cond_one_of", "1 of other_* and not sel_b", "({c} OR {d}) AND NOT ({b})")
_condition("cond_all_of", "all of SEL_*", "{a} AND {b}")
_condition("cond_one_of_them", "not 1 of them", "NOT ({a} OR {b} OR {c} OR {d})")
_condition("cond_all_of_them", "all of them", "{a} AND {b} AND {c} AND {d}")
_condition("cond_sel_not_filter", "sel_a and not other_d", "{a} AND NOT (coalesce({d}, false))")

_ISO = "strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'"


@query(on_events(f"""SELECT event_id, {_ISO} AS timestamp, 'hostlog' AS source, usr AS user, entity_name AS username,
    host AS "Computer", 'user' AS entity_type, '' AS domain, 'other' AS event_type, action,
    CAST(sev AS VARCHAR) AS severity, 'unknown' AS outcome, '' AS technique, k, note FROM rich""", _RICH))
def flatten_event(spark, sf_dir):
    """Envelope and payload fields as rules see them."""
    return flatten_events(rich_events(spark, sf_dir), [
        "timestamp", "source", "user", "username", "Computer", "entity_type", "domain", "event_type", "action",
        "severity", "outcome", "technique", "k", "note",
    ])


@query(on_events(r"""SELECT event_id, CAST(4600 + ki AS VARCHAR) AS "EventID", CAST(4600 + ki AS VARCHAR) AS event_id_win,
    cmdline AS cmd, 'C:\Apps\' || action || '.EXE' AS "Image", 'C:\Apps\' || action || '.EXE' AS process,
    'C:\Windows\explorer.exe' AS "ParentImage", usr AS user, ip AS "IpAddress", ip AS src_ip,
    CAST(1000 + ki AS VARCHAR) AS dst_port, CAST(1000 + ki AS VARCHAR) AS "DestinationPort" FROM rich""", _RICH))
def flatten_aliases(spark, sf_dir):
    """Alias names of well-known payload fields."""
    return flatten_events(rich_events(spark, sf_dir), [
        "EventID", "event_id_win", "cmd", "Image", "process", "ParentImage", "user", "IpAddress", "src_ip", "dst_port",
        "DestinationPort",
    ])
