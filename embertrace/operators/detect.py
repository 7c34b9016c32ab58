"""Evaluate a rule set over events: one output row per (event, matching rule)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from embertrace.config import EngineConfig
from embertrace.functions.common import iso_utc
from embertrace.operators.conditions import documented_sql
from embertrace.operators.predicates import (
    RuleContext, UnsupportedRule, fields_of, patterns_of, refused_pattern, selection_problems, selection_test, stated_patterns,
)
from embertrace.sources.rules import Rule, rule_attributes
from embertrace.staging import stage

# --- fixed values: envelope fields a rule may name, and payload aliases ------
_ENVELOPE_FIELDS = {
    "event_id": "event_id", "source": "source",
    "username": "entity.name", "src_user": "entity.name",
    "host": "entity.host", "hostname": "entity.host", "computer": "entity.host", "workstation": "entity.host",
    "entity_type": "entity.type", "domain": "entity.domain",
    "event_type": "event.type", "action": "event.action", "severity": "event.severity",
    "outcome": "event.outcome", "technique": "mitre.technique_id", "tactic": "mitre.tactic",
}
_EMPTY_WHEN_MISSING = ("entity.host", "entity.domain", "event.action", "event.outcome", "mitre.technique_id",
                       "mitre.tactic")
_PAYLOAD_ALIASES = {
    "event_id_win": "eventid", "cmd": "commandline", "image": "imagepath", "process": "imagepath",
    "src_ip": "ipaddress", "dst_port": "destinationport",
}
# --- end of fixed values ------------------------------------------------------

_SELECTION = re.compile(r"`_s\d+`")
_KEYS, _VALUES = "_payload_keys", "_payload_values"
_KEY_SEPARATOR = "\x01"


def _with_payload_arrays(events: DataFrame) -> DataFrame:
    """Lower-cased payload keys and their values as two aligned arrays.

    Splitting a joined string lower-cases all keys without a lambda, which
    keeps the projection inside generated code.
    """
    keys = F.split(F.lower(F.concat_ws(_KEY_SEPARATOR, F.map_keys("raw_payload"))), _KEY_SEPARATOR)
    return events.withColumns({_KEYS: keys, _VALUES: F.map_values("raw_payload")})


def _payload(name: str) -> Column:
    """Value of the first payload key equal to ``name`` whatever its case."""
    return F.get(F.col(_VALUES), F.array_position(_KEYS, name).cast("int") - 1)


def _has_payload(name: str) -> Column:
    return F.array_contains(_KEYS, name)


def event_field(name: str) -> Column:
    """Column behind a lower-cased field name; the envelope wins over the payload."""
    if name == "timestamp":
        return iso_utc(F.col("timestamp"))
    if name == "user":
        return F.when(_has_payload("targetusername"), _payload("targetusername")).otherwise(F.col("entity.name"))
    if name in _ENVELOPE_FIELDS:
        path = _ENVELOPE_FIELDS[name]
        value = F.col(path).cast("string")
        return F.coalesce(value, F.lit("")) if path in _EMPTY_WHEN_MISSING else value
    if name in _PAYLOAD_ALIASES:
        source = _PAYLOAD_ALIASES[name]
        return F.when(_has_payload(source), _payload(source)).otherwise(_payload(name))
    return _payload(name)


def flatten_events(events: DataFrame, names: list[str]) -> DataFrame:
    """Event id plus one column per named field, as rules see them."""
    arrays = _with_payload_arrays(events)
    return arrays.select("event_id", *[event_field(name.lower()).alias(name) for name in names])


@dataclass(frozen=True)
class Diagnostic:
    rule_id: str
    title: str
    problem: str


@dataclass
class CompiledRules:
    """Columns for a rule set; build with :func:`compile_rules`."""

    rules: list[Rule]
    field_names: list[str]
    selections: list[Column]
    conditions: list[tuple[int, str]]
    diagnostics: list[Diagnostic]


def _refused(items: list, works: Callable[[list], bool]) -> set:
    """Items that Spark refuses. All are tried at once, and by halves where that fails."""
    if not items or works(items):
        return set()
    if len(items) == 1:
        return set(items)
    middle = len(items) // 2
    return _refused(items[:middle], works) | _refused(items[middle:], works)


def _patterns_work(spark: SparkSession) -> Callable[[list[str]], bool]:
    def works(patterns: list[str]) -> bool:
        tests = [F.lit("").rlike(pattern).alias(f"p{i}") for i, pattern in enumerate(patterns)]
        try:
            spark.range(1).select(*tests).collect()
            return True
        except Exception:  # the engine's own error surfaces in several wrappings
            return False

    return works


def _shape(sql: str) -> str:
    """A condition with every selection called ``s``: whether it can be read does not depend on their names."""
    return _SELECTION.sub("`s`", sql)


def _shapes_work(spark: SparkSession) -> Callable[[list[str]], bool]:
    def works(conditions: list[str]) -> bool:
        selections = spark.range(0).select(F.lit(True).alias("s"))
        try:
            return len(selections.select(*[F.expr(c).alias(f"c{i}") for i, c in enumerate(conditions)]).schema) > 0
        except PySparkException:
            return False

    return works


def compile_rules(spark: SparkSession, rules: list[Rule], config: EngineConfig) -> CompiledRules:
    """Turn rules into columns once; problems become diagnostics and false tests."""
    names = sorted(set().union(*[fields_of(rule.detection) for rule in rules])) if rules else []
    column_of = {name: f"_f{i}" for i, name in enumerate(names)}
    patterns = sorted(set().union(*[patterns_of(rule.detection, config) for rule in rules])) if rules else []
    rejected = frozenset(_refused(patterns, _patterns_work(spark)))
    selections: list[Column] = []
    conditions: list[tuple[Rule, str]] = []
    diagnostics: list[Diagnostic] = []

    def reporter(rule: Rule) -> Callable[[str], None]:
        return lambda problem: diagnostics.append(Diagnostic(rule.rule_id, rule.title, problem))

    for rule in rules:
        context = RuleContext(config, reporter(rule), rejected)
        columns: dict[str, str] = {}
        try:
            for key, block in rule.detection.items():
                if key != "condition":
                    for problem in selection_problems(block, context):
                        context.report(problem)
                    test = selection_test(block, lambda name: F.col(column_of[name]), context)
                    columns[key] = f"_s{len(selections)}"
                    selections.append(test.alias(columns[key]))
            conditions.append((rule, documented_sql(rule.condition, columns, context.report)))
        except UnsupportedRule as problem:
            context.report(str(problem))
            conditions.append((rule, "false"))

    # Many rules share few shapes, and a shape is read against one column, whatever the number of selections.
    unreadable = _refused(sorted({_shape(sql) for _, sql in conditions}), _shapes_work(spark))
    for rule, sql in conditions:
        if _shape(sql) in unreadable:
            reporter(rule)(_cannot_be_read(rule.condition))
    final = [(rule.ordinal, "false" if _shape(sql) in unreadable else sql) for rule, sql in conditions]
    return CompiledRules(rules, names, selections, final, diagnostics)


def match_events(events: DataFrame, compiled: CompiledRules, config: EngineConfig) -> DataFrame:
    """Every event column plus ``rule_ordinal``, one row per match.

    A chain of projections and one generator: no join, no shuffle, one scan for
    the whole rule set. Each field is lower-cased once and each
    selection tested once per event. Results are collected as bits of a few
    numbers, so an event that matches nothing costs no array.
    """
    kept = events.columns
    fields = _with_payload_arrays(events) if compiled.field_names else events
    fields = fields.select(
        *kept, *[F.lower(event_field(name)).alias(f"_f{i}") for i, name in enumerate(compiled.field_names)]
    )
    tested = fields.select(*kept, *compiled.selections)

    live = compiled.conditions if config.rules_enabled else []
    passes = [live[i:i + config.rules_per_pass] for i in range(0, len(live), config.rules_per_pass)]
    if not passes:
        return events.withColumn("rule_ordinal", F.lit(0)).limit(0)
    masks = [f"_m{i}" for i in range(len(passes))]
    masked = tested.select(*kept, *[_mask(rules).alias(name) for name, rules in zip(masks, passes)])
    # No filter on the masks here: Spark would push it below the projections and
    # test every rule a second time. The generator drops events without a match.
    ordinals = [_ordinals(F.col(name), rules) for name, rules in zip(masks, passes)]
    return masked.select(
        *kept, F.explode(F.concat(*ordinals) if len(ordinals) > 1 else ordinals[0]).alias("rule_ordinal")
    )


def _mask(rules: list[tuple[int, str]]) -> Column:
    """One bit per rule of a pass, set where its condition holds."""
    bits = [F.expr(f"if({sql}, {1 << i}L, 0L)") for i, (_, sql) in enumerate(rules)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def _ordinals(mask: Column, rules: list[tuple[int, str]]) -> Column:
    """Ordinals of the bits set in ``mask``."""
    named = [
        F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(ordinal)).otherwise(F.lit(-1))
        for i, (ordinal, _) in enumerate(rules)
    ]
    return F.when(mask != 0, F.array_remove(F.array(*named), -1)).otherwise(F.array().cast("array<int>"))


def with_rule_attributes(matches: DataFrame, rules: list[Rule]) -> DataFrame:
    """Attach title, level, severity, MITRE and narration text of the rule.

    The rule table is a local relation of known size, so Spark broadcasts it by
    its own threshold and falls back to a shuffled join above it.
    """
    return matches.join(rule_attributes(matches.sparkSession, rules), "rule_ordinal")


def detect(events: DataFrame, rules: list[Rule], config: EngineConfig) -> DataFrame:
    """Matches with rule attributes, ready for correlation."""
    compiled = compile_rules(events.sparkSession, rules, config)
    return with_rule_attributes(match_events(events, compiled, config), rules)


def diagnostics_table(spark: SparkSession, compiled: CompiledRules) -> DataFrame:
    rows = [(d.rule_id, d.title, d.problem) for d in compiled.diagnostics]
    return spark.createDataFrame(rows, "rule_id string, title string, problem string")


def _cannot_be_read(condition: str) -> str:
    return f"condition cannot be read: {condition!r}"


_CHECKED = """rule_id string, title string, problems array<string>, shape string, unread string,
    patterns array<struct<pattern: string, problem: string>>"""


def _check_rules(config: EngineConfig):
    """What can be told of each rule by itself; what Spark has to be asked is named by shape and pattern."""

    def check(rule_id: str, title: str, condition: str, detection: dict) -> tuple:
        problems: list[str] = []
        context = RuleContext(config, problems.append)
        try:
            for key, block in detection.items():
                if key != "condition":
                    problems.extend(selection_problems(block, context))
            names = {key: "s" for key in detection if key != "condition"}
            shape = documented_sql(condition, names, context.report)
        except UnsupportedRule as problem:
            problems.append(str(problem))
            shape = "false"
        patterns = [{"pattern": pattern, "problem": refused_pattern(value)} for value, pattern in stated_patterns(detection, config)]
        return rule_id, title, problems, shape, _cannot_be_read(condition), patterns

    def checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [check(*row, json.loads(detection)) for *row, detection in batch.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["rule_id", "title", "problems", "shape", "unread", "patterns"])

    return checked


def rule_problems(catalog: DataFrame, config: EngineConfig) -> DataFrame:
    """(rule_id, title, problem) of a rule catalog of any size, as :func:`compile_rules` reports them.

    Rules are checked where they lie. Only the distinct shapes of conditions and the distinct regular expressions come to
    the driver, as Spark has to be asked about them there.
    """
    spark = catalog.sparkSession
    usable = catalog.filter(F.col("load_status") == "ok")
    if "enabled" in catalog.columns:
        usable = usable.filter("enabled")
    given = usable.select("rule_id", "title", "condition", "detection")
    checked = stage(given.mapInPandas(_check_rules(config), _CHECKED), "checked-rules")
    who = ["rule_id", "title"]
    told = checked.select(*who, F.explode("problems").alias("problem"))

    shapes = sorted(row.shape for row in checked.select("shape").distinct().collect())
    unreadable = [(shape,) for shape in sorted(_refused(shapes, _shapes_work(spark)))]
    unread = checked.join(spark.createDataFrame(unreadable, "shape string"), "shape").select(*who, F.col("unread").alias("problem"))

    asked = checked.select(*who, F.explode("patterns").alias("p")).select(*who, "p.*")
    patterns = sorted(row.pattern for row in asked.select("pattern").distinct().collect())
    rejected = [(pattern,) for pattern in sorted(_refused(patterns, _patterns_work(spark)))]
    refused = asked.join(spark.createDataFrame(rejected, "pattern string"), "pattern").select(*who, "problem")
    return told.unionByName(unread).unionByName(refused)
