"""Rule files: scan, parse, and describe as a DataFrame; pick the compiled set."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from embertrace.config import EngineConfig
from embertrace.functions import mitre, scoring
from embertrace.functions.common import stable_id

try:
    import yaml
    _LOADER = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
except ImportError:  # the YAML source is unavailable without PyYAML
    yaml = None

_PARSED = """
    file_path string, load_status string, title string, description string, author string,
    status string, level string, tags array<string>, logsource string, detection string,
    condition string, fields array<string>
"""


def rule_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file_path, content) of every .yml and .yaml file below ``folder``.

    Paths are relative to the folder, so rule ids survive a move of the folder.
    """
    folder = folder.rstrip("/")
    inside = F.substring_index("path", folder.split("://")[-1] + "/", -1)
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{yml,yaml}")
        .load(folder)
        .select(inside.alias("file_path"), F.col("content").cast("string").alias("content"))
    )


def _text_or_none(value, allow_none: bool) -> bool:
    return isinstance(value, str) or (allow_none and value is None)


def _read_rule(file_path: str, content: str) -> dict:
    """One parsed rule row, or a row with only ``load_status = 'failed'``."""
    failed = {"file_path": file_path, "load_status": "failed"}
    try:
        raw = yaml.load(content, Loader=_LOADER)
    except (yaml.YAMLError, ValueError):
        return failed
    if not isinstance(raw, dict):
        return failed

    title = raw.get("title", PurePosixPath(file_path).stem)
    lists = {key: raw.get(key) or [] for key in ("tags", "fields")}
    blocks = {key: raw.get(key) or {} for key in ("logsource", "detection")}
    texts = {"description": raw.get("description", ""), "status": raw.get("status", "experimental"),
             "level": raw.get("level", "medium")}
    usable = (
        isinstance(title, str) and title
        and all(isinstance(text, str) for text in texts.values())
        and _text_or_none(raw.get("author"), allow_none=True)
        and all(isinstance(items, list) and all(isinstance(i, str) for i in items) for items in lists.values())
        and all(isinstance(block, dict) for block in blocks.values())
    )
    if not usable:
        return failed
    return {
        "file_path": file_path, "load_status": "ok", "title": title, "author": raw.get("author"),
        **texts, **lists,
        "logsource": json.dumps(blocks["logsource"], default=str),
        "detection": json.dumps(blocks["detection"], default=str),
        "condition": str(blocks["detection"].get("condition", "")),
    }


_COLUMNS = [part.split()[0] for part in _PARSED.replace("\n", " ").split(", ")]


def _read_rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [_read_rule(path, text) for path, text in zip(batch["file_path"], batch["content"])]
        yield pd.DataFrame(rows, columns=_COLUMNS).astype(object).where(lambda d: d.notna(), None)


def parse_rules(files: DataFrame) -> DataFrame:
    """(file_path, content) rows to parsed rules, one row per file.

    Parsing costs far more than moving a rule, and small files arrive in few
    partitions, so they are spread over the cluster first.
    """
    if yaml is None:
        raise ImportError("PyYAML is needed to read rule files")
    return files.select("file_path", "content").repartition("file_path").mapInPandas(_read_rules, _PARSED)


def describe_rules(parsed: DataFrame, config: EngineConfig) -> DataFrame:
    """Add ids, MITRE mapping, severity, risk points and the one-line summary."""
    level = F.col("level")
    tactic = mitre.tactic_of(F.col("tags"), config)
    ok = F.col("load_status") == "ok"
    return (
        parsed.withColumn("rule_id", F.when(ok, stable_id("file_path", "title")))
        .withColumn("mitre_id", mitre.technique_of(F.col("tags")))
        .withColumn("mitre_tactic", tactic)
        .withColumn("chain_stage", F.when(ok, mitre.stage_of(F.col("mitre_tactic"))))
        .withColumn("severity", F.when(ok, scoring.rule_severity(level, config)))
        .withColumn("risk_points", F.when(ok, scoring.risk_points(level)))
        .withColumn("summary", rule_summary(F.col("description"), F.col("title")))
    )


def rule_summary(description, title):
    """Description up to its first full stop, or the title where there is none."""
    return F.when(F.length(description) > 0, F.trim(F.substring_index(description, ".", 1))).otherwise(title)


def load_rules(spark: SparkSession, folder: str, config: EngineConfig) -> DataFrame:
    """Rule catalog of a folder: one row per file, failures included."""
    return describe_rules(parse_rules(rule_files(spark, folder)), config)


def rules_table(catalog: DataFrame, loaded_at, overrides: DataFrame | None = None) -> DataFrame:
    """The ``rules`` table: loaded rules, with on/off overrides by ``rule_id``."""
    loaded = catalog.filter(F.col("load_status") == "ok")
    if overrides is None:
        loaded = loaded.withColumn("enabled", F.lit(True))
    else:
        switch = overrides.select("rule_id", F.col("enabled").alias("_enabled"))
        loaded = loaded.join(switch, "rule_id", "left").withColumn(
            "enabled", F.coalesce("_enabled", F.lit(True))
        )
    return loaded.select(
        "rule_id", "title", "description", "author", "status", "level", "tags", "mitre_id", "mitre_tactic",
        "chain_stage", "logsource", "detection", "condition", "fields", "file_path",
        loaded_at.alias("loaded_at"), F.lit(0).cast("bigint").alias("match_count"), "enabled",
    )


def enabled_rules(rules: DataFrame, config: EngineConfig) -> DataFrame:
    """Rules that take part in detection; none while the master switch is off."""
    return rules.filter(F.col("enabled") & F.lit(config.rules_enabled))


@dataclass(frozen=True)
class Rule:
    """What detection and narration need of one enabled rule."""

    ordinal: int
    rule_id: str
    title: str
    level: str
    condition: str
    detection: dict
    file_path: str | None
    mitre_id: str | None
    mitre_tactic: str | None
    chain_stage: str
    severity: int
    risk_points: int
    summary: str


def collect_rules(catalog: DataFrame) -> list[Rule]:
    """Bring the usable rules to the driver, where they become Columns.

    A rule set is configuration (files written by people), not data: its size
    does not depend on the events.
    """
    usable = catalog.filter(F.col("load_status") == "ok")
    if "enabled" in catalog.columns:
        usable = usable.filter("enabled")
    rows = usable.select(
        "rule_id", "title", "level", "condition", "detection", "file_path", "mitre_id", "mitre_tactic", "chain_stage",
        "severity", "risk_points", "summary",
    ).orderBy("file_path").collect()
    return [
        Rule(**{**row.asDict(), "ordinal": n, "detection": json.loads(row["detection"])}) for n, row in enumerate(rows)
    ]


_ATTRIBUTES = pa.schema([
    ("rule_ordinal", pa.int32()), ("rule_id", pa.string()), ("rule_title", pa.string()), ("title_key", pa.int64()),
    ("rule_level", pa.string()), ("severity", pa.int32()), ("risk_points", pa.int32()), ("mitre_id", pa.string()),
    ("mitre_tactic", pa.string()), ("chain_stage", pa.string()), ("rule_summary", pa.string()), ("why", pa.string()),
])


def title_key(title: str) -> int:
    """64-bit hash of a rule title: the same whatever other rules are loaded."""
    return int.from_bytes(hashlib.sha256(title.encode()).digest()[:8], "big", signed=True)


def rule_attributes(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Attributes joined to matches by ``rule_ordinal``.

    Built from Arrow, which gives a local relation: Spark knows its size, so it
    can choose to broadcast this side and never the matches.
    """
    rows = [
        (r.ordinal, r.rule_id, r.title, title_key(r.title), r.level, r.severity, r.risk_points, r.mitre_id,
         r.mitre_tactic, r.chain_stage, r.summary, explain_rule(r))
        for r in rules
    ]
    columns = list(zip(*rows)) or [()] * len(_ATTRIBUTES)
    table = pa.table([pa.array(values, field.type) for values, field in zip(columns, _ATTRIBUTES)], schema=_ATTRIBUTES)
    return spark.createDataFrame(table)


def explain_rule(rule: Rule, max_lines: int | None = 6, max_values: int | None = 3) -> str:
    """WHY text: what each selection asks for, then the condition, then where the rule is kept.

    ``max_lines`` bounds the lines on selections and condition together, ``max_values`` the alternatives listed for a
    selection; None shows all.
    """
    criteria = [
        f"  {label}: {wanted}"
        for name, selection in rule.detection.items() if name != "condition"
        for label, wanted in _asked_for(name, selection, max_values)
    ]
    condition = [f"Condition: {rule.detection['condition']}"] if "condition" in rule.detection else []
    room = None if max_lines is None else max(0, max_lines - len(condition))
    told = "\n".join(criteria[:room] + condition)
    return f"Sigma rule '{rule.title}' fired.\n{told}\n\nRule file: {rule.file_path or 'embedded'}"


def _asked_for(name: str, selection: object, max_values: int | None) -> list[tuple[str, object]]:
    """(field or selection, wanted value) pairs of one selection."""
    match selection:
        case dict():
            return list(selection.items())
        case list():
            return [(name, selection[:max_values])]
        case _:
            return []
