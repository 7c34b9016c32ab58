"""Record files, normalisation and rule files."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from embertrace.config import EngineConfig
from embertrace.sources.json_logs import explode_documents, load_json
from embertrace.sources.normalise import accepted, normalise, quarantine, validate_events
from embertrace.sources.rules import collect_rules, enabled_rules, load_rules, rules_table

DOC, OBS = EngineConfig(), EngineConfig(semantics="observed")

FILES = {
    "array.json": ('[{"id":1},{"id":2}]', [1, 2]),
    "pretty.json": ('[\n  {"id": 3},\n  {"id": 4}\n]\n', [3, 4]),
    "wrapped.json": ('{"count": 2,\n "events": [\n{"id":5},\n{"id":6}\n]}', [5, 6]),
    "single.json": ('{"id":7, "events": "not a list"}', [7]),
    "lines.json": ('{"id":8}\n\nbroken\n5\n[1]\n{"id":9}\n', [8, 9]),
    "first_broken.json": ('oops\n{"id":10}\n', [10]),
    "lines_of_wrappers.json": ('{"id":11,"data":[{"id":0}]}\n{"id":12}\n', [11, 12]),
    "trailing_comma.json": ('{"id":13},\n{"id":14}\n{"id":15} {"id":0}\n', [14]),
    "empty.json": ("", []),
}


def test_every_file_layout(spark, tmp_path):
    for name, (text, _) in FILES.items():
        (tmp_path / name).write_text(text)
    rows = load_json(spark, str(tmp_path)).collect()
    got = {}
    for row in rows:
        got.setdefault(Path(row.file).name, []).append(json.loads(row.raw)["id"])
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, (_, v) in FILES.items() if v}


def test_documents_and_files_agree(spark):
    rows = spark.createDataFrame([(k, v[0]) for k, v in FILES.items()], "name string, content string")
    got = {}
    for row in explode_documents(rows).collect():
        got.setdefault(row.name, []).append(json.loads(row.raw)["id"])
    assert got == {k: v for k, (_, v) in FILES.items() if v}


def _norm(spark, record, config=DOC):
    text = record if isinstance(record, str) else json.dumps(record)
    return normalise(spark.createDataFrame([(text,)], "raw string"), config, index=F.lit(3)).first()


@pytest.mark.parametrize("record, reason", [
    ("5", "not an object"), ("[1]", "not an object"), ("garbage", "not an object"),
    ({"timestamp": "2026-01-01", "entity": None}, "block is not an object"),
    ({"timestamp": "2026-01-01", "event": "x"}, "block is not an object"),
    ({"timestamp": "2026-01-01", "mitre": [1]}, "block is not an object"),
    ({"timestamp": "2026"}, "unreadable timestamp"), ({"time": "yesterday"}, "unreadable timestamp"),
    ({"user": "x"}, "no timestamp"), ({"timestamp": "2026-01-01T10:00:00+02:00"}, None),
])
def test_rejects(spark, record, reason):
    assert _norm(spark, record).reject_reason == reason


def test_quarantine_and_accepted_are_complements(spark):
    frame = spark.createDataFrame([('{"timestamp":"2026-01-01"}',), ("5",)], "raw string")
    rows = normalise(frame, DOC)
    assert (accepted(rows).count(), quarantine(rows).count()) == (1, 1)


def test_host_and_payload_by_mode(spark):
    record = {"timestamp": "2026-01-01T00:00:00Z", "source": "sensor", "entity": {"name": "ana", "host": "PC"},
              "raw_payload": {"EventID": "4625", "source": "inner"}}
    documented, observed = _norm(spark, record), _norm(spark, record, OBS)
    assert (documented.entity.host, observed.entity.host) == ("PC", "sensor")
    assert documented.raw_payload["EventID"] == "4625" and "EventID" not in observed.raw_payload
    assert documented.raw_payload["source"] == "sensor"
    assert (documented.event.type, observed.event.type) == ("auth", "other")


def test_values_keep_their_text(spark):
    row = _norm(spark, {"timestamp": "2026-01-01T00:00:00Z", "a": 30.0, "b": True, "c": 445, "d": None, "e": ["x"]})
    assert [row.raw_payload[k] for k in "abcde"] == ["30.0", "true", "445", None, '["x"]']


def test_missing_time_takes_the_ingest_time_in_observed_mode(spark):
    frame = spark.createDataFrame([('{"user":"x"}',)], "raw string")
    row = normalise(frame, OBS, ingest_time=F.lit("2026-01-02").cast("timestamp")).first()
    assert row.reject_reason is None and row.timestamp.day == 2


@pytest.mark.parametrize("fields, kind", [
    ({"user": "10.0.0.1"}, "ip"), ({"user": "PC", "host": "PC"}, "host"), ({"user": "ana"}, "user"),
    ({"user": "1.2.3"}, "user"), ({"entity": {"name": "x", "type": "service"}}, "service"),
    ({"entity": {"name": "x", "type": "robot"}}, "user"), ({}, "user"),
])
def test_entity_type(spark, fields, kind):
    row = _norm(spark, {"timestamp": "2026-01-01", **fields})
    assert row.entity.type == kind
    assert fields or row.entity.name == "unknown_3"


@pytest.mark.parametrize("fields, kind", [
    ({"EventID": 4624}, "auth"), ({"EventID": " 4688 "}, "process"), ({"EventID": 3}, "network"),
    ({"event_id": "13"}, "registry"), ({"msg": "HKLM changed"}, "registry"), ({"msg": "Deleted"}, "file"),
    ({"event": {"type": "dns"}}, "dns"), ({"event_type": "odd", "msg": "socket"}, "network"), ({"msg": "?"}, "other"),
])
def test_event_type(spark, fields, kind):
    assert _norm(spark, {"timestamp": "2026-01-01", **fields}).event.type == kind


@pytest.mark.parametrize("fields, severity", [
    ({"severity": 4}, 4), ({"event": {"severity": 0}, "Level": 3}, 3), ({"severity": "7.9"}, 0), ({"Level": "x"}, 0), ({}, 0),
])
def test_severity(spark, fields, severity):
    assert _norm(spark, {"timestamp": "2026-01-01", **fields}).event.severity == severity


def test_live_events_are_validated(spark):
    from helpers import events_frame, make_event

    good, bad = make_event(0, event_id="good"), list(make_event(1, event_id="bad"))
    bad[2] = "elsewhere"
    rows = {r.event_id: r.problem for r in validate_events(events_frame(spark, [good, tuple(bad)]), DOC).collect()}
    assert rows == {"good": None, "bad": "unknown source"}


RULE_FILES = {
    "a.yml": "title: Alpha\nlevel: high\ntags: [attack.t1059.001, attack.initial_access, attack.g0001]\n"
             "description: First part. Rest.\ndetection: {selection: {a: 1}, condition: selection}\n",
    "deep/b.yaml": "description: ''\nlevel: Informational\ndetection: {s: {a: [1, x]}, condition: s}\n",
    "c.yml": "- a list\n", "d.yml": "title: [unclosed", "e.yml": "title: ''\n", "f.yml": "title: F\ndescription: null\n",
    "g.yml": "title: G\ntags: [5]\n", "ignored.txt": "title: T\n", "h.yml": "title: H\ndetection: [1]\n",
}


@pytest.fixture
def rule_folder(tmp_path):
    for name, text in RULE_FILES.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_rule_files(spark, rule_folder):
    rows = {r.file_path: r for r in load_rules(spark, rule_folder, DOC).collect()}
    assert {k: r.load_status for k, r in rows.items()} == {
        "a.yml": "ok", "deep/b.yaml": "ok", "c.yml": "failed", "d.yml": "failed", "e.yml": "failed", "f.yml": "failed",
        "g.yml": "failed", "h.yml": "failed"}
    a, b = rows["a.yml"], rows["deep/b.yaml"]
    assert (a.mitre_id, a.mitre_tactic, a.chain_stage, a.severity, a.risk_points, a.summary) == (
        "T1059.001", "Initial Access", "Initial Access", 7, 20, "First part")
    assert (b.title, b.severity, b.summary, b.mitre_id, b.chain_stage) == ("b", 1, "b", None, "Unknown")


def test_rule_quirks_of_the_observed_mode(spark, rule_folder):
    rows = {r.file_path: r for r in load_rules(spark, rule_folder, OBS).collect()}
    assert (rows["a.yml"].mitre_tactic, rows["a.yml"].chain_stage) == ("G0001", "Unknown")
    assert rows["deep/b.yaml"].severity == 5


def test_reload_keeps_ids_and_overrides(spark, rule_folder):
    first = load_rules(spark, rule_folder, DOC)
    off = first.filter("title = 'Alpha'").select("rule_id", F.lit(False).alias("enabled"))
    again = rules_table(load_rules(spark, rule_folder, DOC), F.lit("2026-01-01").cast("timestamp"), off)
    assert {(r.title, r.enabled) for r in again.collect()} == {("Alpha", False), ("b", True)}
    assert [r.title for r in enabled_rules(again, DOC).collect()] == ["b"]
    assert [r.title for r in collect_rules(first)] == ["Alpha", "b"]
