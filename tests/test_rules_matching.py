"""Field tests and conditions in both semantics modes."""

import pytest
from helpers import events_frame, make_event, make_rule
from pyspark.sql import functions as F

from embertrace.config import EngineConfig
from embertrace.operators.detect import compile_rules, diagnostics_table, flatten_events, match_events

DOC, OBS = EngineConfig(), EngineConfig(semantics="observed")


def payload_events(spark):
    payloads = {
        "cmd": {"CommandLine": "PowerShell.exe -Enc ABC", "EventID": "4688"},
        "logon": {"EventID": "4625", "IpAddress": "10.1.2.3", "TargetUserName": "Bob", "Count": "7"},
        "six": {"IpAddress": "2001:db8::5"},
        "none": {},
        "nullish": {"Note": None, "Flag": "true", "Ratio": "30.0", "Word": "none"},
    }
    return events_frame(spark, [make_event(i, event_id=name, payload=p) for i, (name, p) in enumerate(payloads.items())])


CASES = [
    ({"commandline": "powershell.exe -enc abc"}, {"cmd"}, {"cmd"}),
    ({"CommandLine|contains": ["xyz", "ENC"]}, {"cmd"}, {"cmd"}),
    ({"CommandLine|contains|all": ["power", "enc"]}, {"cmd"}, {"cmd"}),
    ({"CommandLine|contains|all": ["power", "nothere"]}, set(), {"cmd"}),
    ({"cmd|startswith": "power"}, {"cmd"}, {"cmd"}),
    ({"cmd|endswith": ["abc"]}, {"cmd"}, {"cmd"}),
    ({"cmd|windash": "/enc"}, {"cmd"}, {"cmd"}),
    ({"EventID|re": r"^46\d\d$"}, {"cmd", "logon"}, {"cmd", "logon"}),
    ({"Count|re": r"\D"}, set(), {"logon"}),
    ({"Count|re": "(bad"}, set(), set()),
    ({"Count|re": r"(?P<n>7)"}, {"logon"}, set()),
    ({"src_ip|cidr": "10.1.255.255/16"}, {"logon"}, {"logon"}),
    ({"src_ip|cidr": ["2001:db8::/32", "junk"]}, {"six"}, {"six"}),
    ({"src_ip|cidr": "10.0.0.0/33"}, set(), set()),
    ({"Flag": True}, {"nullish"}, {"nullish"}),
    ({"Ratio": 30.0}, {"nullish"}, {"nullish"}),
    ({"Note|null": None}, {"cmd", "logon", "six", "none", "nullish"}, {"cmd", "logon", "six", "none", "nullish"}),
    ({"Word": None}, {"cmd", "logon", "six", "none"}, {"nullish"}),
    ({"EventID": [4625, "x"]}, {"logon"}, {"logon"}),
    ({"EventID": []}, set(), set()),
    ({"user": "bob"}, {"logon"}, {"logon"}),
    ({"username": "ANA"}, {"cmd", "logon", "six", "none", "nullish"}, {"cmd", "logon", "six", "none", "nullish"}),
    ({"EventID|gt": 4000}, set(), set()),
    ({"Word": "n*e"}, set(), set()),
    ([{"EventID": 4688}, {"Flag": "TRUE"}], {"cmd", "nullish"}, {"cmd", "nullish"}),
    ({}, {"cmd", "logon", "six", "none", "nullish"}, {"cmd", "logon", "six", "none", "nullish"}),
    (["a keyword"], set(), set()),
    ("just text", set(), set()),
]


@pytest.mark.parametrize("config", [DOC, OBS], ids=["documented", "observed"])
def test_field_tests(spark, config):
    rules = [make_rule(i, {"selection": block, "condition": "selection"}) for i, (block, _, _) in enumerate(CASES)]
    found = match_events(payload_events(spark), compile_rules(spark, rules, config), config)
    got = {r.rule_ordinal: set(r.ids) for r in found.groupBy("rule_ordinal").agg(F.collect_set("event_id").alias("ids")).collect()}
    for i, (block, documented, observed) in enumerate(CASES):
        assert got.get(i, set()) == (documented if config is DOC else observed), block


# On an event where a is true, b is false and c is true.
CONDITIONS = [
    ("not b and c", True), ("not a and b", False), ("a or b and b", True),
    ("(a and b) or c", True), ("(b or a) and (b or c)", True), ("1 of them", True),
    ("all of them", False), ("a and not b", True), ("a", True), ("b", False),
    ("a AND c", True), ("b OR c", True), ("not (a and b)", True), ("(a)", True),
    ("1 of a*", True), ("all of c*", True), ("1 of x*", False), ("all of x*", False),
    ("unknown", False), ("not unknown", True), ("", False), ("a and", False),
    ("a | count() > 5", False), ("((a)", False), ("a c", False),
]


@pytest.mark.parametrize("config", [DOC, OBS], ids=["documented", "observed"])
def test_conditions(spark, config):
    parts = {"a": {"action": "x"}, "b": {"action": "y"}, "c": {"severity": 0}}
    rules = [make_rule(i, {**parts, "condition": text}) for i, (text, _) in enumerate(CONDITIONS)]
    found = match_events(events_frame(spark, [make_event(0)]), compile_rules(spark, rules, config), config)
    got = {r.rule_ordinal for r in found.collect()}
    for i, (text, wanted) in enumerate(CONDITIONS):
        assert (i in got) == wanted, text


def test_problems_are_reported(spark):
    rules = [
        make_rule(0, {"selection": ["word"], "condition": "selection"}),
        make_rule(1, {"selection": {"a|nope": 1}, "condition": "selection or other"}),
        make_rule(2, {"selection": {"a|re": "(?P<x>[)"}, "condition": "selection"}),
        make_rule(3, {"selection": {"a": 1}, "condition": "selection and ("}),
        make_rule(4, {"selection": {"a": 1}, "condition": "selection"}),
        make_rule(5, {"selection": {"a|re": r"a(?(1)b|c)"}, "condition": "selection"}),
    ]
    table = diagnostics_table(spark, compile_rules(spark, rules, DOC)).collect()
    assert {r.rule_id for r in table} == {"id-0", "id-1", "id-2", "id-3", "id-5"}
    assert {r.problem for r in table if r.rule_id == "id-1"} == {
        "unknown modifier 'nope' in 'a|nope'", "unknown selection 'other'"}


def test_a_pattern_only_python_accepts_does_not_break_the_others(spark):
    rules = [
        make_rule(0, {"selection": {"action|re": ["(x)(?(1)|y)", "^x$"]}, "condition": "selection"}),
        make_rule(1, {"selection": {"action": "x"}, "condition": "selection"}),
    ]
    found = match_events(events_frame(spark, [make_event(0)]), compile_rules(spark, rules, DOC), DOC)
    assert {r.rule_ordinal for r in found.collect()} == {0, 1}


def test_many_rules_take_several_passes(spark):
    config = DOC.with_(rules_per_pass=16)
    rules = [make_rule(i, {"s": {"severity": i % 3}, "condition": "s"}) for i in range(130)]
    events = events_frame(spark, [make_event(i, severity=i % 4, event_id=str(i)) for i in range(8)])
    found = match_events(events, compile_rules(spark, rules, config), config)
    assert found.count() == sum(1 for i in range(8) for r in range(130) if i % 4 == r % 3)


def test_master_switch(spark):
    config = DOC.with_(rules_enabled=False)
    rules = [make_rule(0, {"s": {"severity": 0}, "condition": "s"})]
    assert match_events(events_frame(spark, [make_event(0)]), compile_rules(spark, rules, config), config).count() == 0


def test_envelope_wins_over_the_payload(spark):
    event = make_event(0.25, event_id="e1", domain="CORP", payload={
        "event_id": "shadowed", "HOST": "shadowed", "timestamp": "shadowed", "Custom": "1", "custom": "2"})
    row = flatten_events(events_frame(spark, [event]), ["host", "timestamp", "domain", "custom", "severity"]).first()
    assert row.asDict() == {"event_id": "e1", "host": "PC-1", "timestamp": "2026-05-13T10:00:00.250000+00:00",
                            "domain": "CORP", "custom": "1", "severity": "0"}


def test_problems_of_a_catalog_are_those_of_its_compiled_rules(spark):
    import json

    from embertrace.operators.detect import rule_problems

    blocks = [
        {"selection": ["word"], "condition": "selection"}, {"selection": {"a|nope": 1}, "condition": "selection or other"},
        {"selection": {"a|re": "(?P<x>[)"}, "condition": "selection"}, {"selection": {"a": 1}, "condition": "selection and ("},
        {"selection": {"a": 1}, "condition": "selection"}, {"selection": [{"a|re": r"a(?(1)b|c)"}], "condition": "selection"},
        {"s_a": {"a|cidr": ["10.0.0.0/8", "x"]}, "s_b": {"a": 1}, "condition": "all of s_* and 1 of t*"},
        {"s_a": {"a": 1}, "s_b": {"a": 2}, "condition": "s_a s_b"}, {"s_a": {"a": 1}, "condition": "s_a not and s_a"},
    ]
    rules = [make_rule(i, block) for i, block in enumerate(blocks)]
    catalog = spark.createDataFrame(
        [(r.rule_id, r.title, r.condition, json.dumps(r.detection), "ok") for r in rules],
        "rule_id string, title string, condition string, detection string, load_status string")
    told = diagnostics_table(spark, compile_rules(spark, rules, DOC))
    assert sorted(rule_problems(catalog, DOC).collect()) == sorted(told.collect())


def test_faulty_rules_are_found_in_few_trials(spark):
    from embertrace.operators import detect

    rules = [make_rule(i, {"s": {"severity": i}, "condition": "s and and s" if i % 2 else "s"}) for i in range(40)]
    trials, asked = [], detect._shapes_work(spark)
    found = detect._refused(sorted({detect._shape(f"(`_s{i}` AND AND `_s{i}`)" if i % 2 else f"(`_s{i}`)") for i in range(40)}),
                            lambda items: trials.append(items) or asked(items))
    assert found == {"(`s` AND AND `s`)"} and len(trials) <= 3
    assert len(compile_rules(spark, rules, DOC).diagnostics) == 20
