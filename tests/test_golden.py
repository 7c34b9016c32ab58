"""A multi-stage attack with known alerts, positions, risk and escalation."""

import pytest
from helpers import events_frame, make_event, make_rule
from pyspark.sql import functions as F

from embertrace.config import EngineConfig
from embertrace.plans.pipeline import correlate

# seconds, entity, technique, host
ATTACK = [
    (0, "jsmith", "T1110", "WKSTN-04"), (75, "jsmith", "T1110", "WKSTN-04"), (150, "jsmith", "T1110", "WKSTN-04"),
    (240, "jsmith", "T1078", "WKSTN-04"), (322, "jsmith", "T1059.001", "WKSTN-04"),
    (370, "jsmith", "T1548.002", "WKSTN-04"), (525, "jsmith", "T1068", "WKSTN-04"),
    (690, "jsmith", "T1547.001", "WKSTN-04"), (840, "10.0.0.44", "T1021.002", "10.0.0.1"),
    (980, "10.0.0.44", "T1071.001", "185.220.101.34"), (1085, "10.0.0.44", "T1041", "185.220.101.34"),
]
# position, entity risk before and after, new link, escalates
EXPECTED = [
    (1, 0, 20, True, False), (1, 20, 40, False, False), (1, 40, 60, False, False), (2, 60, 95, True, False),
    (3, 95, 100, True, True), (4, 100, 100, True, False), (5, 100, 100, True, False), (6, 100, 100, True, False),
    (1, 0, 20, True, False), (2, 20, 55, True, False), (3, 55, 90, True, False),
]


def attack(spark):
    return events_frame(spark, [
        make_event(s, who, "ip" if who[0] == "1" else "user", host, technique=t) for s, who, t, host in ATTACK
    ])


def technique_rules():
    found = sorted({t for _, _, t, _ in ATTACK})
    return [make_rule(i, {"selection": {"technique": t}, "condition": "selection"}, title=f"Uses {t}")
            for i, t in enumerate(found)]


@pytest.fixture(scope="module")
def run(spark):
    return correlate(attack(spark), technique_rules(), EngineConfig())


def test_alerts(run):
    rows = run.alerts.orderBy("t").collect()
    got = [(r.chain_position, r.entity_risk_before, r.entity_risk_after, r.is_new_link, r.escalates) for r in rows]
    assert got == EXPECTED
    assert [(r.chain_risk_before, r.chain_risk_after) for r in rows] == [(e[1], e[2]) for e in EXPECTED]


def test_chains(run):
    rows = {r.entity_name: r for r in run.chains().collect()}
    assert (rows["jsmith"].link_count, rows["jsmith"].duration_minutes, rows["jsmith"].is_escalated) == (6, 11.5, True)
    other = rows["10.0.0.44"]
    assert (other.link_count, other.duration_minutes, other.is_escalated, other.risk_score) == (3, 4.1, False, 90)
    assert other.entity_host == "10.0.0.1"
    assert all(link.alert_id for link in other.links)


def test_chain_story_mentions_escalation_only_once_it_happened(run):
    story = {r.entity_name: r.narrative for r in run.chains().collect()}
    assert "CRITICAL escalation triggered." in story["jsmith"]
    assert "escalation" not in story["10.0.0.44"]
    assert story["10.0.0.44"].splitlines()[1] == "3 distinct rules fired over 4.1 minutes."


def test_entities(run):
    rows = {r.name: r for r in run.entities().collect()}
    assert (rows["jsmith"].host, rows["jsmith"].risk_level, rows["jsmith"].total_alerts) == ("WKSTN-04", "CRITICAL", 8)
    assert (rows["10.0.0.44"].host, rows["10.0.0.44"].type) == ("10.0.0.1", "ip")
    assert rows["jsmith"].rules_fired[:2] == ["Uses T1110", "Uses T1078"]


def test_stored_alert_rows_have_the_table_schema(run):
    from embertrace.schemas import ALERTS_SCHEMA

    rows = run.alert_rows()
    assert rows.columns == ALERTS_SCHEMA.fieldNames()
    assert [f.dataType for f in rows.schema] == [f.dataType for f in ALERTS_SCHEMA]
    first = rows.orderBy("timestamp").first()
    assert first.who == "jsmith@WKSTN-04 [USER] Risk 0/100 (LOW) | Chain: 1 steps"
    assert first.when_field.endswith("(first detection on this entity)")


def test_cooldown_is_greedy(spark):
    config = EngineConfig(cooldown_seconds=120)
    rows = correlate(attack(spark), technique_rules(), config).alerts.filter("entity_name = 'jsmith'").orderBy("t").collect()
    assert [r.event_id for r in rows[:3]] == ["jsmith-0", "jsmith-150", "jsmith-240"]
    assert [r.entity_risk_after for r in rows[:4]] == [20, 40, 75, 100]
    assert rows[3].escalates


@pytest.mark.parametrize("cooldown", [0, 60])
def test_repeated_deliveries_do_not_depend_on_the_fold(spark, cooldown):
    # The second delivery of an event may even carry another time.
    events = [make_event(0, action="x", event_id="a"), make_event(0, action="x", event_id="a"),
              make_event(90, action="x", event_id="a"), make_event(100, action="x", event_id="b")]
    rules = [make_rule(0, {"s": {"action": "x"}, "condition": "s"})]
    for fold_limit in (1, 10_000):
        config = EngineConfig(cooldown_seconds=cooldown, fold_limit=fold_limit)
        rows = correlate(events_frame(spark, events), rules, config).alerts.orderBy("t").collect()
        assert [(r.event_id, r.entity_risk_after) for r in rows] == [("a", 20), ("b", 40)]


def test_same_ids_on_a_second_run_and_with_shuffled_input(spark, run):
    again = correlate(attack(spark).orderBy(F.rand(7)), technique_rules(), EngineConfig())
    key = ["alert_id", "chain_id", "chain_position", "entity_risk_after"]
    assert again.alerts.select(key).exceptAll(run.alerts.select(key)).count() == 0
    assert run.alerts.select(key).exceptAll(again.alerts.select(key)).count() == 0
