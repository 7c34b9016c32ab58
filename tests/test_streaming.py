"""Streams against the batch result: restart, disorder, late rows, resumed state."""

import json
from dataclasses import replace

import pytest
from helpers import events_frame, make_event, make_rule
from pyspark.sql import functions as F

from embertrace.config import EngineConfig
from embertrace.plans.binding import TEST_CONFIG, bound_events, bundled_rules
from embertrace.plans.pipeline import correlate, find_matches
from embertrace.streaming.correlate import correlate_stream, resume_rows
from embertrace.streaming.detect import (
    append_alert_batches, detect_stream, event_stream, valid_events, without_repeats, write_messages,
)

FACTS = ["alert_id", "chain_id", "chain_position", "is_new_link", "entity_risk_before", "entity_risk_after",
         "chain_risk_before", "chain_risk_after", "is_escalated"]


class Flow:
    """Detection and correlation queries over one set of folders."""

    def __init__(self, spark, folder, config, load):
        self.spark, self.config, self.load = spark, config, load
        self.paths = {name: str(folder / name) for name in ("in", "hits", "alerts", "c1", "c2", "out", "c3")}

    def feed(self, events):
        events.coalesce(1).write.mode("append").json(self.paths["in"])

    def detect(self, transform=lambda e: e):
        events = transform(event_stream(self.spark, self.paths["in"]))
        detect_stream(events, self.load, self.config, self.paths["hits"], self.paths["c1"]).awaitTermination()

    def run(self, initial=None, late="10 minutes"):
        self.detect()
        schema = self.spark.read.parquet(self.paths["hits"]).schema
        hits = self.spark.readStream.schema(schema).parquet(self.paths["hits"])
        alerts = correlate_stream(hits, self.config, late, initial)
        append_alert_batches(alerts, self.paths["alerts"], self.paths["c2"]).awaitTermination()

    def alerts(self):
        return self.spark.read.parquet(self.paths["alerts"]).filter("entity_name <> 'end'")


def end_mark(like):
    """An event long after all others, to move the watermark past them."""
    return like.limit(1).withColumns({
        "event_id": F.lit("end"), "timestamp": F.lit("2030-01-01").cast("timestamp"),
        "entity": F.col("entity").withField("name", F.lit("end")),
        "event": F.col("event").withField("action", F.lit("error")),
    })


def same(a, b):
    assert a.select(FACTS).exceptAll(b.select(FACTS)).count() == 0
    assert b.select(FACTS).exceptAll(a.select(FACTS)).count() == 0


def test_stream_equals_batch_across_a_restart(spark, sf_dir, tmp_path):
    events = bound_events(spark, sf_dir)
    flow = Flow(spark, tmp_path, TEST_CONFIG, lambda: bundled_rules(spark))
    flow.feed(events.filter("timestamp < '2024-01-16'").orderBy(F.rand(1)))
    flow.run()
    early = flow.alerts().count()
    flow.feed(events.filter("timestamp >= '2024-01-16'").orderBy(F.rand(2)))
    flow.feed(end_mark(events))
    flow.run()
    same(flow.alerts(), correlate(events, bundled_rules(spark), TEST_CONFIG).alerts)
    assert early > 0


@pytest.fixture
def simple():
    rules = [make_rule(i, {"s": {"action": a}, "condition": "s"}, title=a) for i, a in enumerate(["error", "x", "y"])]
    return EngineConfig(), rules


def test_late_matches_are_dropped_and_others_reordered(spark, tmp_path, simple):
    config, rules = simple
    flow = Flow(spark, tmp_path, config, lambda: rules)
    on_time = [make_event(s, action=a) for s, a in [(600, "x"), (300, "y"), (400, "x")]]
    flow.feed(events_frame(spark, on_time))
    flow.run(late="5 minutes")
    flow.feed(events_frame(spark, [make_event(10_000, action="y")]))
    flow.run(late="5 minutes")
    flow.feed(events_frame(spark, [make_event(1, action="y"), make_event(10_050, action="x")]))
    flow.feed(end_mark(events_frame(spark, on_time)))
    flow.run(late="5 minutes")
    kept = events_frame(spark, [*on_time, make_event(10_000, action="y"), make_event(10_050, action="x")])
    same(flow.alerts(), correlate(kept, rules, config).alerts)


def test_rules_are_read_anew_for_every_batch(spark, tmp_path, simple):
    config, rules = simple
    live = [rules[1]]
    flow = Flow(spark, tmp_path, config, lambda: live)
    flow.feed(events_frame(spark, [make_event(0, action="x"), make_event(1, action="y")]))
    flow.detect()
    live[:] = [rules[1], rules[2]]
    flow.feed(events_frame(spark, [make_event(100, action="x"), make_event(101, action="y")]))
    flow.detect()
    assert {r.event_id for r in spark.read.parquet(flow.paths["hits"]).collect()} == {"ana-0", "ana-100", "ana-101"}


def test_a_reload_that_shifts_the_rules_keeps_their_cooldowns(spark, tmp_path):
    config = EngineConfig()

    def rules(*names):
        return [replace(make_rule(i, {"s": {"action": a}, "condition": "s"}, title=a), rule_id=a) for i, a in enumerate(names)]

    live = rules("m", "z", "error")  # the last one for the end mark
    flow = Flow(spark, tmp_path, config, lambda: live)
    events = [make_event(0, action="m"), make_event(30, action="m"), make_event(31, action="a")]
    flow.feed(events_frame(spark, events[:1]))
    flow.run()
    live[:] = rules("a", "m", "error")
    flow.feed(events_frame(spark, events[1:]))
    flow.feed(end_mark(events_frame(spark, events)))
    flow.run()
    whole = correlate(events_frame(spark, events), rules("a", "m", "z"), config).alerts
    assert sorted(r.t for r in whole.collect()) == sorted(r.t for r in flow.alerts().collect())
    same(flow.alerts(), whole)


def test_resumed_state_remembers_cooldowns(spark, tmp_path, simple):
    config, rules = simple
    first, second = [make_event(0, action="x")], [make_event(30, action="x"), make_event(70, action="x")]
    flow = Flow(spark, tmp_path, config, lambda: rules)
    flow.feed(events_frame(spark, second))
    flow.feed(end_mark(events_frame(spark, second)))
    flow.run(initial=resume_rows(correlate(events_frame(spark, first), rules, config).alerts))
    assert [r.event_id for r in flow.alerts().collect()] == ["ana-70"]


def test_resumed_state_continues_chain_and_risk(spark, tmp_path, simple):
    config, rules = simple
    first = [make_event(0, action="x"), make_event(100, action="y")]
    second = [make_event(300, action="error"), make_event(400, action="x")]
    stored = correlate(events_frame(spark, first), rules, config).alerts
    flow = Flow(spark, tmp_path, config, lambda: rules)
    flow.feed(events_frame(spark, second))
    flow.feed(end_mark(events_frame(spark, second)))
    flow.run(initial=resume_rows(stored))
    whole = correlate(events_frame(spark, first + second), rules, config).alerts
    same(flow.alerts(), whole.join(
        events_frame(spark, second).select("event_id"), "event_id", "left_semi"))


def test_invalid_and_repeated_events_can_be_dropped(spark, tmp_path, simple):
    config, rules = simple
    flow = Flow(spark, tmp_path, config, lambda: rules)
    wrong = list(make_event(5, action="x", event_id="wrong"))
    wrong[2] = "elsewhere"
    events = events_frame(spark, [make_event(0, action="x", event_id="a"), make_event(1, action="y", event_id="a"), tuple(wrong)])
    flow.feed(events)
    flow.detect(lambda e: without_repeats(valid_events(e, config)))
    assert [r.event_id for r in spark.read.parquet(flow.paths["hits"]).collect()] == ["a"]


def test_messages_are_pushed_to_a_sink(spark, tmp_path, simple):
    config, rules = simple
    flow = Flow(spark, tmp_path, config, lambda: rules)
    find_matches(events_frame(spark, [make_event(0, action="x")]), rules, config).write.parquet(flow.paths["hits"])
    stream = spark.readStream.schema(spark.read.parquet(flow.paths["hits"]).schema).parquet(flow.paths["hits"])
    write_messages(stream.select("alert_id", "entity_name"), flow.paths["out"], flow.paths["c3"]).awaitTermination()
    sent = json.loads(spark.read.json(flow.paths["out"]).first().value)
    assert sent["type"] == "alert" and sent["data"]["entity_name"] == "ana"
