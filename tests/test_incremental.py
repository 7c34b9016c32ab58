"""Deliveries folded one after another against one run over everything."""

import random

import pytest
from helpers import events_frame, make_event, make_rule
from pyspark.sql import functions as F

from embertrace.config import EngineConfig
from embertrace.operators.bucketed import BucketStore
from embertrace.plans.incremental import advance, store_stream
from embertrace.plans.pipeline import Correlated, correlate, find_matches
from embertrace.staging import stage
from embertrace.streaming.detect import event_stream

ALERT = ["alert_id", "entity_name", "entity_host", "entity_type", "chain_id", "chain_position", "is_new_link", "entity_risk_before",
         "entity_risk_after", "chain_risk_before", "chain_risk_after", "is_escalated", "opens_chain"]
CHAIN = ["chain_id", "entity_name", "started_at", "updated_at", "risk_score", "link_count", "alert_count", "is_escalated", "narrative"]
ENTITY = ["name", "host", "first_seen", "last_seen", "risk_score", "peak_risk", "total_alerts", "rules_fired", "active_chain_id",
          "total_chains", "techniques_seen"]


@pytest.fixture
def rules():
    return [make_rule(i, {"s": {"action": a}, "condition": "s"}, title=a) for i, a in enumerate(["x", "y", "z"])]


def rows_of(df, columns):
    return sorted(map(repr, df.select(columns).collect()))


def equals_batch(store, run):
    run = Correlated(run.matches, stage(run.alerts, "alerts"), run.config)
    assert rows_of(store.read("alerts"), ALERT) == rows_of(run.alerts, ALERT)
    assert rows_of(store.read("chains"), CHAIN) == rows_of(run.chains(), CHAIN)
    assert rows_of(store.read("entities"), ENTITY) == rows_of(run.entities(), ENTITY)


def random_events(seed: int, count: int, entities: int = 6):
    draw = random.Random(seed)
    day = 86_400
    return [make_event(draw.randrange(12) * day * draw.choice([1, 1, 0.01]) + draw.randrange(4000), entity=f"u{draw.randrange(entities)}",
                       action=draw.choice("xyz"), host=draw.choice([None, "A", "B"]), event_id=f"e{i}") for i in range(count)]


def test_deliveries_in_any_order_equal_one_run(spark, tmp_path, rules):
    config = EngineConfig()
    events = random_events(1, 150)
    store = BucketStore(spark, str(tmp_path / "store"), buckets=5)
    whole = events_frame(spark, events)
    for number, part in enumerate([events[:60], events[60:70], events[70:] + events[:5]]):
        assert advance(store, find_matches(events_frame(spark, part), rules, config), rules, config, number)
    equals_batch(store, correlate(whole, rules, config))


def test_a_repeated_batch_changes_nothing_and_other_buckets_are_left(spark, tmp_path, rules):
    config = EngineConfig()
    events = random_events(2, 60, entities=12)
    store = BucketStore(spark, str(tmp_path / "store"), buckets=16)
    first = find_matches(events_frame(spark, events[:50]), rules, config)
    assert advance(store, first, rules, config, 0)
    before = set(store.files("alerts"))
    assert not advance(store, first, rules, config, 0)
    assert set(store.files("alerts")) == before
    late = [e for e in events[50:] if e[3][0] == events[50][3][0]]
    assert advance(store, find_matches(events_frame(spark, late), rules, config), rules, config, 1)
    changed = set(store.files("alerts")) - before
    assert len(changed) == 1 and len(before - set(store.files("alerts"))) <= 1
    equals_batch(store, correlate(events_frame(spark, events[:50] + late), rules, config))


def test_a_batch_that_broke_off_is_invisible_and_can_be_repeated(spark, tmp_path, rules, monkeypatch):
    config = EngineConfig()
    events = random_events(3, 40)
    store = BucketStore(spark, str(tmp_path / "store"), buckets=4)
    assert advance(store, find_matches(events_frame(spark, events[:20]), rules, config), rules, config, 0)
    files = sorted(store.files("alerts"))
    second = find_matches(events_frame(spark, events[20:]), rules, config)

    # The files of the batch are there, its entry in the ledger is not.
    real = BucketStore.commit

    def commit_without_entry(self, batch, touched, replaced, appended):
        for table, rows in {**replaced, **appended}.items():
            self.with_bucket(rows.limit(1)).write.partitionBy("bucket").parquet(f"{self.path}/{table}/commit={batch}")
        raise RuntimeError("lost")

    monkeypatch.setattr(BucketStore, "commit", commit_without_entry)
    with pytest.raises(RuntimeError):
        advance(store, second, rules, config, 1)
    monkeypatch.setattr(BucketStore, "commit", real)
    assert sorted(store.files("alerts")) == files
    assert advance(store, second, rules, config, 1)
    equals_batch(store, correlate(events_frame(spark, events), rules, config))


def test_late_rows_of_a_stream_change_chains_that_stand(spark, tmp_path, rules):
    config = EngineConfig()
    store = BucketStore(spark, str(tmp_path / "store"), buckets=3)
    first = [make_event(0, action="x"), make_event(1500, action="y"), make_event(100, entity="bob", action="z")]
    late = [make_event(800, action="z"), make_event(-90_000_000, entity="bob", action="z")]
    for part in (first, late):
        events_frame(spark, part).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        store_stream(event_stream(spark, str(tmp_path / "in")), lambda: rules, config, store, str(tmp_path / "c")).awaitTermination()
    equals_batch(store, correlate(events_frame(spark, first + late), rules, config))
    # The late match ties two chains of ana into one: one grows, the other is taken back.
    feed = store.read("chain_changes").filter("entity_name = 'ana'")
    assert {(r.change, r["count"]) for r in feed.groupBy("change").count().collect()} == {("update", 3), ("retract", 1)}
    assert store.read("chains").filter("entity_name = 'ana'").select(F.max("link_count")).first()[0] == 3


def test_an_empty_delivery_is_recorded(spark, tmp_path, rules):
    store = BucketStore(spark, str(tmp_path / "store"), buckets=2)
    none = find_matches(events_frame(spark, [make_event(0, action="nothing")]), rules, EngineConfig())
    advance(store, none, rules, EngineConfig(), 0)
    assert store.read("alerts") is None
    assert advance(store, find_matches(events_frame(spark, [make_event(0, action="x")]), rules, EngineConfig()), rules, EngineConfig(), 1)
    assert store.read("alerts").count() == 1
