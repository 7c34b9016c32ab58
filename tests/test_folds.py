"""Folds against brute force: island arrays, sliced islands and streamed islands."""

import random

import pytest
from helpers import greedy_cooldown, walk_chains
from pyspark.sql import functions as F

from embertrace.config import EngineConfig
from embertrace.operators import chains, cooldown
from embertrace.operators.risk import add_entity_risk
from embertrace.streaming.detect import first_of_instant

SECOND = 1_000_000


def matches_frame(spark, rows):
    """rows: (entity, rule, time in seconds)"""
    data = [
        (entity, rule, int(s * SECOND), f"e{i:06d}", rule, 10, f"a{i:06d}", {"n": str(i)})
        for i, (entity, rule, s) in enumerate(rows)
    ]
    return spark.createDataFrame(
        data, "entity_name string, rule_ordinal int, t long, event_id string, title_key long, risk_points int, "
              "alert_id string, raw_payload map<string,string>"
    ).withColumn("timestamp", F.timestamp_micros("t"))


def busy_rows(seed, count=600, span=900, hot=0.6):
    """One entity has most of the rows, with no quiet gap; times repeat."""
    draw = random.Random(seed)
    rows = []
    for _ in range(count):
        entity = "hot" if draw.random() < hot else f"u{draw.randrange(6)}"
        rows.append((entity, draw.randrange(2), draw.randrange(span * 4) / 4 - 300))
    return rows


def expected_fired(rows, gap):
    keys = {}
    for i, (entity, rule, s) in enumerate(rows):
        keys.setdefault((entity, rule), []).append((int(s * SECOND), i))
    out = set()
    for (entity, rule), marks in keys.items():
        first = {}
        for t, i in sorted(marks):
            first.setdefault(t, i)
        for t in greedy_cooldown([t for t, _ in marks], gap * SECOND):
            out.add(f"a{first[t]:06d}")
    return out


@pytest.mark.parametrize("seed, fold_limit, slice_rows", [
    (1, 10_000, 1_000), (2, 5, 7), (3, 1, 1), (4, 20, 50), (5, 3, 12),
])
def test_cooldown_equals_brute_force(spark, seed, fold_limit, slice_rows):
    rows = busy_rows(seed)
    config = EngineConfig(cooldown_seconds=30, fold_limit=fold_limit, slice_rows=slice_rows)
    fired = cooldown.apply_cooldown(matches_frame(spark, rows), config).collect()
    assert sorted(r.alert_id for r in fired) == sorted(expected_fired(rows, 30))
    assert all(r.raw_payload == {"n": str(int(r.alert_id[1:]))} for r in fired)


def test_regular_matches_never_merge_orbits(spark):
    """Evenly spaced matches: every entry point of a slice leads elsewhere."""
    rows = [("hot", 0, s * 7) for s in range(400)]
    config = EngineConfig(cooldown_seconds=60, fold_limit=4, slice_rows=20)
    fired = cooldown.apply_cooldown(matches_frame(spark, rows), config).collect()
    assert {r.alert_id for r in fired} == expected_fired(rows, 60)


def test_no_cooldown_keeps_everything(spark):
    rows = busy_rows(9, count=50)
    assert cooldown.apply_cooldown(matches_frame(spark, rows), EngineConfig(cooldown_seconds=0)).count() == 50


def test_thinning_an_instant_does_not_change_what_fires(spark):
    rows = busy_rows(6)
    config = EngineConfig(cooldown_seconds=30)
    thin = cooldown.apply_cooldown(first_of_instant(matches_frame(spark, rows)), config)
    assert {r.alert_id for r in thin.collect()} == expected_fired(rows, 30)


@pytest.mark.parametrize("seed, fold_limit", [(1, 10_000), (2, 5), (3, 1)])
def test_chains_equal_brute_force(spark, seed, fold_limit):
    draw = random.Random(seed)
    rows = [("hot" if draw.random() < 0.6 else f"u{draw.randrange(5)}", draw.randrange(6), draw.randrange(20_000) / 2)
            for _ in range(400)]
    config = EngineConfig(chain_window_seconds=45, fold_limit=fold_limit)
    got = {}
    for r in chains.assign_chains(matches_frame(spark, rows), config).orderBy("t", "event_id").collect():
        got.setdefault(r.entity_name, []).append((r.chain_id, r.chain_position, r.is_new_link))
    for entity in {e for e, _, _ in rows}:
        mine = sorted((int(s * SECOND), f"e{i:06d}", rule) for i, (e, rule, s) in enumerate(rows) if e == entity)
        want = walk_chains([(t, title) for t, _, title in mine], 45 * SECOND)
        numbers = {}
        seen = [(numbers.setdefault(c, len(numbers) + 1), p, n) for c, p, n in got[entity]]
        assert seen == want


def test_entity_risk_equals_a_running_clamp(spark):
    rows = busy_rows(4, count=200, span=20_000)
    config = EngineConfig(chain_window_seconds=30, decay_interval_hours=0)
    scored = chains.add_chain_risk(chains.assign_chains(matches_frame(spark, rows), config), config)
    got = add_entity_risk(scored, scored, config).orderBy("entity_name", "t", "event_id").collect()
    score, entity = 0, None
    for r in got:
        if r.entity_name != entity:
            entity, score = r.entity_name, 0
        assert r.entity_risk_before == score
        score = min(100, score + r.risk_delta)
        assert r.entity_risk_after == score


def test_risk_with_decay_equals_a_step_by_step_fold(spark):
    draw = random.Random(3)
    day = 86_400
    rows = [(f"u{draw.randrange(3)}", 0, draw.randrange(200) * day / 2 + draw.randrange(1000)) for _ in range(60)]
    config = EngineConfig(cooldown_seconds=day, chain_window_seconds=900)
    matches = matches_frame(spark, rows)
    alerts = cooldown.apply_cooldown(matches, config).withColumn("risk_delta", F.lit(30))
    got = {r.alert_id: (r.entity_risk_before, r.entity_risk_after)
           for r in add_entity_risk(alerts, matches, config).collect()}
    fired = expected_fired(rows, day)
    assert set(got) == fired
    for entity in {e for e, _, _ in rows}:
        score, last = 0, None
        for t, i in sorted((int(s), i) for i, (e, _, s) in enumerate(rows) if e == entity):
            tick = None if last is None else -(-(last + day) // day) * day
            while tick is not None and tick < t:
                score = max(0, score - max(1, int(score * 0.05))) if score else 0
                tick += day
            last = t
            if f"a{i:06d}" in fired:
                before = score
                score = min(100, score + 30)
                assert got[f"a{i:06d}"] == (before, score)
