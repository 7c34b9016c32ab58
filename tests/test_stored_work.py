"""Queries write the tables and columns they need, and no others."""

import pytest

from embertrace.operators import entities
from embertrace.plans import correlation_queries, incremental, pipeline, runs
from embertrace.plans.catalog import QUERIES
from embertrace.staging import stage


@pytest.fixture
def staged(monkeypatch):
    """Columns of every table staged by plans, by name."""
    seen = {}

    def record(df, name):
        seen[name] = df.columns
        return stage(df, name)

    for module in (runs, pipeline, incremental, correlation_queries):
        monkeypatch.setattr(module, "stage", record)
    monkeypatch.setattr(runs, "_stores", {})
    monkeypatch.setattr(runs, "_delivered", {})
    return seen


@pytest.mark.parametrize("name, written", [
    ("alert_count_by_rule", set()), ("timeline_recent", set()), ("write_alerts_twice", set()), ("archive_twice", set()),
    ("risk_decay", {"entities"}), ("warm_start_state", {"entities", "chains"}), ("correlation_stats", {"entities", "chains"}),
])
def test_a_query_writes_the_tables_it_reads(spark, sf_dir, staged, name, written):
    QUERIES[name](spark, sf_dir)
    assert {"alert-rows", "entities", "chains"} & set(staged) == written and "alerts" in staged


def test_running_risk_leaves_texts_aside(spark, sf_dir, staged):
    QUERIES["entity_risk_running"](spark, sf_dir)
    assert not {"raw_payload", "host", "domain"} & set(staged["matches"] + staged["chained"])


def test_profiles_of_a_delivery_read_slim_alerts(spark, sf_dir, staged):
    QUERIES["late_entities"](spark, sf_dir)
    assert staged["alerts-of-touched"] == entities.PROFILE_COLUMNS
