"""Physical plans keep the properties that matter at size."""

import re

from helpers import make_rule
from pyspark.sql import functions as F

from embertrace.operators import entities, lookup
from embertrace.operators.detect import compile_rules, match_events
from embertrace.plans.binding import TEST_CONFIG, bound_events, bundled_rules
from embertrace.plans.pipeline import find_matches
from embertrace.plans.runs import store


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_detection_neither_shuffles_nor_broadcasts_events(spark, sf_dir):
    plan = plan_of(find_matches(bound_events(spark, sf_dir), bundled_rules(spark), TEST_CONFIG))
    assert "Exchange hashpartitioning" not in plan
    assert "BuildRight" in plan and "LocalTableScan" in plan
    assert "Python" not in plan and "ArrowEval" not in plan


def test_detection_reads_only_the_columns_the_rules_need(spark, sf_dir):
    rules = [make_rule(0, {"s": {"action": "click"}, "condition": "s"})]
    found = match_events(bound_events(spark, sf_dir), compile_rules(spark, rules, TEST_CONFIG), TEST_CONFIG)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan_of(found.select("event_id", "rule_ordinal"))).group(1)
    assert {part.split(":")[0] for part in schema.split(",")} == {"event_id", "event_type"}


def test_top_k_lists_do_not_sort_everything(spark, sf_dir):
    tables = store(spark, sf_dir)
    assert "TakeOrderedAndProject" in plan_of(lookup.get_alerts(tables.alerts))
    assert "WindowGroupLimit" in plan_of(entities.timeline(tables.context, TEST_CONFIG))


def test_filters_reach_the_stored_table(spark, sf_dir):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = plan_of(lookup.get_alerts(store(spark, sf_dir).alerts, entity_name="user_7", min_severity=5))
    assert "EqualTo(entity_name,user_7)" in plan and "GreaterThanOrEqual(severity,5)" in plan


def test_counting_by_rule_combines_before_the_shuffle(spark, sf_dir):
    plan = plan_of(store(spark, sf_dir).alerts.groupBy("rule_title").agg(F.count("*")))
    assert plan.index("Exchange hashpartitioning") < plan.rindex("partial_count")
