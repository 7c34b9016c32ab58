"""Pipeline runs that the registered queries start from."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from embertrace.operators.bucketed import BucketStore
from embertrace.plans.binding import TEST_CONFIG, bound_events, bundled_rules
from embertrace.plans.incremental import advance
from embertrace.plans.pipeline import Correlated, correlate, find_matches
from embertrace.sources.rules import rule_attributes
from embertrace.staging import stage, staging_root

CONFIG = TEST_CONFIG


def fresh_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_matches(bound_events(spark, sf_dir), bundled_rules(spark), CONFIG)


def fresh_run(spark: SparkSession, sf_dir: str) -> Correlated:
    """Detection and correlation from the raw events, nothing reused."""
    return correlate(bound_events(spark, sf_dir), bundled_rules(spark), CONFIG)


class Store:
    """The stored tables of one run, as an analyst finds them; each is written when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._spark, self._sf_dir = spark, sf_dir

    @cached_property
    def _run(self) -> Correlated:
        return fresh_run(self._spark, self._sf_dir)

    @property
    def matches(self) -> DataFrame:
        return self._run.matches

    @cached_property
    def context(self) -> DataFrame:
        return stage(self._run.alerts, "alerts")

    @property
    def _stored(self) -> Correlated:
        return Correlated(self.matches, self.context, CONFIG)

    @cached_property
    def alerts(self) -> DataFrame:
        return stage(self._stored.alert_rows(), "alert-rows")

    @cached_property
    def chains(self) -> DataFrame:
        return stage(self._stored.chains(), "chains")

    @cached_property
    def entities(self) -> DataFrame:
        return stage(self._stored.entities(), "entities")

    @cached_property
    def rules(self) -> DataFrame:
        return rule_attributes(self._spark, bundled_rules(self._spark)).withColumn("enabled", F.lit(True))

    def write_all(self) -> "Store":
        for _ in (self.alerts, self.chains, self.entities):
            pass
        return self


_stores: dict[tuple[str, str], Store] = {}


def store(spark: SparkSession, sf_dir: str) -> Store:
    """The stored tables of a session; a query writes those it reads, unless an earlier one did.

    List, lookup and statistics queries answer from tables that an earlier run
    wrote; queries that show a pipeline step run it afresh.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        _stores[key] = Store(spark, sf_dir)
    return _stores[key]


def deliveries(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The bound events in three deliveries: the first half of the time, the second half, and a third of both, late."""
    events = bound_events(spark, sf_dir)
    late = F.pmod(F.col("event_id").cast("bigint"), F.lit(3)) == 0
    early = F.col("timestamp") < F.lit("2024-01-16").cast("timestamp")
    return [events.filter(~late & early), events.filter(~late & ~early), events.filter(late)]


_delivered: dict[tuple[str, str], BucketStore] = {}


def delivered(spark: SparkSession, sf_dir: str) -> BucketStore:
    """The store after all deliveries, of which one came twice; built on first use in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _delivered:
        made = BucketStore(spark, f"{staging_root(spark)}/embertrace-deliveries/{uuid.uuid4().hex}", buckets=16)
        rules = bundled_rules(spark)
        parts = [find_matches(part, rules, CONFIG) for part in deliveries(spark, sf_dir)]
        for number, part in [(0, parts[0]), (1, parts[1]), (1, parts[1]), (2, parts[2])]:
            advance(made, part, rules, CONFIG, number)
        _delivered[key] = made
    return _delivered[key]
