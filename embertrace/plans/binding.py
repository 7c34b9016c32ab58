"""Bind the provided ``events`` table to the event envelope."""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from embertrace.config import EngineConfig
from embertrace.sources.rules import Rule, collect_rules, load_rules

# Users of the provided table act hours apart, so the windows are wider here.
TEST_CONFIG = EngineConfig(cooldown_seconds=12 * 3600, chain_window_seconds=24 * 3600, chain_min_rules=2)
RULES_FOLDER = str(Path(__file__).parent / "rules")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table in envelope form."""
    raw = read_table(spark, sf_dir, "events")
    payload = F.from_json("props", "map<string,string>")
    none = F.lit(None).cast("string")
    return raw.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.lit("hostlog").alias("source"),
        F.struct(
            F.concat(F.lit("user_"), F.col("user_id")).alias("name"),
            F.lit("user").alias("type"),
            F.concat(F.lit("WKSTN-"), F.lpad((payload["k"].cast("int") % 20).cast("string"), 2, "0")).alias("host"),
            none.alias("domain"),
        ).alias("entity"),
        F.struct(
            F.lit("other").alias("type"), F.col("event_type").alias("action"),
            F.least(F.lit(10), F.floor(F.col("value") / 25).cast("int")).alias("severity"),
            F.lit("unknown").alias("outcome"),
        ).alias("event"),
        F.struct(
            none.alias("technique_id"), none.alias("technique_name"), none.alias("tactic"), none.alias("tactic_id"),
            F.lit("Unknown").alias("chain_stage"),
        ).alias("mitre"),
        payload.alias("raw_payload"),
    )


@lru_cache(maxsize=8)
def _bundled(application: str, config: EngineConfig) -> tuple[Rule, ...]:
    spark = SparkSession.getActiveSession()
    return tuple(collect_rules(load_rules(spark, RULES_FOLDER, config)))


def bundled_rules(spark: SparkSession, config: EngineConfig = TEST_CONFIG) -> list[Rule]:
    """The bundled rule files, parsed once per session."""
    return list(_bundled(spark.sparkContext.applicationId, config))
