"""Continuous detection with hot-reloaded rules, and the sinks of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from embertrace.config import EngineConfig
from embertrace.operators.store import messages, stored_table
from embertrace.plans.pipeline import find_matches
from embertrace.schemas import EVENT_SCHEMA
from embertrace.sources.normalise import validate_events
from embertrace.sources.rules import Rule


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Envelope events from a folder of JSON-lines files.

    The pace is set by the trigger and ``files_per_batch``; a backfill uses
    ``Trigger.AvailableNow``.
    """
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)


def valid_events(events: DataFrame, config: EngineConfig) -> DataFrame:
    return validate_events(events, config).filter(F.col("problem").isNull()).drop("problem")


def without_repeats(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Optional: drop a second delivery of an event id within the watermark."""
    return events.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["event_id"])


def first_of_instant(matches: DataFrame) -> DataFrame:
    """One match per entity, rule and instant: with a cooldown only the first of
    them can fire. Combines before the shuffle, so a busy entity is thinned
    before it reaches its state."""
    keys = ["entity_name", "rule_ordinal", "t"]
    rest = [name for name in matches.columns if name not in keys]
    first = matches.groupBy(*keys).agg(F.min_by(F.struct(*rest), "event_id").alias("_row"))
    return first.select(*keys, "_row.*").select(*matches.columns)


def detect_stream(
    events: DataFrame, load: Callable[[], list[Rule]], config: EngineConfig, path: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Write the matches of a stream to a table, reading the rules anew per batch.

    A plan with state cannot change its predicates while it runs, so detection
    is a query of its own and correlation reads the table it writes. A batch
    that was written before is skipped: its files may have been read already.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if stored_table(batch.sparkSession, f"{path}/batch_id={batch_id}") is not None:
            return
        found = find_matches(batch, load(), config)
        if config.cooldown_us > 0:
            found = first_of_instant(found)
        found.write.parquet(f"{path}/batch_id={batch_id}")

    return (
        events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def write_messages(alerts: DataFrame, path: str, checkpoint: str, kind: str = "alert", key: str = "alert_id",
                   **trigger) -> StreamingQuery:
    """Push rows of a stream as JSON messages to a file sink."""
    return (
        messages(alerts, kind, key).writeStream.format("json").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def append_alert_batches(alerts: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write streamed alerts to a table; a batch that was written before is skipped."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if stored_table(batch.sparkSession, f"{path}/batch_id={batch_id}") is None:
            batch.write.parquet(f"{path}/batch_id={batch_id}")

    return (
        alerts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
