"""Stored tables: keyed upserts, tables by day, archive split, messages and warm start."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from embertrace.config import EngineConfig
from embertrace.staging import stage


def append_alerts(stored: DataFrame, new: DataFrame, key: str = "alert_id") -> DataFrame:
    """Insert-or-replace by ``key``; the new row wins.

    Ids are derived from event and rule, so writing a batch twice changes
    nothing.
    """
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new.dropDuplicates([key]))


def upsert(stored: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Latest version per key (A8-A11): stored rows and changes, newest wins.

    An aggregation rather than a window: versions combine before the shuffle,
    so a key with very many changes never gathers in one task.
    """
    both = stored.unionByName(changes)
    rest = [name for name in both.columns if name not in keys]
    newest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_row"))
    return newest.select(*keys, "_row.*").select(*both.columns)


def stored_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, or None if there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        # Absent, or a folder without files.
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def merge_days(rows: DataFrame, path: str, time: str, key: str) -> None:
    """Insert-or-replace ``rows`` by ``key`` in the table at ``path``, partitioned by the day of ``time``.

    Only the days of ``rows`` are read and written anew, so a write that is repeated changes nothing, and one that broke
    off is mended by repeating it. A key must keep its day. Rows without a time have a partition of their own.
    """
    spark = rows.sparkSession
    new = stage(rows.withColumn("date", F.to_date(time)), "new-days")
    stored = stored_table(spark, path)
    if stored is None:
        merged = new.dropDuplicates([key])
    else:
        days = new.select(F.col("date").alias("_day")).distinct()
        touched = stored.join(days, F.col("date").eqNullSafe(F.col("_day")), "left_semi")
        # Written aside first: the days are replaced while the table is read.
        merged = stage(append_alerts(touched, new, key), "merged-days")
    writer = merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("date").parquet(path)


def write_alerts(alerts: DataFrame, path: str) -> None:
    """Write alerts to a table partitioned by day, so time filters prune; a second time changes nothing."""
    merge_days(alerts, path, "timestamp", "alert_id")


def is_expired(time: Column, as_of: Column, config: EngineConfig) -> Column:
    return time < as_of - F.make_dt_interval(days=F.lit(config.retention_days))


def archive_split(table: DataFrame, time: str, as_of: Column, config: EngineConfig) -> tuple[DataFrame, DataFrame]:
    """(expired, kept) parts of a table by age."""
    old = F.coalesce(is_expired(F.col(time), as_of, config), F.lit(False))
    return table.filter(old), table.filter(~old)


def archive(
    table: DataFrame, time: str, as_of: Column, config: EngineConfig, path: str, key: str = "alert_id",
) -> DataFrame:
    """Write expired rows to ``path`` by day, once per ``key``, and return the rows that stay hot."""
    expired, kept = archive_split(table, time, as_of, config)
    merge_days(expired, path, time, key)
    return kept


def messages(rows: DataFrame, kind: str, key: str) -> DataFrame:
    """(key, value) JSON messages ``{"type": kind, "data": {...}}`` for a sink."""
    body = F.struct(F.lit(kind).alias("type"), F.struct(*rows.columns).alias("data"))
    return rows.select(F.col(key).alias("key"), F.to_json(body).alias("value"))


def active_chains(chains: DataFrame) -> DataFrame:
    """Newest chain per entity: what an entity resumes with."""
    newest = F.struct("updated_at", "started_at", "chain_id")
    return chains.groupBy("entity_name").agg(
        F.max_by("chain_id", newest).alias("active_chain_id"),
        F.max("updated_at").alias("chain_updated_at"),
        F.max_by(F.transform("links", lambda link: link["rule_title"]), newest).alias("chain_rules"),
    )


def warm_start(entities: DataFrame, chains: DataFrame) -> DataFrame:
    """State to resume from: every stored entity with its newest chain. No cap."""
    state = entities.select("name", "risk_score", "peak_risk", "last_seen").withColumnRenamed("name", "entity_name")
    return state.join(active_chains(chains), "entity_name", "left")


def per_key_newest(rows: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """First ``limit`` rows of every key; Spark cuts each task's share before the shuffle."""
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", position).filter(F.col("_n") <= limit).drop("_n")
