"""Correlation of deliveries one after another, late ones included.

A delivery of matches is folded into stored tables. For each entity it touches, history is cut at the last quiet stretch
before its first new match: no cooldown and no chain reaches across it, and of the score only its last value and the
time of the last match are needed. What lies before is kept, what lies after is folded again together with the new
matches, and the rows of chains and alerts from there on are replaced. So the tables after any sequence of deliveries, in
any order, equal those of one run over everything, and a delivery reads the matches of the buckets it touches, no events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from embertrace.config import EngineConfig
from embertrace.functions.common import bucket_of
from embertrace.operators import chain_table, entities
from embertrace.operators.bucketed import BucketStore
from embertrace.operators.chains import ORDER
from embertrace.operators.cooldown import one_per_alert
from embertrace.plans.pipeline import find_matches, raise_alerts
from embertrace.sources.rules import Rule
from embertrace.staging import stage

_CHAIN_FACTS = ["link_count", "alert_count", "risk_score", "updated_at", "is_escalated"]


def restart_points(matches: DataFrame, touched: DataFrame, config: EngineConfig) -> DataFrame:
    """(entity_name, restart): where to fold again, for each of ``touched`` (entity_name, first_new).

    The start of the stretch without a quiet gap that holds the first new match; found from counts per bucket as wide as
    the gap, like islands are.
    """
    gap = max(config.cooldown_us, config.chain_window_us, 1)
    spans = matches.groupBy("entity_name", bucket_of("t", gap).alias("_bucket")).agg(
        F.min("t").alias("_first"), F.max("t").alias("_last"))
    before = F.lag("_last").over(Window.partitionBy("entity_name").orderBy("_bucket"))
    heads = spans.withColumn("_head", F.coalesce(F.col("_first") - before > gap, F.lit(True))).filter("_head")
    met = heads.join(touched, "entity_name").filter(F.col("_first") <= F.col("first_new"))
    return met.groupBy("entity_name").agg(F.max("_first").alias("restart"))


def _seeds(kept_alerts: DataFrame | None, matches: DataFrame, restarts: DataFrame) -> DataFrame:
    """(entity_name, risk_score, seen) of the history that is kept."""
    seen = matches.join(restarts, "entity_name").filter("t < restart").groupBy("entity_name").agg(F.max("t").alias("seen"))
    if kept_alerts is None:
        return seen.withColumn("risk_score", F.lit(0))
    last = kept_alerts.join(restarts, "entity_name").filter("t < restart").groupBy("entity_name").agg(
        F.max_by("entity_risk_after", F.struct(*ORDER)).alias("risk_score"))
    return seen.join(last, "entity_name", "left").withColumn("risk_score", F.coalesce("risk_score", F.lit(0)))


def _rest(stored: DataFrame | None, restarts: DataFrame, time: str) -> DataFrame | None:
    """Stored rows that stay: of other entities, or before the restart."""
    if stored is None:
        return None
    joined = stored.join(restarts, "entity_name", "left")
    return joined.filter(F.col("restart").isNull() | (F.col(time) < F.col("restart"))).drop("restart", "bucket")


def _with(rest: DataFrame | None, new: DataFrame) -> DataFrame:
    return new if rest is None else rest.unionByName(new)


def _changes(stored: DataFrame | None, rest: DataFrame | None, new: DataFrame) -> DataFrame:
    """Chains that a delivery wrote anew or took back."""
    facts = ["entity_name", "chain_id", *_CHAIN_FACTS]
    now = new.select(*facts).withColumn("change", F.lit("update"))
    if stored is None:
        return now
    gone = stored.select(*facts).join(rest.select("chain_id"), "chain_id", "left_anti")
    fresh = now.join(gone.select("chain_id", *_CHAIN_FACTS), ["chain_id", *_CHAIN_FACTS], "left_anti")
    back = gone.join(new.select("chain_id"), "chain_id", "left_anti").withColumn("change", F.lit("retract"))
    return fresh.select(*facts, "change").unionByName(back.select(*facts, "change"))


def advance(store: BucketStore, new_matches: DataFrame, rules: list[Rule], config: EngineConfig, batch: int) -> bool:
    """Fold a delivery of matches into the store; False if its number was folded before."""
    if store.committed(batch):
        return False
    new = stage(store.with_bucket(one_per_alert(new_matches)), "delivery")
    touched = new.groupBy("entity_name").agg(F.min("t").alias("first_new"), F.first("bucket").alias("bucket"))
    touched = stage(touched, "touched")
    # At most one number per bucket.
    buckets = [r.bucket for r in touched.select("bucket").distinct().collect()]
    snapshot = store.snapshot(buckets)
    stored = {name: store.read(name, snapshot) for name in ("matches", "alerts", "chains", "entities")}
    names = new.columns
    everything = new if stored["matches"] is None else stored["matches"].select(*names).unionByName(new)
    mine = everything.join(touched.select("entity_name"), "entity_name", "left_semi").select(*names).drop("bucket")
    history = stage(one_per_alert(mine), "history")
    restarts = stage(restart_points(history, touched.select("entity_name", "first_new"), config), "restarts")
    again = stage(history.join(restarts, "entity_name").filter("t >= restart").drop("restart").select(*history.columns), "again")
    known = entities.first_known(history)
    seeds = stage(_seeds(stored["alerts"], history, restarts), "seeds")
    alerts = stage(raise_alerts(again, rules, config, seeds, known), "alerts-again")
    all_alerts = _with(_rest(stored["alerts"], restarts, "t"), alerts)
    chains = stage(chain_table.chain_rollup(alerts, config), "chains-again")
    started = F.timestamp_micros("restart")
    kept_chains = _rest(stored["chains"], restarts.withColumn("restart", started), "started_at")
    theirs = all_alerts.select(*entities.PROFILE_COLUMNS).join(touched.select("entity_name"), "entity_name", "left_semi")
    profiles = entities.entity_profiles(stage(theirs, "alerts-of-touched"), known, config).withColumn("entity_name", F.col("name"))
    kept_profiles = stored["entities"]
    if kept_profiles is not None:
        kept_profiles = kept_profiles.join(touched.select("entity_name"), "entity_name", "left_anti").drop("bucket")
    return store.commit(
        batch, buckets,
        replaced={"alerts": all_alerts, "chains": _with(kept_chains, chains), "entities": _with(kept_profiles, profiles)},
        appended={"matches": new.drop("bucket"), "chain_changes": _changes(stored["chains"], kept_chains, chains)},
    )


def store_stream(
    events: DataFrame, load: Callable[[], list[Rule]], config: EngineConfig, store: BucketStore, checkpoint: str, **trigger
) -> StreamingQuery:
    """Detect and correlate a stream of events into the store, one delivery per micro-batch.

    Rules are read anew per batch. No row is late: a batch replaces what its matches change. A batch that runs again
    after a failure is skipped or written as a whole.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        rules = load()
        advance(store, find_matches(batch, rules, config), rules, config, batch_id)

    return (
        events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
