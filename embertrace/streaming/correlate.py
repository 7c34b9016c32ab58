"""Stateful correlation of a stream of matches, one state per entity."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from embertrace.config import EngineConfig
from embertrace.functions.scoring import CHAIN_BONUS, RISK_MAX

# What a match must carry to be correlated.
_FOLDED = ["t", "event_id", "rule_ordinal", "rule_id", "title_key", "risk_points", "alert_id"]
MATCH_COLUMNS = ["entity_name", "timestamp", *_FOLDED]

ALERT_SCHEMA = (
    "alert_id string, entity_name string, event_id string, rule_ordinal int, t long, chain_id string, "
    "chain_position int, is_new_link boolean, entity_risk_before int, entity_risk_after int, chain_risk_before int, "
    "chain_risk_after int, is_escalated boolean"
)
_BUFFER_SCHEMA = (
    "t long, event_id string, rule_ordinal int, rule_id string, title_key long, risk_points int, alert_id string"
)
_ENTITY_SCHEMA = "risk int, head string, updated long, titles string, chain_risk int, escalated boolean, seen long"


@dataclass
class EntityState:
    """Running state of one entity; mirrors the batch definitions."""

    risk: int = 0
    head: str | None = None
    updated: int = 0
    titles: tuple[int, ...] = ()
    chain_risk: int = 0
    escalated: bool = False
    seen: int | None = None

    def meet(self, t: int, config: EngineConfig) -> None:
        """Decay up to a match, whether it becomes an alert or not."""
        interval = config.decay_interval_hours * 3_600_000_000
        if self.seen is not None and interval > 0:
            first = -(-(self.seen + interval) // interval)
            for _ in range(min(RISK_MAX, (t - 1) // interval - first + 1)):
                self.risk = max(0, self.risk - max(1, int(self.risk * config.decay_rate)))
        self.seen = t

    def raise_alert(self, t: int, title: int, points: int, alert_id: str, config: EngineConfig) -> dict:
        """Take in an alert that passed the cooldown and describe it."""
        if self.head is None or t - self.updated > config.chain_window_us:
            self.head, self.titles, self.chain_risk, self.escalated = alert_id, (), 0, False
        is_new = title not in self.titles
        if is_new:
            self.titles, self.updated = (*self.titles, title), t
            self.escalated = self.escalated or self.chain_risk >= config.risk_critical
        points += CHAIN_BONUS if len(self.titles) >= config.chain_min_rules else 0
        before, chain_before = self.risk, self.chain_risk
        self.risk, self.chain_risk = min(RISK_MAX, before + points), min(RISK_MAX, chain_before + points)
        return {
            "chain_position": len(self.titles), "is_new_link": is_new, "entity_risk_before": before,
            "entity_risk_after": self.risk, "chain_risk_before": chain_before, "chain_risk_after": self.chain_risk,
            "is_escalated": self.escalated,
        }


class Correlator(StatefulProcessor):
    """Holds matches until the watermark passes them, then folds them in time order.

    Waiting for the watermark makes the result independent of arrival order and
    equal to the batch result. Cooldown marks are dropped once they no longer
    matter. State is keyed by rule id and title hash, which a reload of the
    rules does not change.
    """

    def __init__(self, config: EngineConfig) -> None:
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entity = handle.getValueState("entity", _ENTITY_SCHEMA)
        self.last_fired = handle.getMapState("last_fired", "rule_id string", "t long")
        self.waiting = handle.getListState("waiting", _BUFFER_SCHEMA)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Resume from a stored state row."""
        row = initialState.iloc[0]
        self.entity.update((
            int(row["risk"]), row["head"], int(row["updated"]), row["titles"], int(row["chain_risk"]),
            bool(row["escalated"]), int(row["seen"]),
        ))
        for rule, mark in json.loads(row["fired"]).items():
            self.last_fired.updateValue((rule,), (mark,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = [tuple(item) for batch in rows for item in batch[_FOLDED].itertuples(index=False, name=None)]
        if arrived:
            self.waiting.appendList(arrived)
            # One timer for the newest row releases everything up to it.
            self.handle.registerTimer(max(item[0] for item in arrived) // 1000 + 1)
        yield self._release(key[0], timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._release(key[0], timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass

    def _release(self, name: str, before: int) -> pd.DataFrame:
        waiting = sorted(self.waiting.get())
        ready = [item for item in waiting if item[0] < before]
        alerts: list[dict] = []
        if ready:
            self.waiting.put(waiting[len(ready):]) if len(ready) < len(waiting) else self.waiting.clear()
            alerts = self._fold(name, ready)
        return pd.DataFrame(alerts, columns=[part.split()[0] for part in ALERT_SCHEMA.split(", ")])

    def _fold(self, name: str, ready: list[tuple]) -> list[dict]:
        state = EntityState()
        if self.entity.exists():
            risk, head, updated, titles, chain_risk, escalated, seen = self.entity.get()
            state = EntityState(risk, head, updated, tuple(json.loads(titles)), chain_risk, escalated, seen)
        fired = {rule[0]: mark[0] for rule, mark in self.last_fired.iterator()}
        alerts = []
        for t, event_id, ordinal, rule, title, points, alert_id in ready:
            state.meet(t, self.config)
            if rule in fired and t - fired[rule] < self.config.cooldown_us:
                continue
            fired[rule] = t
            facts = state.raise_alert(t, title, points, alert_id, self.config)
            chain = hashlib.sha256(f"{name}|{state.head}".encode()).hexdigest()
            alerts.append({"alert_id": alert_id, "entity_name": name, "event_id": event_id, "rule_ordinal": ordinal,
                           "t": t, "chain_id": chain, **facts})
        newest = ready[-1][0]
        for rule, mark in fired.items():
            if newest - mark < self.config.cooldown_us:
                self.last_fired.updateValue((rule,), (mark,))
            elif self.last_fired.containsKey((rule,)):
                self.last_fired.removeKey((rule,))
        self.entity.update((state.risk, state.head, state.updated, json.dumps(state.titles), state.chain_risk,
                            state.escalated, state.seen))
        return alerts


def correlate_stream(
    matches: DataFrame, config: EngineConfig, late: str = "10 minutes", initial: DataFrame | None = None
) -> DataFrame:
    """Streaming matches to streaming alerts, in event time.

    Needs the RocksDB state store provider. Matches more than ``late`` behind
    the newest one are dropped and counted in the query's progress.
    """
    grouped = matches.select(*MATCH_COLUMNS).withWatermark("timestamp", late).groupBy("entity_name")
    return grouped.transformWithStateInPandas(
        statefulProcessor=Correlator(config), outputStructType=ALERT_SCHEMA, outputMode="Append",
        timeMode="EventTime", initialState=initial.groupBy("entity_name") if initial is not None else None,
    )


def resume_rows(alerts: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Initial stream state from stored alerts: risk, the newest chain and each
    rule's last alert of each entity.

    ``seen`` (entity_name, seen) tells the time of an entity's last match in microseconds, from which scores decay; by
    default that of its last alert.
    """
    order = F.struct("t", "event_id", "rule_ordinal")
    marks = alerts.groupBy("entity_name", "rule_id").agg(F.max("t").alias("_mark"))
    # At most one mark per rule.
    fired = marks.groupBy("entity_name").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("rule_id", "_mark")))).alias("fired")
    )
    newest = F.struct("chain_id", "entity_risk_after")
    last = alerts.groupBy("entity_name").agg(F.max_by(newest, order).alias("_last"))
    links = alerts.join(
        last.select("entity_name", F.col("_last.chain_id").alias("chain_id"),
                    F.col("_last.entity_risk_after").alias("risk")),
        ["entity_name", "chain_id"],
    )
    new = F.col("is_new_link")
    return links.groupBy("entity_name").agg(
        F.first("risk").alias("risk"),
        F.min_by("alert_id", order).alias("head"),
        F.max(F.when(new, F.col("t"))).alias("updated"),
        F.to_json(F.collect_set(F.when(new, F.col("title_key")))).alias("titles"),
        F.max("chain_risk_after").alias("chain_risk"),
        F.max("is_escalated").alias("escalated"),
    ).join(fired, "entity_name").join(
        seen if seen is not None else alerts.groupBy("entity_name").agg(F.max("t").alias("seen")), "entity_name"
    )
