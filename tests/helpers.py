"""Small builders shared by the tests."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from embertrace.schemas import EVENT_SCHEMA
from embertrace.sources.rules import Rule

START = datetime(2026, 5, 13, 10, 0, 0, tzinfo=timezone.utc)


def make_rule(ordinal: int, detection: dict, level: str = "high", title: str | None = None, tags=(None, None)) -> Rule:
    points = {"informational": 2, "low": 5, "medium": 10, "high": 20, "critical": 35}[level]
    name = title or f"Rule {ordinal}"
    return Rule(ordinal, f"id-{ordinal}", name, level, detection.get("condition", ""), detection, f"{name}.yml",
                tags[0], tags[1], tags[1] or "Unknown", 7, points, name)


def make_event(seconds: float, entity: str = "ana", kind: str = "user", host: str | None = "PC-1", action: str = "x",
               technique: str | None = None, event_id: str | None = None, payload: dict | None = None,
               severity: int = 0, domain: str | None = None):
    at = START + timedelta(seconds=seconds)
    return (event_id or f"{entity}-{seconds}", at, "replay", (entity, kind, host, domain),
            ("other", action, severity, None), (technique, None, None, None, "Unknown"), payload or {})


def events_frame(spark, events):
    return spark.createDataFrame(events, EVENT_SCHEMA)


def greedy_cooldown(times: list[int], gap: int) -> list[int]:
    fired, last = [], None
    for t in sorted(times):
        if last is None or t - last >= gap:
            fired.append(t)
            last = t
    return fired


def walk_chains(alerts: list[tuple[int, int]], window: int) -> list[tuple[int, int, bool]]:
    """(chain number, position, new link) for (time, title) pairs in order."""
    out, chain, updated, titles = [], 0, None, set()
    for t, title in alerts:
        if updated is None or t - updated > window:
            chain, updated, titles = chain + 1, t, {title}
            out.append((chain, 1, True))
        elif title in titles:
            out.append((chain, len(titles), False))
        else:
            titles.add(title)
            updated = t
            out.append((chain, len(titles), True))
    return out
