"""Settings shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass, replace

DOCUMENTED = "documented"
OBSERVED = "observed"


@dataclass(frozen=True)
class EngineConfig:
    """Thresholds and windows. Defaults are the engine's published settings.

    ``semantics`` chooses between the documented meaning of a rule or record
    ("documented") and the bug-compatible one ("observed").
    """

    semantics: str = DOCUMENTED

    # detection
    rules_enabled: bool = True

    # risk
    risk_critical: int = 75
    risk_high: int = 50
    risk_medium: int = 25
    decay_interval_hours: int = 24  # 0: scores do not decay
    decay_rate: float = 0.05

    # correlation
    cooldown_seconds: int = 60
    chain_window_seconds: int = 15 * 60
    chain_min_rules: int = 2
    lookback_minutes: int = 60
    max_timeline: int = 500

    # storage
    retention_days: int = 90

    # Sensor names are a deployment's own; "replay" and "manual" are built in.
    sensors: tuple[str, ...] = ("hostlog", "netlog", "dnslog")
    # (name, address) pairs an alert tells the analyst to consult.
    cross_references: tuple[tuple[str, str], ...] = (
        ("the host log store", "http://localhost:8000"),
        ("the network sensor", "http://localhost:8001"),
    )

    # Physical limits. Groups above these take a sliced or streamed path with
    # the same result, so the values change speed and memory only.
    fold_limit: int = 10_000
    slice_rows: int = 200_000
    rules_per_pass: int = 60  # one bit each, below 63

    def __post_init__(self) -> None:
        if self.semantics not in (DOCUMENTED, OBSERVED):
            raise ValueError(f"semantics must be {DOCUMENTED!r} or {OBSERVED!r}")
        if not 1 <= self.rules_per_pass <= 62:
            raise ValueError("rules_per_pass must be between 1 and 62")
        if not 0.0 <= self.decay_rate <= 1.0:
            raise ValueError("decay_rate must be between 0.0 and 1.0")

    @property
    def documented(self) -> bool:
        return self.semantics == DOCUMENTED

    @property
    def event_sources(self) -> tuple[str, ...]:
        return (*self.sensors, "replay", "manual")

    @property
    def cooldown_us(self) -> int:
        return self.cooldown_seconds * 1_000_000

    @property
    def chain_window_us(self) -> int:
        return self.chain_window_seconds * 1_000_000

    def with_(self, **changes) -> "EngineConfig":
        return replace(self, **changes)
