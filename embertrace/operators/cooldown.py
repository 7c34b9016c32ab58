"""Alert cooldown (F1): a match fires if none fired before it on the same entity
and rule, or the last one that fired is at least the cooldown away. Only fired
matches restart the clock, so this is a greedy fold and not a gap test.

An island is a run of matches with gaps below the cooldown; its first match
always fires, so islands are independent. Islands of one row need no fold,
those up to ``fold_limit`` rows are folded as arrays, and larger ones are cut
into slices that many tasks fold at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from embertrace.config import EngineConfig
from embertrace.operators.islands import bucket_summary, collect_run, run_columns, with_islands
from embertrace.staging import stage

KEYS = ["entity_name", "rule_ordinal"]
_ORDER = ["t", "event_id"]


def one_per_alert(matches: DataFrame) -> DataFrame:
    """One row per ``alert_id``: of several deliveries of an event the earliest counts.

    Combines before the shuffle, so an event delivered very often does not
    gather in one task.
    """
    rest = [name for name in matches.columns if name != "alert_id"]
    first = F.min_by(F.struct(*rest), F.struct("t", "entity_name", "event_id")).alias("_row")
    return matches.groupBy("alert_id").agg(first).select("alert_id", "_row.*").select(*matches.columns)


def apply_cooldown(matches: DataFrame, config: EngineConfig) -> DataFrame:
    """The matches that become alerts, all columns kept.

    ``matches`` should be a stored table with one row per alert
    (:func:`one_per_alert`): it is read once for the bucket summary and once for
    the fold. It needs ``entity_name``, ``rule_ordinal``, ``event_id`` and the
    time ``t`` in microseconds.
    """
    gap = config.cooldown_us
    if gap <= 0:
        return matches
    columns = matches.columns
    summary = stage(bucket_summary(matches, KEYS, gap, True, config.slice_rows), "cooldown-buckets")
    rows = with_islands(matches, summary, KEYS, gap)
    fired = _fold_small(rows.filter(F.col("island_size") <= config.fold_limit), columns, gap)
    if summary.filter(F.col("island_size") > config.fold_limit).isEmpty():
        return fired
    return fired.unionByName(_fold_large(rows.filter(F.col("island_size") > config.fold_limit), columns, gap))


def _fold_small(rows: DataFrame, columns: list[str], gap: int) -> DataFrame:
    islands = rows.groupBy(*KEYS, "island").agg(collect_run(rows, _ORDER, skip=[*KEYS, "island"]).alias("run"))
    fired = F.expr(f"""
        aggregate(
            sequence(1, size(run)),
            named_struct('last', cast(null as bigint), 'out', cast(array() as array<int>)),
            (acc, i) -> if(acc.last is null or element_at(run, i).t - acc.last >= {gap}L,
                           named_struct('last', element_at(run, i).t, 'out', array_append(acc.out, i)),
                           acc),
            acc -> transform(acc.out, i -> element_at(run, i)))
    """)
    # A run of one row fires as it is.
    kept = islands.select(*KEYS, F.explode(F.when(F.size("run") == 1, F.col("run")).otherwise(fired)).alias("row"))
    return kept.select(*KEYS, *run_columns(rows, _ORDER, skip=[*KEYS, "island"])).select(*columns)


# --- oversized islands ---------------------------------------------------------
#
# Matches at one instant are interchangeable up to the first of them, so only
# distinct times matter. In a slice, the time that fires next after time x is
# the first one at or after x + cooldown, which does not depend on anything
# before x. Which time of a slice fires first depends on the slices before, but
# it lies within the slice's opening stretch. So every slice first tells, for
# each time of its opening stretch, the last time that would fire from there;
# those short tables are walked through once per island; then every slice,
# knowing where it is entered, lists the times that fire.


def _runs_out(times: np.ndarray, gap: int) -> np.ndarray:
    """For each position, the last position that fires when this one fires."""
    after = np.searchsorted(times, times + gap, side="left")
    reach = np.where(after < len(times), after, np.arange(len(times)))
    while True:
        further = reach[reach]
        if np.array_equal(further, reach):
            return reach
        reach = further


def _slice_table(gap: int):
    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.unique(pdf["t"].to_numpy())
        opening = min(np.searchsorted(times, times[0] + 2 * gap, side="left"), len(times))
        out = pd.DataFrame({"entry": times[:opening], "exit": times[_runs_out(times, gap)[:opening]]})
        for key in (*KEYS, "island", "slice"):
            out[key] = pdf[key].iloc[0]
        return out

    return table


def _walk(gap: int):
    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["slice", "entry"])
        last, entries = None, []
        for number, part in pdf.groupby("slice", sort=True):
            entry = part["entry"].to_numpy()
            at = 0 if last is None else int(np.searchsorted(entry, last + gap, side="left"))
            if at < len(entry):
                entries.append((number, entry[at]))
                last = part["exit"].to_numpy()[at]
        out = pd.DataFrame(entries, columns=["slice", "entered"])
        for key in (*KEYS, "island"):
            out[key] = pdf[key].iloc[0]
        return out

    return walk


def _list_fired(gap: int):
    def fired(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=[*KEYS, "t"])
        times = np.unique(left["t"].to_numpy())
        at, hits = int(np.searchsorted(times, right["entered"].iloc[0])), []
        while at < len(times):
            hits.append(times[at])
            at = int(np.searchsorted(times, times[at] + gap, side="left"))
        return pd.DataFrame({"entity_name": key[0], "rule_ordinal": key[1], "t": hits})

    return fired


def _fold_large(rows: DataFrame, columns: list[str], gap: int) -> DataFrame:
    part = [*KEYS, "island", "slice"]
    times = stage(rows.select(*part, "t").distinct(), "hot-times")
    table = times.groupBy(*part).applyInPandas(
        _slice_table(gap), "entry long, exit long, entity_name string, rule_ordinal int, island long, slice long"
    )
    entries = table.groupBy(*KEYS, "island").applyInPandas(
        _walk(gap), "slice long, entered long, entity_name string, rule_ordinal int, island long"
    )
    fired = times.groupBy(*part).cogroup(entries.groupBy(*part)).applyInPandas(
        _list_fired(gap), "entity_name string, rule_ordinal int, t long"
    )
    # Of several matches at a fired time the first by event id is the alert.
    rest = F.struct(*[c for c in columns if c not in (*KEYS, "t")]).alias("rest")
    first = rows.join(fired, [*KEYS, "t"]).groupBy(*KEYS, "t").agg(F.min_by(rest, "event_id").alias("rest"))
    return first.select(*KEYS, "t", "rest.*").select(*columns)
