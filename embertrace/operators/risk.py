"""Entity risk (F5, F7, F8, F10, F11): a saturating, decaying sum over the entity's alerts.

Points are positive, so between two decays clamping the plain running sum equals clamping at every step. Decay needs
a whole interval without a match, which cuts an entity's history into spells, few by nature (one per interval at most).
The sum is taken in three levels: rows within a short time bucket, bucket totals within a spell, and spell totals
folded in order with the decay before each. Only the first level handles rows, and no key's rows meet there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from embertrace.config import EngineConfig
from embertrace.functions.common import bucket_of
from embertrace.functions.scoring import RISK_MAX, risk_level
from embertrace.operators.chains import ORDER

#: Width of the buckets whose rows are summed together; divides an hour, so that buckets lie within decay intervals.
BUCKET_US = 900 * 1_000_000


def _interval_us(config: EngineConfig) -> int:
    return config.decay_interval_hours * 3_600_000_000


def quiet_spells(matches: DataFrame, config: EngineConfig, initial: DataFrame | None = None) -> DataFrame:
    """(entity_name, _day, spell, ticks): matches cut where decay may act.

    Decay needs a whole interval without a match, so buckets one interval wide hold every cut between them; ``ticks``
    is how often decay acted before the spell began.
    """
    days = matches.groupBy("entity_name", bucket_of("t", _interval_us(config)).alias("_day")).agg(
        F.min("t").alias("_first"), F.max("t").alias("_last")
    )
    in_entity = Window.partitionBy("entity_name").orderBy("_day")
    before = days.withColumn("_previous", F.lag("_last").over(in_entity))
    if initial is not None:
        seen = initial.select("entity_name", F.col("seen").alias("_seen"))
        before = before.join(seen, "entity_name", "left").withColumn("_previous", F.coalesce("_previous", "_seen"))
    # A tick at the instant of a match finds the entity active.
    ticks = F.coalesce(quiet_ticks(F.col("_previous"), F.col("_first") - 1, config), F.lit(0).cast("bigint"))
    marked = before.withColumn("ticks", F.when(F.col("_previous").isNull(), 0).otherwise(ticks))
    spell = F.sum((F.col("ticks") > 0).cast("int")).over(in_entity.rowsBetween(Window.unboundedPreceding, 0))
    return marked.select("entity_name", "_day", spell.alias("spell"), "ticks")


def _spell_starts(spells: DataFrame, totals: DataFrame, config: EngineConfig, initial: DataFrame | None) -> DataFrame:
    """(entity_name, spell, _start): the score that each spell begins with."""
    points = totals.groupBy("entity_name", "spell").agg(F.sum("_points").alias("_total"))
    per_spell = spells.groupBy("entity_name", "spell").agg(F.max("ticks").alias("ticks")).join(
        points, ["entity_name", "spell"], "left"
    )
    runs = per_spell.groupBy("entity_name").agg(
        F.sort_array(F.collect_list(F.struct("spell", "ticks", F.coalesce("_total", F.lit(0)).alias("total")))).alias("run")
    )
    if initial is None:
        runs = runs.withColumn("_first", F.lit(0))
    else:
        score = initial.select("entity_name", F.col("risk_score").alias("_first"))
        runs = runs.join(score, "entity_name", "left").withColumn("_first", F.coalesce("_first", F.lit(0)))
    start_of = lambda state, item: F.struct(
        F.least(
            F.lit(RISK_MAX).cast("bigint"),
            decayed(state["score"], item["ticks"], config).cast("bigint") + item["total"],
        ).alias("score"),
        F.array_append(
            state["starts"],
            F.struct(item["spell"].alias("spell"), decayed(state["score"], item["ticks"], config).alias("start")),
        ).alias("starts"),
    )
    first = F.struct(
        F.col("_first").cast("bigint").alias("score"),
        F.array().cast("array<struct<spell:bigint,start:int>>").alias("starts"),
    )
    return runs.select(
        "entity_name", F.explode(F.aggregate("run", first, start_of, lambda state: state["starts"])).alias("_s")
    ).select("entity_name", "_s.spell", F.col("_s.start").alias("_start"))


def add_entity_risk(
    scored: DataFrame, matches: DataFrame, config: EngineConfig, initial: DataFrame | None = None
) -> DataFrame:
    """Entity risk before and after each alert, decay between matches included.

    ``scored`` and ``matches`` should be stored tables. ``initial`` is an optional (entity_name, risk_score, seen) of an
    earlier run: the score after its last alert and the time of its last match in microseconds.
    """
    placed = scored.withColumn("_bucket", bucket_of("t", BUCKET_US))
    totals = placed.groupBy("entity_name", "_bucket").agg(F.sum("risk_delta").alias("_points"))
    if config.decay_interval_hours > 0:
        spells = quiet_spells(matches, config, initial)
        day = F.expr(f"(_bucket * {BUCKET_US}L - pmod(_bucket * {BUCKET_US}L, {_interval_us(config)}L)) div {_interval_us(config)}L")
        totals = totals.withColumn("_day", day).join(spells.select("entity_name", "_day", "spell"), ["entity_name", "_day"])
        starts = _spell_starts(spells, totals, config, initial)
    else:
        totals = totals.withColumn("spell", F.lit(0).cast("bigint"))
        starts = totals.select("entity_name", "spell").distinct()
        if initial is not None:
            starts = starts.join(initial.select("entity_name", F.col("risk_score").alias("_start")), "entity_name", "left")
        else:
            starts = starts.withColumn("_start", F.lit(0))
        starts = starts.withColumn("_start", F.coalesce("_start", F.lit(0)))
    earlier = Window.partitionBy("entity_name", "spell").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_earlier", F.coalesce(F.sum("_points").over(earlier), F.lit(0))).join(
        starts, ["entity_name", "spell"]
    ).select("entity_name", "_bucket", (F.col("_start") + F.col("_earlier")).alias("_offset"))
    in_bucket = Window.partitionBy("entity_name", "_bucket").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    running = placed.withColumn("_running", F.sum("risk_delta").over(in_bucket)).join(offsets, ["entity_name", "_bucket"])
    after = F.col("_offset") + F.col("_running")
    return running.withColumns({
        "entity_risk_after": F.least(F.lit(RISK_MAX), after).cast("int"),
        "entity_risk_before": F.least(F.lit(RISK_MAX), after - F.col("risk_delta")).cast("int"),
    }).drop("_bucket", "_offset", "_running")


def decayed(score: Column, ticks: Column, config: EngineConfig) -> Column:
    """Score after ``ticks`` decay steps: at least one point each, never below zero.

    A step costs a point or more and scores end at 100, so a hundred steps
    always reach zero.
    """
    steps = F.sequence(F.lit(1), F.least(ticks.cast("int"), F.lit(RISK_MAX)))
    rate = F.lit(config.decay_rate)

    def step(value: Column, _: Column) -> Column:
        loss = F.greatest(F.lit(1), F.floor(value * rate).cast("int"))
        return F.greatest(F.lit(0), value - loss)

    return F.when(ticks > 0, F.aggregate(steps, score.cast("int"), step)).otherwise(score.cast("int"))


def quiet_ticks(last_seen: Column, until: Column, config: EngineConfig) -> Column:
    """Ticks of the epoch-aligned decay grid in (last_seen, until] that find the
    entity quiet for a whole interval. All times in microseconds."""
    interval = config.decay_interval_hours * 3_600 * 1_000_000
    first = F.ceil((last_seen + interval) / F.lit(interval))
    return F.greatest(F.lit(0).cast("bigint"), F.floor(until / F.lit(interval)) - first + 1)


def decay_entities(entities: DataFrame, as_of: Column, config: EngineConfig) -> DataFrame:
    """Entity scores brought forward to ``as_of``; peak risk stays."""
    ticks = quiet_ticks(F.unix_micros("last_seen"), F.unix_micros(as_of), config)
    return (
        entities.withColumn("decay_ticks", ticks)
        .withColumn("risk_score", decayed(F.col("risk_score"), F.col("decay_ticks"), config))
        .withColumn("risk_level", risk_level(F.col("risk_score"), config))
    )
