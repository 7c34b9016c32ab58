"""Attack chains (F2-F4, F6, F9): alerts of one entity within a sliding window.

An alert joins the entity's active chain while it is no later than the window
after the chain's last update. A rule title new to the chain adds a link and
updates the chain; a repeat joins without an update, so a chain cannot be told
from gaps between alerts alone. Islands (runs with gaps within the window) are
independent, because the first alert of an island always opens a chain.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from embertrace.config import EngineConfig
from embertrace.functions.common import stable_id
from embertrace.functions.scoring import CHAIN_BONUS, RISK_MAX
from embertrace.operators.islands import bucket_summary, collect_run, run_columns, with_islands
from embertrace.staging import stage

KEYS = ["entity_name"]
ORDER = ["t", "event_id", "rule_ordinal"]


def assign_chains(alerts: DataFrame, config: EngineConfig) -> DataFrame:
    """Alerts with ``island, chain_id, chain_position, is_new_link``.

    ``alerts`` should be a stored table (read twice) with ``alert_id``,
    ``entity_name``, ``t``, ``event_id``, ``rule_ordinal`` and ``title_key``.
    """
    window = config.chain_window_us
    summary = stage(bucket_summary(alerts, KEYS, max(window, 1), False, config.slice_rows), "chain-buckets")
    rows = with_islands(alerts, summary, KEYS, max(window, 1)).drop("slice")
    folded = _fold_small(rows.filter(F.col("island_size") <= config.fold_limit), window)
    if not summary.filter(F.col("island_size") > config.fold_limit).isEmpty():
        folded = folded.unionByName(_fold_large(rows.filter(F.col("island_size") > config.fold_limit), window))
    return (
        folded.withColumn("chain_id", stable_id("entity_name", "head_alert_id"))
        .drop("island_size", "head_alert_id")
    )


def _fold_small(rows: DataFrame, window: int) -> DataFrame:
    skip = [*KEYS, "island"]
    islands = rows.groupBy(*skip).agg(collect_run(rows, ORDER, skip).alias("run"))
    # acc.head: position of the chain's first alert in the run.
    # acc.out: (head, position in the chain, opened a link) per alert.
    links = F.expr(f"""
        aggregate(
            run,
            named_struct('n', 0, 'head', 0, 'updated', cast(null as bigint),
                         'titles', cast(array() as array<bigint>),
                         'out', cast(array() as array<struct<head:int,pos:int,new:boolean>>)),
            (acc, x) ->
                if(acc.updated is not null and x.t - acc.updated <= {window}L,
                   if(array_contains(acc.titles, x.rest.title_key),
                      named_struct('n', acc.n + 1, 'head', acc.head, 'updated', acc.updated, 'titles', acc.titles,
                                   'out', array_append(acc.out, named_struct(
                                       'head', acc.head, 'pos', size(acc.titles), 'new', false))),
                      named_struct('n', acc.n + 1, 'head', acc.head, 'updated', x.t,
                                   'titles', array_append(acc.titles, x.rest.title_key),
                                   'out', array_append(acc.out, named_struct(
                                       'head', acc.head, 'pos', size(acc.titles) + 1, 'new', true)))),
                   named_struct('n', acc.n + 1, 'head', acc.n + 1, 'updated', x.t,
                                'titles', array(x.rest.title_key),
                                'out', array_append(acc.out, named_struct(
                                    'head', acc.n + 1, 'pos', 1, 'new', true)))),
            acc -> transform(acc.out, (o, i) -> named_struct(
                'row', element_at(run, i + 1),
                'head_alert_id', element_at(run, o.head).rest.alert_id, 'pos', o.pos, 'new', o.new)))
    """)
    alone = F.expr("""array(named_struct('row', run[0], 'head_alert_id', run[0].rest.alert_id,
                                         'pos', 1, 'new', true))""")
    each = islands.select(*skip, F.explode(F.when(F.size("run") == 1, alone).otherwise(links)).alias("link"))
    return each.select(
        *skip, *run_columns(rows, ORDER, skip, row="link.row"), "link.head_alert_id",
        F.col("link.pos").alias("chain_position"), F.col("link.new").alias("is_new_link"),
    )


def _walk_sorted(window: int):
    """Chains over rows sorted by island and time, one open chain at a time."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        island = head = updated = None
        titles: set[int] = set()
        for batch in batches:
            heads, positions, news = [], [], []
            for name, number, t, alert_id, title in zip(
                batch["entity_name"], batch["island"], batch["t"], batch["alert_id"], batch["title_key"]
            ):
                if (name, number) != island or t - updated > window:
                    island, head, updated, titles = (name, number), alert_id, t, {title}
                    is_new = True
                elif title in titles:
                    is_new = False
                else:
                    titles.add(title)
                    updated, is_new = t, True
                heads.append(head)
                positions.append(len(titles))
                news.append(is_new)
            yield pd.DataFrame({
                "entity_name": batch["entity_name"], "alert_id": batch["alert_id"],
                "head_alert_id": heads, "chain_position": positions, "is_new_link": news,
            })

    return walk


def _fold_large(rows: DataFrame, window: int) -> DataFrame:
    """Islands too long for an array: stream them in order, holding one chain.

    Cooldown bounds what an entity can bring here to (rules x time span /
    cooldown) alerts, whatever its share of the events.
    """
    links = (
        rows.select("entity_name", "island", *ORDER, "alert_id", "title_key")
        .repartition("entity_name", "island")
        .sortWithinPartitions("entity_name", "island", *ORDER)
        .mapInPandas(
            _walk_sorted(window),
            "entity_name string, alert_id string, head_alert_id string, chain_position int, is_new_link boolean",
        )
    )
    return rows.join(links, ["entity_name", "alert_id"])


def add_chain_risk(chained: DataFrame, config: EngineConfig) -> DataFrame:
    """Risk points of each alert, the chain's risk around it, and escalation.

    Chains never cross an island, so these windows reuse the partitioning of
    the fold. A chain escalates when a link is added while the risk before that
    link is already critical.
    """
    in_chain = Window.partitionBy("entity_name", "island", "chain_id").orderBy(*ORDER)
    so_far = in_chain.rowsBetween(Window.unboundedPreceding, 0)
    bonus = F.when(F.col("chain_position") >= config.chain_min_rules, CHAIN_BONUS).otherwise(0)
    scored = chained.withColumn("risk_delta", (F.col("risk_points") + bonus).cast("int"))
    total = F.sum("risk_delta").over(so_far)
    risk = scored.withColumns({
        "chain_risk_after": F.least(F.lit(RISK_MAX), total).cast("int"),
        "chain_risk_before": F.least(F.lit(RISK_MAX), total - F.col("risk_delta")).cast("int"),
    })
    trips = F.col("is_new_link") & (F.col("chain_risk_before") >= config.risk_critical)
    already = F.coalesce(
        F.max(trips).over(in_chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)
    )
    return risk.withColumns({"escalates": trips & ~already, "is_escalated": trips | already})
