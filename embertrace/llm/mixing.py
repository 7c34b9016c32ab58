"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source is a queue of its documents in shuffled order; a queue longer than its source starts over, up to
``max_repeats`` times. A document copy's virtual finish time is the source's words up to its end, divided by the source's
target. All copies are range-sorted by finish time and cut where their words reach the total budget. A queue ends at the
copy whose middle is the last one before the target, so a source misses its target by half a document at most.

Defined results: a null text has size 0; a null source is a source of its own and ranks last; documents of size 0 belong
to the mix without adding words, on the first pass only, if their queue reaches them; repeated rows are documents of their
own; an empty table gives an empty result. Extra columns are kept unless they start with ``mix_``.

Sources are summed on the map side. Running sums over a source, and over all copies, are range-partitioned, so a source
that holds most rows is spread over all tasks. Only a document's number, source, size and order key are sorted; its other columns are
written once and meet the taken copies in one join by number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from embertrace.llm.common import WORD, range_staged, running_sum, sheltered, source_rank
from embertrace.staging import discard, shuffles_removed, stage

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``mix_source, mix_source_size, mix_target`` from rows of (mix_source, mix_size).

    Sources get their weight by rank. Targets share all words by weight; one that would exceed ``max_repeats`` times its
    source stops there and the excess goes to the others by weight. In order of *limit / weight*, a source is full when
    its share of what the earlier ones left exceeds its limit; the largest such share per weight is the level of all others.
    """
    per_source = sizes.groupBy("mix_source").agg(F.sum("mix_size").alias("mix_source_size")).withColumn("one", F.lit(1))
    order = source_rank("mix_source")
    ranked = running_sum(range_staged(per_source, order, "mix-sources"), order, "one", "rank").drop("_part", "one")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    rows = ranked.withColumns({"weight": weight, "limit": max_repeats * F.col("mix_source_size")})
    rows = rows.withColumn("full_at", F.col("limit") / F.col("weight"))
    order = [F.col("full_at"), F.col("rank")]
    rows = range_staged(rows, order, "mix-limits")
    summed = running_sum(running_sum(rows, order, "limit", "limits"), order, "weight", "weights")
    whole = rows.agg(F.sum("mix_source_size").alias("words"), F.sum("weight").alias("weight")).first()
    words, total = whole["words"] or 0, whole["weight"] or 0
    left = F.lit(words) - (F.col("limits") - F.col("limit"))
    share = left / (F.lit(total) - (F.col("weights") - F.col("weight")))
    level = summed.agg(F.max(share).alias("level")).first()["level"] or 0.0
    target = F.least(F.col("limit").cast("double"), F.col("weight") * F.lit(float(level)))
    return stage(rows.select("mix_source", "mix_source_size", target.alias("mix_target")), "mix-targets")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = 17,
                keep: list[str] | None = None) -> DataFrame:
    """All copies of all documents with ``mix_taken``: whether the mix takes the copy.

    ``docs`` has ``doc_id``, ``source`` and ``text``; ``keep`` names the columns to carry along (default: all). Added:
    ``mix_row`` (number of the document), ``mix_size``, ``mix_pass`` (0 for the first copy), ``mix_source_size``,
    ``mix_target``, ``mix_finish`` (virtual time) and ``mix_start`` (words of the mix before this copy). In order of
    ``mix_start`` the taken copies are the mix. Every document has one row at least.
    """
    names = [c for c in docs.columns if not c.startswith("mix_")]
    docs = sheltered(docs.select(*names))
    wanted = [c for c in names if keep is None or c in keep]
    columns = [c for c, name in zip(docs.columns, names) if name in wanted]
    shuffled = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    sized = docs.select(*columns, F.col("source").alias("mix_source"), word_count().alias("mix_size"), shuffled.alias("mix_key"))
    order = [*source_rank("mix_source"), F.col("mix_key")]
    numbered = stage(sized.withColumn("mix_row", F.monotonically_increasing_id()), "mix-documents")
    rows = range_staged(numbered.select("mix_source", "mix_size", "mix_key", "mix_row"), order, "mix-rows")
    order.append(F.col("mix_row"))
    targets = source_targets(rows.select("mix_source", "mix_size"), weights, max_repeats).withColumnRenamed("mix_source", "mix_s")
    queued = running_sum(rows, order, "mix_size", "mix_upto", by=("mix_source",)).drop("_part")
    queued = queued.join(targets, F.col("mix_source").eqNullSafe(F.col("mix_s"))).drop("mix_s")
    size, source_size = F.col("mix_size"), F.col("mix_source_size")
    passes = F.explode(F.when(size > 0, F.sequence(F.lit(0), F.lit(max_repeats - 1))).otherwise(F.array(F.lit(0))))
    copies = queued.withColumn("mix_pass", passes).withColumn("mix_upto", F.col("mix_upto") + F.col("mix_pass") * source_size)
    due = F.col("mix_upto") - size / 2 <= F.col("mix_target")
    copies = copies.filter(due | (F.col("mix_pass") == 0)).withColumns({
        "mix_due": due, "mix_words": F.when(due, size).otherwise(F.lit(0)),
        "mix_finish": F.when(F.col("mix_target") > 0, F.col("mix_upto") / F.col("mix_target")).otherwise(F.lit(0.0)),
    })
    order = [F.col("mix_finish"), F.col("mix_row"), F.col("mix_pass")]
    sorted_ = range_staged(copies.drop("mix_source", "mix_key", "mix_upto"), order, "mix-copies")
    discard(rows)
    placed = running_sum(sorted_, order, "mix_words", "mix_end").drop("_part")
    with shuffles_removed(docs.sparkSession):
        budget = targets.agg(F.sum("mix_source_size").alias("words")).first()["words"] or 0
    start = F.col("mix_end") - F.col("mix_words")
    # Finish times are floats: a copy that begins within a word of the budget begins at it.
    taken = F.col("mix_due") & ((start < budget) | (F.col("mix_words") == 0))
    placed = stage(placed.withColumns({"mix_start": start, "mix_taken": taken}), "mix-placed")
    discard(sorted_)
    met = numbered.drop("mix_source", "mix_size", "mix_key").join(placed, "mix_row")
    back = [F.col(c).alias(name) for c, name in zip(docs.columns, names) if name in wanted]
    made = ["row", "size", "pass", "source_size", "target", "finish", "start", "taken"]
    return met.select(*back, *[f"mix_{c}" for c in made])


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: the taken copies, with the columns of ``docs``."""
    return mix_sources(docs, **settings).filter("mix_taken").select(*[c for c in docs.columns if not c.startswith("mix_")])
