"""Cut the ordered rows of each key at quiet gaps, without one task per key.

Rows are counted per (key, time bucket), with the bucket as wide as the gap
that cuts. Two rows of one bucket are closer than the gap, so a cut can only
lie before the first row of a bucket: islands, their sizes and the slices of
oversized islands all come from the bucket summary. The summary combines on
the map side and has at most (time span / gap) rows per key, however many rows
the key has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from embertrace.functions.common import bucket_of


def bucket_summary(rows: DataFrame, keys: list[str], gap_us: int, inclusive: bool, slice_rows: int) -> DataFrame:
    """(keys, _bucket, island, island_size, slice) per non-empty bucket.

    ``rows`` needs a microsecond column ``t``. A gap of exactly ``gap_us`` cuts
    when ``inclusive``.
    """
    buckets = rows.groupBy(*keys, bucket_of("t", gap_us).alias("_bucket")).agg(
        F.min("t").alias("_first"), F.max("t").alias("_last"), F.count("*").alias("_rows")
    )
    in_key = Window.partitionBy(*keys).orderBy("_bucket")
    gap = F.col("_first") - F.lag("_last").over(in_key)
    cuts = gap >= gap_us if inclusive else gap > gap_us
    heads = buckets.withColumn("_head", F.coalesce(cuts, F.lit(True)).cast("bigint"))
    numbered = heads.withColumn(
        "island", F.sum("_head").over(in_key.rowsBetween(Window.unboundedPreceding, 0))
    )
    in_island = Window.partitionBy(*keys, "island")
    before = F.sum("_rows").over(in_island.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows")
    return numbered.select(
        *keys, "_bucket", "island",
        F.sum("_rows").over(in_island).alias("island_size"),
        F.floor(before / slice_rows).cast("bigint").alias("slice"),
    )


def with_islands(rows: DataFrame, summary: DataFrame, keys: list[str], gap_us: int) -> DataFrame:
    """Attach island number, size and slice to every row."""
    return rows.withColumn("_bucket", bucket_of("t", gap_us)).join(summary, [*keys, "_bucket"]).drop("_bucket")


def _packed(rows: DataFrame, names: list[str]):
    # Maps have no order, which sort_array needs of every field; entries do.
    kinds = dict(rows.dtypes)
    return F.struct(*[
        F.map_entries(name).alias(name) if kinds[name].startswith("map<") else F.col(name) for name in names
    ])


def collect_run(rows: DataFrame, order: list[str], skip: list[str]):
    """Rows of a (size-limited) group as one array sorted by ``order``."""
    rest = [name for name in rows.columns if name not in (*order, *skip)]
    return F.sort_array(F.collect_list(F.struct(*order, _packed(rows, rest).alias("rest"))))


def run_columns(rows: DataFrame, order: list[str], skip: list[str], row: str = "row"):
    """The columns packed by :func:`collect_run`, taken from element ``row``."""
    kinds = dict(rows.dtypes)
    rest = [name for name in rows.columns if name not in (*order, *skip)]
    return [F.col(f"{row}.{name}") for name in order] + [
        F.map_from_entries(f"{row}.rest.{name}").alias(name) if kinds[name].startswith("map<")
        else F.col(f"{row}.rest.{name}")
        for name in rest
    ]
