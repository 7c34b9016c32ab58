"""Helpers shared by the operators: words, tables in the shared folder, running sums over all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from embertrace.staging import stage

#: A word: a run of characters other than the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle makes in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def source_rank(column: str = "source") -> list[Column]:
    """Order of sources: by code point, null last."""
    return [F.col(column).asc_nulls_last()]


def range_staged(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` in range partitions of ``order``, written out; ``_part`` numbers the partitions in that order."""
    ranged = df.repartitionByRange(partitions(df.sparkSession), *order)
    return stage(ranged.withColumn("_part", F.spark_partition_id()), name)


def running_sum(staged: DataFrame, order: list[Column], value: str, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Add ``out``, the sum of ``value`` up to and with each row in ``order`` (per ``by``).

    ``staged`` comes from :func:`range_staged` with an order that begins with ``by``. Every partition sums its own
    rows; only one total per partition (and ``by``) meets in the second window, so no key's rows meet in one task.
    """
    rows = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = staged.groupBy("_part", *by).agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        F.col("_part").alias("_p"), *[F.col(c).alias(f"_b_{c}") for c in by],
        F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"),
    )
    match = F.col("_part") == F.col("_p")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    summed = staged.withColumn("_own", F.sum(value).over(rows)).join(before, match)
    return summed.withColumn(out, F.col("_own") + F.col("_before")).drop("_own", "_before", "_p", *[f"_b_{c}" for c in by])


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text, null as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def arrow_schema(spec: str) -> pa.Schema:
    """Arrow schema of ``"name:type, ..."``."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(),
             "boolean": pa.bool_(), "longs": pa.list_(pa.int64()), "ints": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[k]) for n, k in (x.strip().split(":") for x in spec.split(","))])


def spark_schema(spec: str) -> str:
    kinds = {"long": "bigint", "int": "int", "longs": "array<bigint>", "ints": "array<int>"}
    return ", ".join(f"{n} {kinds.get(k, k)}" for n, k in (x.strip().split(":") for x in spec.split(",")))


def map_batches(df: DataFrame, spec: str, rows: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]]) -> DataFrame:
    """``mapInArrow`` whose function yields dicts of columns named in ``spec``."""

    def run(batches):
        schema = arrow_schema(spec)
        for columns in rows(batches):
            yield pa.RecordBatch.from_arrays(
                [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in ((columns[f.name], f) for f in schema)],
                schema=schema)

    return df.mapInArrow(run, spark_schema(spec))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word, alike on every machine."""
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words, from the hashes of the words; in log2(k) vector steps."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    result, done, power, width = None, 0, h, 1
    while k:
        if k & 1:
            part = power[done: done + n]
            result = part.copy() if result is None else mixed(result * np.uint64(0x9E3779B97F4A7C15) + part)
            done += width
        k >>= 1
        if k:
            power = mixed(power[:-width] * np.uint64(0xD6E8FEB86659FD93) + power[width:])
            width *= 2
    return result


def worker_memory(key: str, make: Callable[[], object]):
    """What ``make`` returned for ``key`` first in this Python worker; it outlives tasks."""
    import sys

    memory = sys.__dict__.setdefault("_embertrace_llm_memory", {})
    if key not in memory:
        memory[key] = make()
    return memory[key]


#: Columns of ``documents``.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def sheltered(df: DataFrame, own: tuple[str, ...] = DOCUMENT) -> DataFrame:
    """``df`` with every column but ``own`` renamed by its place, so that no name can clash with an operator's."""
    return df.toDF(*[c if c in own else f"extra_column_{i}" for i, c in enumerate(df.columns)])


def restored(df: DataFrame, names: list[str], own: tuple[str, ...] = DOCUMENT) -> list[Column]:
    """The columns of a sheltered table under their old ``names``, to select from ``df``."""
    return [F.col(c) if c in own else F.col(f"extra_column_{i}").alias(c) for i, c in enumerate(names)]
