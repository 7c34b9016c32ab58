"""Joins with tables of one row per key whose other side has very frequent keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A key is frequent if it has more than one row in so many; no table has more frequent keys than this number.
SHARES = 10_000


def join_frequent(rows: DataFrame, table: DataFrame, keys: list[str], weight: Column, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` by ``keys`` (equal names, not null in ``table``).

    ``table`` has one row per key, of which ``weight`` tells how many rows of ``rows`` (``total`` in all) have it. At most
    SHARES keys can be frequent, so these are broadcast, and the shuffled join only sees keys of few rows.
    """
    frequent = weight * SHARES > total
    hot = F.broadcast(table.filter(frequent).withColumn("_hot", F.lit(True)))
    met = rows.join(hot, keys, "left")
    columns = [c for c in table.columns if c not in keys]
    easy = met.filter("_hot").select(*rows.columns, *columns)
    rest = met.filter(F.col("_hot").isNull()).select(*rows.columns)
    return easy.unionByName(rest.join(table.filter(~frequent), keys, how))
