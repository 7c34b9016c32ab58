"""Registry of named queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import TimestampType

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def plain_times(df: DataFrame) -> DataFrame:
    """Timestamps without a zone, as the provided tables have them."""
    zoned = {
        field.name: F.col(field.name).cast("timestamp_ntz")
        for field in df.schema.fields if isinstance(field.dataType, TimestampType)
    }
    return df.withColumns(zoned) if zoned else df


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its SQL if there is one."""

    def register(function: Query) -> Query:
        key = name or function.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return plain_times(function(spark, sf_dir))

        run.__name__, run.__doc__ = key, function.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return function

    return register
