"""Queries that write a time as text, on events of which some lie on whole seconds."""

import pytest
from oracle_check import TABLES, compare, connect
from pyspark.sql import functions as F

from embertrace.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def whole_seconds(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("whole-seconds")
    for table in TABLES:
        (folder / f"{table}.parquet").symlink_to(f"{sf_dir}/{table}.parquet")
    (folder / "events.parquet").unlink()
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    cut = F.when(F.col("event_id") % 3 == 0, F.date_trunc("second", "ts").cast("timestamp_ntz")).otherwise(F.col("ts"))
    events.withColumn("ts", cut).toPandas().to_parquet(folder / "events.parquet", coerce_timestamps="us")
    return str(folder)


@pytest.mark.parametrize("name", ["chain_links", "flatten_event", "narrate_how"])
def test_whole_seconds_equal_sql(spark, whole_seconds, name):
    problem = compare(spark, connect(whole_seconds), whole_seconds, QUERIES[name], ORACLES[name])
    assert problem is None, problem
