"""Upserts, archive, decay, look-back and analyst SQL."""

import pytest
from pyspark.sql import functions as F

from embertrace.config import EngineConfig
from embertrace.operators.investigate import NotAQuery, investigate_sql, lookback_context
from embertrace.operators.risk import decayed, quiet_ticks
from embertrace.operators.store import append_alerts, archive, upsert, write_alerts

CONFIG = EngineConfig()


def test_decay_sequence(spark):
    rows = spark.range(12).select("id", decayed(F.lit(100), F.col("id"), CONFIG).alias("s"),
                                  decayed(F.lit(3), F.col("id"), CONFIG).alias("small")).orderBy("id").collect()
    assert [r.s for r in rows][:11] == [100, 95, 91, 87, 83, 79, 76, 73, 70, 67, 64]
    assert [r.small for r in rows][:5] == [3, 2, 1, 0, 0]


def test_ticks_need_a_whole_quiet_interval(spark):
    day = 86_400_000_000
    got = spark.range(1).select(*[
        quiet_ticks(F.lit(last), F.lit(until), CONFIG).alias(f"c{i}")
        for i, (last, until) in enumerate([(0, day - 1), (0, day), (1, day), (1, 2 * day), (day // 2, 10 * day)])
    ]).first()
    assert list(got) == [0, 1, 0, 1, 9]


def test_latest_version_wins_however_many_there_are(spark):
    stored = spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], "key string, value int, version int")
    changes = spark.createDataFrame([("a", i, i) for i in range(1, 50)] + [("c", 9, 1)], stored.schema)
    assert {tuple(r) for r in upsert(stored, changes, ["key"], "version").collect()} == {
        ("a", 49, 49), ("b", 2, 0), ("c", 9, 1)}


def test_posting_alerts_twice_changes_nothing(spark):
    alerts = spark.createDataFrame([("a", 1), ("b", 2)], "alert_id string, n int")
    assert append_alerts(append_alerts(alerts, alerts), alerts.limit(1)).count() == 2


def test_archive_moves_old_rows_to_day_partitions(spark, tmp_path):
    rows = spark.createDataFrame([("old", "2026-01-01"), ("edge", "2026-02-01"), ("new", "2026-04-01")],
                                 "alert_id string, d string").withColumn("timestamp", F.col("d").cast("timestamp"))
    as_of = F.lit("2026-05-02").cast("timestamp")
    kept = archive(rows, "timestamp", as_of, CONFIG, str(tmp_path / "cold"))
    assert {r.alert_id for r in kept.collect()} == {"edge", "new"}
    cold = spark.read.parquet(str(tmp_path / "cold"))
    assert [(r.alert_id, str(r.date)) for r in cold.collect()] == [("old", "2026-01-01")]


def test_written_twice_is_written_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2026-01-01", 1), ("b", "2026-01-02", 1), ("c", None, 1), ("d", "2026-01-02", 1)],
                                 "alert_id string, d string, n int").withColumn("timestamp", F.col("d").cast("timestamp"))
    path = str(tmp_path / "t")
    write_alerts(rows, path)
    write_alerts(rows, path)
    # One alert comes again with another value, a new one arrives; days that are not concerned stay.
    more = [("b", "2026-01-02", 2), ("e", "2026-01-03", 1), ("f", None, 1)]
    write_alerts(spark.createDataFrame(more, "alert_id string, d string, n int").withColumn(
        "timestamp", F.col("d").cast("timestamp")), path)
    write_alerts(rows.limit(0), path)
    assert sorted((r.alert_id, r.n) for r in spark.read.parquet(path).collect()) == [
        ("a", 1), ("b", 2), ("c", 1), ("d", 1), ("e", 1), ("f", 1)]


def test_archived_twice_is_archived_once(spark, tmp_path):
    rows = spark.createDataFrame([("old", "2026-01-01"), ("new", "2026-04-01")],
                                 "alert_id string, d string").withColumn("timestamp", F.col("d").cast("timestamp"))
    path = str(tmp_path / "cold")
    for _ in range(2):
        archive(rows, "timestamp", F.lit("2026-05-02").cast("timestamp"), CONFIG, path)
    assert [r.alert_id for r in spark.read.parquet(path).collect()] == ["old"]


def test_alert_table_prunes_by_day(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2026-01-01"), ("b", "2026-01-02")], "alert_id string, d string")
    write_alerts(rows.withColumn("timestamp", F.col("d").cast("timestamp")), str(tmp_path / "t"))
    found = spark.read.parquet(str(tmp_path / "t")).filter("date = date'2026-01-02'")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 1 and "PartitionFilters: [isnotnull(date" in plan


@pytest.mark.parametrize("sql", [
    "DROP TABLE t", "SELECT 1; DROP TABLE t", "INSERT INTO t VALUES (1)", "SET x = 1", "CACHE TABLE t", "", "  ;",
    "SELECT * FROM text.`/etc/hostname`", "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM range(3)",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT (SELECT max(value) FROM text.`/etc/hostname`) AS x",
    "WITH a AS (SELECT * FROM text.`/etc/hostname`) SELECT * FROM a", "SELECT java_method('java.util.UUID', 'randomUUID')",
    "CREATE TABLE t AS SELECT 1", "SELECT FROM WHERE", "SELECT 1) t; --", "SELECT missing FROM nowhere",
])
def test_only_one_query_is_permitted(spark, sql):
    with pytest.raises(NotAQuery):
        investigate_sql(spark, sql)


def test_queries_keep_their_order_and_take_arguments(spark):
    spark.range(10).createOrReplaceTempView("numbers")
    got = investigate_sql(spark, "SELECT id FROM numbers WHERE id > :low ORDER BY id DESC;", {"low": 6}).collect()
    assert [r.id for r in got] == [9, 8, 7]
    assert investigate_sql(spark, "WITH a AS (SELECT 1 AS x) SELECT * FROM a").first().x == 1
    nested = "WITH a AS (SELECT id FROM numbers) SELECT id FROM a WHERE id IN (SELECT max(id) FROM numbers) AND EXISTS (SELECT 1 FROM a)"
    assert investigate_sql(spark, nested).first().id == 9


def test_generated_sql_runs_and_escapes_quotes(spark):
    from embertrace.operators.narrate import investigation_sql

    row = spark.range(1).select(investigation_sql(F.lit("o'neil"), F.lit("2026-01-01").cast("timestamp")).alias("s")).first()
    spark.createDataFrame([("a", "o'neil")], "alert_id string, entity_name string").select(
        "alert_id", F.lit("2026-01-02").cast("timestamp").alias("timestamp"), F.lit("r").alias("rule_title"), "entity_name",
        F.lit("h").alias("entity_host"), F.lit(5).alias("severity"), F.lit("w").alias("what"), F.lit("y").alias("why"),
        F.lit("c").alias("chain_id")).createOrReplaceTempView("alerts")
    assert investigate_sql(spark, row.s).count() == 1


def test_lookback_counts(spark):
    times = [0, 10, 3_600, 3_610, 3_611, 9_000]
    rows = spark.createDataFrame([("e", t * 1_000_000, f"r{i % 2}") for i, t in enumerate(times)],
                                 "entity_name string, t long, rule_title string")
    got = lookback_context(rows, CONFIG).orderBy("t").collect()
    want = [sum(1 for u in times if t - 3_600 <= u <= t) for t in times]
    assert [r.lookback_alerts for r in got] == want
