"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (names separated by commas; default: the headline list).

Pipeline queries run from the raw events every time. Table queries read the
stored tables; building those is timed on its own as ``build_store``.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from pyspark.sql import SparkSession

from embertrace.plans import runs
from embertrace.plans.catalog import QUERIES

HEADLINE = [
    "detect_matches", "match_enrich", "cooldown_alerts", "chain_assign", "chain_risk_running", "entity_risk_running",
    "entity_risk_decayed", "chain_rollup", "entity_profile", "normalise_events", "load_json_formats", "rules_catalog",
    "pred_regex", "pred_cidr", "flatten_event", "entity_timeline", "investigate_lookback", "investigate_sql",
    "alert_count_by_rule", "alerts_recent", "chains_upsert", "warm_start_state", "alert_messages", "store_stats",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(action) -> float:
        began = time.perf_counter()
        action()
        return round(time.perf_counter() - began, 3)

    def run(name: str) -> None:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    # Start the JVM's compiler and the Python workers before timing anything.
    small = str(Path(sf_dir).parent / "sf0.001")
    for name in ("chain_rollup", "rules_catalog"):
        QUERIES[name](spark, small if Path(small).exists() else sf_dir).count()

    times = {"build_store": timed(lambda: runs.store(spark, sf_dir).write_all())}
    for name in names:
        times[name] = timed(lambda: run(name))
    print(json.dumps({
        "metric": "headline queries, wall time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
