"""Compare registered queries with their SQL in DuckDB.

Run as a script: ``python tests/oracle_check.py [sf folder] [query ...]``.
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    return value


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, con, sf_dir: str, function, sql: str) -> str | None:
    """None when rows and columns agree, else what differs."""
    df = function(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "CartesianProduct" in plan or "NestedLoopJoin" in plan:
        return "the plan forms all pairs"
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = _rows(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"first difference:\n  spark {a}\n  sql   {b}"
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    types = dict(zip(names, [str(d[1]) for d in cursor.description]))
    alike = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
             "timestamp_ntz": "TIMESTAMP"}
    odd = {n: (kinds[n], types[n]) for n in kinds if alike.get(kinds[n]) != types[n]}
    return f"rows agree, types differ: {odd}" if odd else None


def main() -> int:
    from pyspark.sql import SparkSession

    from embertrace.plans.catalog import ORACLES, QUERIES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in wanted:
        began = time.time()
        try:
            if name in ORACLES:
                problem = compare(spark, con, sf_dir, QUERIES[name], ORACLES[name])
            else:
                rows = QUERIES[name](spark, sf_dir).count()
                problem = None if rows else "no rows"
        except Exception as error:  # report every query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        kind = "" if name in ORACLES else " (rows only)"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name}{kind} {time.time() - began:.1f}s {problem or ''}", flush=True)
    print(f"{len(wanted)} queries, {bad} problems")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
