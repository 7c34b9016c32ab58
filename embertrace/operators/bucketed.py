"""Tables dealt into buckets by entity, written batch by batch under one ledger.

A commit writes the files of a batch for any number of tables and then one ledger entry that names them all: readers see
all of a batch or nothing of it, and a batch whose number the ledger holds is not written twice. Files of a commit that
broke off before its entry are unknown to readers and replaced when the batch is repeated.

Two kinds of table: of a replaced one, a commit holds the whole new content of every bucket it touches, other buckets keep
their files; to an appended one, a commit adds rows. A bucket is a number of entities, so what a batch rewrites follows
from the entities it touches. Rows of a busy bucket are spread over files by Spark's rebalancing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

_LEDGER = "table string, bucket int, n_rows long, appended boolean, commit long"


@dataclass(frozen=True)
class BucketStore:
    """The tables below ``path``. The number of buckets must not change."""

    spark: SparkSession
    path: str
    buckets: int = 64

    def with_bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64("entity_name"), F.lit(self.buckets)).cast("int"))

    def ledger(self) -> DataFrame:
        try:
            return self.spark.read.schema(_LEDGER).json(f"{self.path}/ledger")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _LEDGER)

    def committed(self, batch: int) -> bool:
        return not self.ledger().filter(F.col("commit") == batch).isEmpty()

    def snapshot(self, buckets: list[int] | None = None) -> dict[str, list[str]]:
        """The folders that hold the rows of each table: at most one per bucket of a replaced table."""
        known = self.ledger()
        if buckets is not None:
            known = known.filter(F.col("bucket").isin(buckets))
        newest = F.max("commit").over(Window.partitionBy("table", "bucket"))
        live = known.withColumn("newest", newest).filter("n_rows > 0 and (appended or commit = newest)")
        folders: dict[str, list[str]] = {}
        for row in live.select("table", "commit", "bucket").collect():
            folders.setdefault(row["table"], []).append(f"{self.path}/{row['table']}/commit={row['commit']}/bucket={row['bucket']}")
        return folders

    def files(self, table: str) -> list[str]:
        return self.snapshot().get(table, [])

    def read_with_commits(self, table: str, snapshot: dict[str, list[str]] | None = None) -> DataFrame | None:
        """A table (as of a snapshot) with the columns ``bucket`` and ``commit``; None if there is nothing yet."""
        paths = (self.snapshot() if snapshot is None else snapshot).get(table)
        return self.spark.read.option("basePath", f"{self.path}/{table}").parquet(*paths) if paths else None

    def read(self, table: str, snapshot: dict[str, list[str]] | None = None) -> DataFrame | None:
        """As :meth:`read_with_commits`, without ``commit``."""
        rows = self.read_with_commits(table, snapshot)
        return rows.drop("commit") if rows is not None else None

    def commit(self, batch: int, touched: list[int], replaced: dict[str, DataFrame], appended: dict[str, DataFrame]) -> bool:
        """Write a batch; False if it was written before.

        ``replaced`` tables hold all rows of the buckets ``touched``.
        """
        if self.committed(batch):
            return False
        entries = None
        for kind, tables in ((False, replaced), (True, appended)):
            for table, rows in tables.items():
                target = f"{self.path}/{table}/commit={batch}"
                dealt = self.with_bucket(rows).hint("rebalance", "bucket")
                dealt.write.mode("overwrite").partitionBy("bucket").parquet(target)
                asked = self.spark.range(self.buckets).filter(F.col("id").isin(touched)).select(F.col("id").cast("int").alias("bucket"))
                written = self.spark.read.schema(dealt.schema).parquet(target)
                counts = written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_rows"))
                entry = asked.join(counts, "bucket", "left").select(
                    F.lit(table).alias("table"), "bucket", F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
                    F.lit(kind).alias("appended"), F.lit(batch).cast("long").alias("commit"))
                entries = entry if entries is None else entries.unionByName(entry)
        # The entry itself: one small file, visible as a whole.
        entries.coalesce(1).write.mode("overwrite").json(f"{self.path}/ledger/batch={batch}")
        return True
