"""Cut lineage between stages with a table in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_DIR_KEY = "spark.checkpoint.dir"
_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Where the tables that :func:`stage` returned lie.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def staging_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A machine-local folder is made up only in local mode with the setting unset.
    """
    folder = spark.conf.get(_DIR_KEY, None)
    if folder:
        return folder
    if spark.conf.get("spark.master", "").startswith("local"):
        folder = tempfile.mkdtemp(prefix="embertrace-")
        spark.conf.set(_DIR_KEY, folder)
        return folder
    raise ValueError(f"set {_DIR_KEY} to a folder that every executor can reach")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of each job started inside when it ends, not when the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP_KEY)
    spark.conf.set(_CLEANUP_KEY, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP_KEY, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and return the table read back.

    Used where a result feeds two or more consumers, or where recomputing it
    after the loss of an executor would repeat the scan of the raw events.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark)}/embertrace-stage/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Delete what :func:`stage` wrote for these tables: nothing still to run may read them. Other tables are left alone."""
    for table in tables:
        path = None if table is None else _paths.pop(table, None)
        if path is not None:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
