"""JSON log files: arrays, wrapped arrays, single objects and one object per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# --- fixed values: keys under which a wrapping object holds its records ------
WRAPPER_KEYS = ("events", "logs", "records", "data", "results")
# --- end of fixed values ------------------------------------------------------


def json_value_count(text: Column) -> Column:
    """How many comma-separated JSON values ``text`` holds; NULL if malformed.

    Wrapping in brackets makes the reader look at the whole text, where parsing
    it alone would stop after the first value.
    """
    return F.json_array_length(F.concat(F.lit("["), text, F.lit("]")))


def is_one_value(text: Column) -> Column:
    return F.coalesce((F.trim(text) != "") & (json_value_count(text) == 1), F.lit(False))


def is_object(text: Column) -> Column:
    return F.trim(text).startswith("{") & is_one_value(text)


def records_of_document(text: Column) -> Column:
    """Records of one complete JSON document as an array of JSON texts."""
    body = F.trim(text)
    fields = F.from_json(body, "map<string,string>")
    wrapped = [
        F.when(F.trim(fields[key]).startswith("["), F.from_json(fields[key], "array<string>")) for key in WRAPPER_KEYS
    ]
    return F.when(body.startswith("["), F.from_json(body, "array<string>")).when(
        body.startswith("{"), F.coalesce(*wrapped, F.array(body))
    )


def records_of_lines(text: Column) -> Column:
    """Objects of a text with one JSON value per line; other lines are skipped."""
    return F.filter(F.transform(F.split(text, "\r?\n"), lambda line: F.trim(line)), is_object)


def explode_documents(documents: DataFrame, text: str = "content") -> DataFrame:
    """Whole documents to records: adds ``record_no`` and ``raw`` per record."""
    body = F.col(text)
    records = F.when(is_one_value(body), records_of_document(body)).otherwise(records_of_lines(body))
    return documents.select(
        *[c for c in documents.columns if c != text], F.posexplode(records).alias("record_no", "raw")
    )


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """(file, raw) for every record of the files at ``path``.

    Files with one value per line stay splittable. Only a file whose first line
    is not a whole JSON value (a document spread over lines) is read in one
    piece, because such a document cannot be split.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("line")).alias("position"),
        F.trim("value").alias("line"),
    ).filter(F.col("line") != "")
    files = lines.groupBy("file").agg(
        F.count("*").alias("lines"), F.min_by("line", "position").alias("first_line")
    ).select("file", "lines", ((F.col("lines") > 1) & ~is_one_value(F.col("first_line"))).alias("spread"))

    per_line = lines.join(files.filter(~F.col("spread")), "file")
    single = F.when(F.col("lines") == 1, records_of_document(F.col("line")))
    several = F.when(is_object(F.col("line")), F.array("line"))
    from_lines = per_line.select("file", F.explode(F.coalesce(single, several)).alias("raw"))

    whole = (
        spark.read.text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))
        .join(files.filter("spread").select("file"), "file", "left_semi")
    )
    return from_lines.unionByName(explode_documents(whole).select("file", "raw"))
