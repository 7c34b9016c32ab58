"""Quality rules with adaptive thresholds per language and source.

Each document gets counts (words, their characters, symbols, repeated lines, words in repeated three-word windows) and
three ratios from them. Fixed cutoffs are replaced by fences around each group's own quartiles. A group is a (language,
source) pair; its quartiles come from a quantile sketch: a count per logarithmic bucket of the ratio. Such sketches
merge by adding counts, in any order, so Spark's partial aggregation builds them before the shuffle, however large a
group is, and the result does not depend on the order. A quantile is off by at most half a bucket (1 %).

Defined results: a null text counts as empty; a null language or source is a group of its own; repeated rows are judged
alike, each on its own; an empty table gives an empty result; extra columns are kept, a column named like one of the
results is replaced. Documents that fail the base rules give nothing to the sketches. Groups with fewer than
``min_group`` rows use the sketches of all rows. Texts are processed whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from embertrace.llm.common import restored, sheltered

WHITE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["symbol_ratio", "word_length", "repeat_ratio"]


@dataclass(frozen=True)
class QualityConfig:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: A fence lies this many quartile ranges beyond the quartile.
    reach: float = 4.0
    #: Least quartile ranges, for groups whose documents are all alike: of the ratios in the order of RATIOS.
    least_range: tuple[float, float, float] = (0.05, 0.4, 0.1)
    #: Groups with fewer documents use the sketches of all documents.
    min_group: int = 30
    #: Ratio between the bounds of neighbouring sketch buckets.
    gamma: float = 1.02


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) > 1_000_000:  # keep the triple below 2**63
        pairs = np.unique(pairs, return_inverse=True)[1]
    triples = pairs[:-1] * len(number) + ids[2:]
    order = np.sort(triples)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return 0
    at = np.minimum(np.searchsorted(twice, triples), len(twice) - 1)
    hit = twice[at] == triples
    covered = np.zeros(n, bool)
    covered[:-2] |= hit
    covered[1:-1] |= hit
    covered[2:] |= hit
    return int(covered.sum())


def text_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """The counts of COUNTS for one text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(WHITE)]
    return (len(words), len(text.translate(None, WHITE + _CONTINUATION)), len(text) - len(text.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words))


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of COUNTS. Other columns pass through as they are."""
    docs = docs.drop(*COUNTS)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
            rows = [text_counts(t.as_py() or b"") for t in texts]
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays(batch.columns + columns, names=batch.schema.names + COUNTS)

    schema = StructType([*docs.schema.fields, *(StructField(name, LongType()) for name in COUNTS)])
    return docs.mapInArrow(run, schema)


def _with_ratios(counted: DataFrame, config: QualityConfig) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return counted.withColumns({
        "symbol_ratio": F.col("n_symbols") / words,
        "word_length": F.col("word_chars") / words,
        "repeat_ratio": F.col("n_repeat_words") / words,
        "base_failed": (F.col("n_words") < config.min_words)
        | (100 * F.col("n_repeat_words") > config.max_repeat_percent * F.col("n_words")),
    })


def thresholds(ratios: DataFrame, config: QualityConfig, lang: str = "lang", source: str = "source") -> DataFrame:
    """Fences per (lang, source): columns ``low_<ratio>`` and ``high_<ratio>``, with one row of all rows (whole = true)."""
    step = math.log(config.gamma)
    # Bucket 0 holds ratios below a thousandth; bucket b > 0 begins at 0.001 * gamma ** (b - 1).
    bucket = F.when(F.col("value") < 0.001, 0).otherwise(1 + F.floor(F.log(F.col("value") / 0.001) / step))
    middle = F.when(F.col("bucket") == 0, 0.0).otherwise(0.001 * F.exp((F.col("bucket") - 0.5) * step))
    sketch = (
        ratios.filter(~F.col("base_failed"))
        .select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.posexplode(F.array(*RATIOS)).alias("ratio", "value"))
        .groupBy("lang", "source", "ratio", bucket.cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))
    )
    merged = sketch.groupBy("ratio", "bucket").agg(F.sum("rows").alias("rows"))
    both = sketch.withColumn("whole", F.lit(False)).unionByName(
        merged.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "whole": F.lit(True)}))
    keys = ["whole", "lang", "source", "ratio"]
    running = Window.partitionBy(*keys).orderBy("bucket")
    placed = both.withColumns({
        "upto": F.sum("rows").over(running), "total": F.sum("rows").over(Window.partitionBy(*keys)), "middle": middle})
    quartiles = placed.groupBy(*keys).agg(
        F.min(F.when(4 * F.col("upto") >= F.col("total"), F.col("middle"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), F.col("middle"))).alias("q3"),
        F.max("total").alias("rows"))
    least = F.element_at(F.array(*map(F.lit, config.least_range)), F.col("ratio") + 1)
    reach = config.reach * F.greatest(F.col("q3") - F.col("q1"), least)
    fences = quartiles.withColumns({"low": F.col("q1") - reach, "high": F.col("q3") + reach})
    sides = [F.max(F.when(F.col("ratio") == k, F.col(side))).alias(f"{side}_{name}")
             for k, name in enumerate(RATIOS) for side in ("low", "high")]
    return fences.groupBy("whole", "lang", "source").agg(F.max("rows").alias("group_rows"), *sides)


def quality_rules(docs: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """``docs`` (text, lang, source, ...) with counts, ratios, fences, ``base_failed`` and ``kept``.

    Texts are scanned twice, once for the sketches and once for the verdicts; nothing but sketches is shuffled unless
    the fences are too many to broadcast.
    """
    made = [*COUNTS, *RATIOS, "base_failed", "kept"]
    names = [c for c in docs.columns if c not in made]
    docs = sheltered(docs.drop(*made))
    narrow = _with_ratios(with_counts(docs.select("text", "lang", "source")), config)
    fences = thresholds(narrow, config)
    sides = [c for c in fences.columns if c.startswith(("low_", "high_"))]
    whole = fences.filter("whole").select(*sides).first()  # one row, of all documents
    small = F.coalesce(F.col("group_rows"), F.lit(0)) < config.min_group
    own = fences.filter("NOT whole").select(
        F.col("lang").alias("_lang"), F.col("source").alias("_source"), "group_rows", *[F.col(c).alias(f"_{c}") for c in sides])
    judged = _with_ratios(with_counts(docs), config).join(
        own, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    judged = judged.withColumns({
        c: F.when(small, F.lit(whole[c] if whole else None).cast("double")).otherwise(F.col(f"_{c}")) for c in sides})
    inside = F.lit(True)
    for name in RATIOS:
        inside = inside & F.coalesce(F.col(name).between(F.col(f"low_{name}"), F.col(f"high_{name}")), F.lit(True))
    judged = judged.withColumn("kept", ~F.col("base_failed") & inside)
    return judged.select(*restored(judged, names), *made, *sides)
