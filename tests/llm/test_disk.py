"""What the operators leave on the disk: shuffles of ended jobs, tables that nothing reads any more, copies of texts."""

from __future__ import annotations

import os
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from embertrace.llm.hmm import HmmConfig, Vocabulary, encoded, split, train, word_counts
from embertrace.llm.jaccard import one_of_each
from embertrace.llm.mixing import mixed_documents
from embertrace.llm.repeats import without_repeats
from embertrace.staging import discard, stage


def staged(spark) -> dict[str, int]:
    """Bytes of each stored table."""
    top = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")) / "embertrace-stage"
    return {t.name: sum(f.stat().st_size for f in t.rglob("*.parquet")) for t in top.iterdir()} if top.exists() else {}


def shuffle_files(spark) -> int:
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(f.startswith("shuffle_") for top in folders for _, _, files in os.walk(top) for f in files)


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(7)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(n))
    passage = words(60)
    rows = [(k, words(300) + " " + passage * (k % 9 == 0), "en", f"s{k % 3}") for k in range(240)]
    rows += [(1000 + k, rows[k][1] + " end", "en", "s0") for k in range(40)]
    return stage(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "test-texts")


def test_stored_tables_keep_no_shuffles(spark):
    before = shuffle_files(spark)
    table = stage(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "test-shuffled")
    name, = (n for n in staged(spark) if n.startswith("test-shuffled"))
    ends = time.monotonic() + 10
    while shuffle_files(spark) > before and time.monotonic() < ends:  # executors are told, not waited for
        time.sleep(0.1)
    assert shuffle_files(spark) <= before
    assert table.count() == 100
    discard(table)
    assert name not in staged(spark)


def test_mixing_sorts_no_texts(spark, texts):
    before = staged(spark)
    mixed = mixed_documents(texts)
    rows = mixed.collect()
    assert len(rows) > 200 and {r.text for r in rows} <= {r.text for r in texts.collect()}
    made = {n: size for n, size in staged(spark).items() if n not in before}
    size = sum(s for n, s in before.items() if n.startswith("test-texts"))
    assert sum(made.values()) < 1.5 * size, made


@pytest.mark.parametrize("operator, kept", [(one_of_each, {"kept"}), (without_repeats, {"copies"})])
def test_finished_tables_are_deleted(spark, texts, operator, kept):
    before = set(staged(spark))
    once = operator(texts)
    assert once.count() == {"one_of_each": 240, "without_repeats": 280}[operator.__name__]
    left = {n.rsplit("-", 1)[0] for n in set(staged(spark)) - before}
    # Besides the result's own table, tables of a few numbers per class may stay.
    assert left <= kept | {"classes-of-documents", "components", "smallest", "links"}, left


def test_rounds_of_training_keep_no_shuffles(spark, texts):
    rows = split(texts)
    vocabulary = Vocabulary(word_counts(rows), HmmConfig())
    documents = encoded(rows, vocabulary)
    before = shuffle_files(spark)
    train(documents, vocabulary, HmmConfig())
    ends = time.monotonic() + 10
    while shuffle_files(spark) > before and time.monotonic() < ends:
        time.sleep(0.1)
    assert shuffle_files(spark) <= before
