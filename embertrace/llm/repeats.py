"""Repeated passages across a corpus with a sparse suffix array.

1. *Sparse suffixes.* Suffixes are kept at minimiser positions only: among ``w`` neighbouring word positions the one whose
   next ``k`` words have the smallest hash, with k + w - 1 = ``length``. The choice depends on content alone, so every
   passage of ``length`` words keeps a suffix, at the same place wherever it occurs. A first scan counts them by their
   first k words (a 64-bit hash); a second one writes those that occur twice, one row each, with their surroundings: the hashes
   of the windows of ``length`` words that keep the suffix, written once per batch where several suffixes agree in all of them.
2. *Neighbours.* The suffixes are sorted over all tasks, by first words, then surroundings, then place. Neighbours
   that agree in both form a run; runs that a border of tasks divides are put together by their ends' equal keys. So all
   copies of a passage shrink to a run, in however many tasks they lie.
3. *Extension.* A run of its own among suffixes of the same first words extends left and right as far as its windows reach. Where
   several runs share their first words, their windows are compared, so each run knows how far left and right it agrees with any other.
   Windows met twice are repeats; overlapping ones join to spans.

The second scan knows the repeated suffixes by a bitmap sized by their number, up to ``MOST_SLOTS`` bits; a suffix let through by
chance costs one row in step 2, which is exact (up to equal 64-bit hashes). The first occurrence of a window, by document id, text hash
and position, stands; later ones are copies. Words are runs of non-white ASCII-wise, compared as written; white space does not matter.

Defined results: null, empty and short texts have no repeats; a passage that repeats within one document counts as well;
repeated rows repeat each other, and rows equal in id and text share their spans; an empty table gives an
empty result; equal places are settled by the order above; a very long text is one row in one task; extra columns are not read by :func:`repeated_spans` and kept by :func:`without_repeats`.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from embertrace.llm.common import gram_hashes, map_batches, mixed, partitions, restored, sheltered, text_bytes, word_hashes
from embertrace.staging import discard, stage

LENGTH = 50
K = 26
#: Bits of the bitmap of repeated suffixes: at least, at most, and per suffix.
LEAST_SLOTS, MOST_SLOTS, SLOTS_A_KEY = 1 << 15, 1 << 28, 16
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+").finditer


def minimisers(keys: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of ``w`` neighbouring keys, the position of its smallest (leftmost if equal), as (positions, index of each run)."""
    n = len(keys) - w + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # Positions of the smallest key of ever wider runs, doubling while that fits.
    best, width = np.arange(len(keys)), 1

    def smaller(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(keys[left] <= keys[right], left, right)

    while 2 * width <= w:
        best, width = smaller(best[:-width], best[width:]), 2 * width
    chosen = smaller(best[:n], best[w - width: w - width + n])
    new = np.r_[True, chosen[1:] != chosen[:-1]]  # positions never go back
    return chosen[new], np.cumsum(new) - 1


class _Bitmap:
    """Which keys may be repeated: one bit per slot of the hash. Spark puts the bitmap together in pieces of 32,768 bits."""

    def __init__(self, repeated: DataFrame) -> None:
        wanted = SLOTS_A_KEY * repeated.count()
        self.slots = LEAST_SLOTS
        while self.slots < min(wanted, MOST_SLOTS):
            self.slots *= 2
        slot = F.pmod(F.shiftrightunsigned("key", 7), F.lit(self.slots)) + 1
        pieces = repeated.groupBy(F.bitmap_bucket_number(slot).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
        table = np.zeros(self.slots // 8, np.uint8)
        for piece in pieces.toLocalIterator():
            at = (piece["piece"] - 1) * (LEAST_SLOTS // 8)
            table[at: at + LEAST_SLOTS // 8] = np.frombuffer(piece["bits"], np.uint8)
        self.table = repeated.sparkSession.sparkContext.broadcast(table)

    def has(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys >> np.uint64(7)) % np.uint64(self.slots)
        return (self.table.value[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), text_bytes().alias("text"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = K, tables: list[DataFrame] | None = None) -> DataFrame:
    """Documents with repeated passages: doc_id, text_key, n_words, starts, ends (word spans of all repeats),
    copy_starts, copy_ends (spans of copies of an earlier occurrence) and repeated_words, copied_words.

    ``tables`` gets the stored tables that the result reads."""
    w = length - k + 1
    if not 1 <= w <= 63:
        raise ValueError("length - k must be 0 to 62: the windows that keep a suffix are bits of a number")
    source = _documents(sheltered(docs))
    suffixes = stage(_repeated_suffixes(source, length, k), "suffixes")
    runs = _runs(suffixes)
    place = F.struct("doc_id", "text_key", "place")
    # Stored before the join, so that Spark may split the rows of a run that very many documents hold.
    extended = _extended(runs)
    discard(runs)
    if tables is not None:
        tables += [suffixes, extended]
    members = suffixes.drop("windows", "many").join(extended, ["key", "around"])
    # Null ids order before others, here as in the minimum.
    copies = F.when(place.eqNullSafe(F.col("first")), F.col("repeated").bitwiseAND(F.bitwise_not("own"))).otherwise(F.col("repeated"))
    marked = members.select("doc_id", "text_key", "n_words", F.struct((F.col("place") - F.col("lead")).alias("at"), "repeated", copies.alias("copies")).alias("mark"))
    # The suffixes of one document: fewer than its words, equal rows once.
    marked = marked.groupBy("doc_id", "text_key").agg(F.max("n_words").alias("n_words"), F.collect_set("mark").alias("marks"))

    def spans(batches):
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("starts", "ends", "copy_starts", "copy_ends", "repeated_words", "copied_words")}
            lists = batch.column(3)
            numbers = [x.to_numpy() for x in lists.flatten().flatten()]
            bounds = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
            for a, b in zip(bounds, bounds[1:]):
                for prefix, name, bits in (("", "repeated_words", numbers[1][a:b]), ("copy_", "copied_words", numbers[2][a:b])):
                    set_ = (bits[:, None] >> np.arange(w)) & 1 == 1
                    places = np.sort((numbers[0][a:b, None] + np.arange(w))[set_])
                    starts, ends = joined(places, length)
                    out[f"{prefix}starts"].append(starts)
                    out[f"{prefix}ends"].append(ends)
                    out[name].append(int((ends - starts).sum()))
            yield {"doc_id": batch.column(0), "text_key": batch.column(1), "n_words": batch.column(2), **out}

    return map_batches(marked, "doc_id:long, text_key:long, n_words:long, starts:longs, ends:longs, copy_starts:longs, "
                               "copy_ends:longs, repeated_words:long, copied_words:long", spans)


def _repeated_suffixes(source: DataFrame, length: int, k: int) -> DataFrame:
    """One row per suffix that occurs twice (and few others): ``key`` (hash of its first k words), ``around`` (hash of the windows that
    keep it), doc_id, text_key, n_words, ``place``, ``lead`` (places from the first such window to it), ``many`` windows, and ``windows``,
    null but for one of the batch's suffixes with the same surroundings."""
    w = length - k + 1

    def counted(batches):
        for batch in batches:
            keys = []
            for text in batch.column(2).to_pylist():
                grams = gram_hashes(word_hashes(text.split()), k)
                keys.append(grams[minimisers(grams, w)[0]])
            keys, count = np.unique(np.concatenate(keys), return_counts=True)
            yield {"key": keys.view(np.int64), "seen": count}

    kept = map_batches(source, "key:long, seen:long", counted).groupBy("key").agg(F.sum("seen").alias("seen"))
    found = stage(kept.filter("seen > 1").select("key"), "repeated-suffixes")
    repeated = _Bitmap(found)
    discard(found)
    salt = mixed(np.arange(1, w + 1, dtype=np.uint64))

    def written(batches):
        for batch in batches:
            rows, texts, hashes = [np.empty((0, 7), np.int64)], [], []
            for number, text in enumerate(batch.column(2).to_pylist()):
                words = word_hashes(text.split())
                grams = gram_hashes(words, k)
                chosen, owner = minimisers(grams, w)
                if not len(chosen):
                    continue
                met = np.flatnonzero(repeated.has(grams[chosen]))
                if not len(met):
                    continue
                windows = gram_hashes(words, length)
                begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                many = np.diff(np.r_[begin, len(owner)])
                lead = chosen - begin
                inner = np.arange(len(owner)) - np.repeat(begin, many)
                around = mixed(np.add.reduceat(mixed(windows ^ salt[inner]), begin) + lead.astype(np.uint64))
                rows.append(np.stack([grams[chosen].view(np.int64), around.view(np.int64), np.full(len(chosen), number), np.full(len(chosen), len(words)),
                                      chosen, lead, many], axis=1)[met])
                texts.append(np.full(len(met), len(hashes)))
                hashes.append(windows.view(np.int64))
            table = np.concatenate(rows)
            if not len(table):
                continue
            owner = np.concatenate(texts)
            # Surroundings are written with the first suffix that has them.
            first = np.zeros(len(table), bool)
            first[np.unique(table[:, 1], return_index=True)[1]] = True
            begin = table[:, 4] - table[:, 5]
            windows = [hashes[t][b: b + m] if f else None for f, t, b, m in zip(first, owner, begin, table[:, 6])]
            at = pa.array(table[:, 2])
            yield {"key": table[:, 0], "around": table[:, 1], "doc_id": batch.column(0).take(at), "text_key": batch.column(1).take(at),
                   "n_words": table[:, 3], "place": table[:, 4], "lead": table[:, 5], "many": table[:, 6], "windows": windows}

    return map_batches(source, "key:long, around:long, doc_id:long, text_key:long, n_words:long, place:long, lead:long, many:long, windows:longs", written)


def _runs(suffixes: DataFrame) -> DataFrame:
    """Runs of neighbours that agree in first words and surroundings: ``key, around, seen, first`` (doc_id, text_key, place of the
    first member), ``lead``, ``many``, ``windows``."""
    order = ["key", "around", "doc_id", "text_key", "place"]
    ordered = suffixes.repartitionByRange(partitions(suffixes.sparkSession), *order).sortWithinPartitions(*order)

    def compared(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            key, around = (batch.column(i).to_numpy() for i in (0, 1))
            begin = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (around[1:] != around[:-1])])
            # A member whose windows are written, if the run has one here.
            n = batch.num_rows
            written = np.where(batch.column(7).is_valid().to_numpy(zero_copy_only=False), np.arange(n), n)
            told = np.minimum.reduceat(written, begin)
            heads = batch.take(pa.array(begin))
            yield {**{c: heads.column(i) for i, c in enumerate(order + ["lead", "many"])}, "seen": np.diff(np.r_[begin, n]),
                   "windows": batch.column(7).take(pa.array(told, mask=told == n))}

    spec = "key:long, around:long, doc_id:long, text_key:long, place:long, lead:long, many:long, seen:long, windows:longs"
    parts = map_batches(ordered.select(*order, "lead", "many", "windows"), spec, compared)
    # A run that lies in several tasks or batches has a part in each.
    return stage(parts.groupBy("key", "around").agg(
        F.sum("seen").alias("seen"), F.min(F.struct("doc_id", "text_key", "place")).alias("first"), F.min("lead").alias("lead"),
        F.min("many").alias("many"), F.max("windows").alias("windows")), "runs")


def _extended(runs: DataFrame) -> DataFrame:
    """``key, around, first, repeated, own``: bits of the windows of a run that occur twice anywhere, and of those whose first occurrence
    is the run's first member. Runs without a repeated window are left out. Stored."""
    several = runs.groupBy("key").agg(F.count(F.lit(1)).alias("runs")).filter("runs > 1")
    compared = runs.join(several, "key").select(
        "key", "around", "seen", "first", "lead", F.posexplode("windows").alias("number", "window"))
    at = F.struct("first.doc_id", "first.text_key", (F.col("first.place") - F.col("lead") + F.col("number")).alias("place"))
    compared = stage(compared.select("key", "around", "seen", "first", "number", "window", at.alias("at")), "compared-windows")
    met = compared.groupBy("window").agg(F.sum("seen").alias("times"), F.min("at").alias("least")).filter("times > 1")
    bit = F.expr("shiftleft(1L, number)")
    own = F.when(F.col("at").eqNullSafe(F.col("least")), bit).otherwise(F.lit(0).cast("long"))
    shared = compared.join(met, "window").groupBy("key", "around").agg(
        F.min("first").alias("first"), F.bit_or(bit).alias("repeated"), F.bit_or(own).alias("own"))
    alone = runs.filter("seen > 1").join(several, "key", "left_anti")
    whole = F.expr("shiftleft(1L, cast(many as int)) - 1")
    extended = stage(shared.unionByName(alone.select("key", "around", "first", whole.alias("repeated"), whole.alias("own"))), "extended-runs")
    discard(compared)
    return extended


def joined(places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans (starts, ends) that the windows at ``places`` (ascending) cover together."""
    if not len(places):
        return places, places
    new = np.r_[True, places[1:] > places[:-1] + length]
    return places[new], places[np.r_[np.flatnonzero(new)[1:] - 1, len(places) - 1]] + length


def cut(text: bytes, starts: list[int], ends: list[int]) -> bytes:
    """A text without the word spans, and without the white space after them."""
    words = [m.span() for m in _WORDS(text)]
    out, at = [], 0
    for a, b in zip(starts, ends):
        out.append(text[at: words[a][0]])
        at = words[b][0] if b < len(words) else len(text)
    return b"".join([*out, text[at:]])


def without_repeats(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """``docs`` (doc_id, text, ...) without copies of passages that stand elsewhere; n_chars, if present, follows.

    Documents keep their row, be their text empty. Only documents that lose text meet their spans in a join; the
    table of spans is broadcast by Spark if small.
    """
    names, docs, tables = docs.columns, sheltered(docs), []
    copies = repeated_spans(docs, length, k, tables).filter("copied_words > 0").select(
        F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), F.col("copy_starts").alias("_starts"), F.col("copy_ends").alias("_ends"))
    copies = stage(copies, "copies")
    discard(*tables)
    met = docs.join(copies, (F.xxhash64("text") == F.col("_key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")), "left")

    @F.pandas_udf("string")
    def shortened(text, starts, ends):
        rows = zip(text, starts, ends)
        return pd.Series([t if s is None else cut(t.encode(), s, e).decode() for t, s, e in rows])

    text = F.when(F.col("_starts").isNull(), F.col("text")).otherwise(shortened("text", "_starts", "_ends"))
    changed = met.withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col("_starts").isNull(), F.col("n_chars")).otherwise(
            F.length("text")).cast(docs.schema["n_chars"].dataType))
    return changed.select(*restored(changed, names))
