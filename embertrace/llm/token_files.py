"""Token ids in Re-Pair compressed shards, written in document order and read back at random.

Documents are range-partitioned by id, encoded, and gathered into shards of about ``shard_ids`` ids that end at document
bounds. Within a shard, Re-Pair repeatedly replaces frequent pairs of neighbouring ids by nonterminals: each round counts
all pairs, makes a rule of every pair seen ``least_count`` times or more, and replaces its occurrences from the left,
except where they overlap one taken already. Rounds end when no pair is left that often.

File format (a Parquet table, one row per shard): ``part, shard`` (order of the shards), ``n_ids``, ``doc_ids``,
``doc_lengths`` (ids per document, with the end id), ``rules`` (two unsigned 32-bit numbers per rule, in order: rule r is
symbol ``base + r``), ``rule_lengths`` (expanded ids of each rule, unsigned 32-bit), ``symbols`` (the compressed shard) and
``base`` (first nonterminal). With the expansion lengths, any id range is decoded without expanding what lies before it.

Defined results: a null text is empty and holds the end id alone; a null document id comes first; rows of one id follow
each other in order of their texts' hash and text; an empty table writes no shard. Extra columns are not read. A very long text makes
a shard of its own. Order keys hold a hash of the text, so one repeated id does not bind a range to one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from embertrace.llm.common import map_batches, partitions, sheltered
from embertrace.llm.word_ids import encoder
from embertrace.staging import staging_root

SHARD_IDS = 1 << 20
SHARD_SPEC = ("part:int, shard:int, n_ids:long, base:long, doc_ids:longs, doc_lengths:ints, rules:binary, "
              "rule_lengths:binary, symbols:binary")


# --- Re-Pair ---------------------------------------------------------------------------


def _spots(keys: np.ndarray) -> np.ndarray:
    """20-bit hashes of pairs."""
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).view(np.int64)


def repair(ids: np.ndarray, least_count: int = 32) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(base, rules, rule lengths, symbols) of an array of ids."""
    base = int(ids.max()) + 1 if len(ids) else 0
    symbols = ids.astype(np.int64)
    lengths = np.ones(base, np.int64)
    rules = np.empty((0, 2), np.int64)
    near = np.arange(len(symbols) - 1)
    while len(near):
        # ``near`` has the pairs that hold a symbol of the last round. A round leaves no occurrence of a frequent pair, and
        # symbols come to stand together only beside a new one, so all other pairs are still rare.
        keys = (symbols[near] << 32) | symbols[near + 1]
        # Counts by a small table of hashes set aside most rare pairs; what they let through is sorted and counted exactly.
        spots = _spots(keys)
        places = np.flatnonzero((np.bincount(spots, minlength=1 << 20) >= least_count)[spots])
        order = np.sort(keys[places])
        starts = np.flatnonzero(np.r_[True, order[1:] != order[:-1]]) if len(order) else places
        counts = np.diff(np.r_[starts, len(order)])
        frequent = order[starts[counts >= least_count]]
        if not len(frequent):
            break
        # A table by hash tells which frequent pair stands at a place; pairs that share their hash with another are searched for.
        numbers = np.full(1 << 20, -1, np.int32)
        numbers[_spots(frequent)] = np.arange(len(frequent))
        at = numbers[spots[places]]
        places, at = places[at >= 0], at[at >= 0]
        met = keys[places]
        hit = frequent[at] == met
        other = np.flatnonzero(~hit)
        at[other] = np.minimum(np.searchsorted(frequent, met[other]), len(frequent) - 1)
        hit[other] = frequent[at[other]] == met[other]
        places, at = near[places[hit]], at[hit]
        # In a run of overlapping pairs take every other one, from the run's start.
        begins = np.r_[True, np.diff(places) > 1]
        run_start = np.maximum.accumulate(np.where(begins, np.arange(len(places)), 0))
        every_other = (np.arange(len(places)) - run_start) % 2 == 0
        taken = places[every_other]
        at = at[every_other]
        # Rules are numbered in order of the pairs that are replaced somewhere.
        replaced = np.zeros(len(frequent), bool)
        replaced[at] = True
        used = np.flatnonzero(replaced)
        symbols[taken] = base + len(rules) + (np.cumsum(replaced) - 1)[at]
        rest = np.ones(len(symbols), bool)
        rest[taken + 1] = False
        symbols = symbols[rest]
        # Where the new symbols stand now, and the pairs that they are the first or second of.
        new = taken - np.arange(len(taken))
        touched = np.zeros(len(symbols) + 1, bool)
        touched[new] = True
        touched[new - 1] = True
        near = np.flatnonzero(touched[: max(len(symbols) - 1, 0)])
        pairs = np.stack([frequent[used] >> 32, frequent[used] & 0xFFFFFFFF], axis=1)
        lengths = np.concatenate([lengths, lengths[pairs[:, 0]] + lengths[pairs[:, 1]]])
        rules = np.concatenate([rules, pairs])
    return base, rules.astype(np.uint32), lengths[base:].astype(np.uint32), symbols.astype(np.uint32)


def _levels(base: int, rules: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Ids of symbols, nonterminals being replaced level by level."""
    out = symbols.astype(np.int64)
    while len(out):
        big = out >= base
        if not big.any():
            break
        ends = np.cumsum(1 + big.astype(np.int64))
        made = np.empty(int(ends[-1]), np.int64)
        made[ends[~big] - 1] = out[~big]
        pairs = rules[out[big] - base]
        made[ends[big] - 2], made[ends[big] - 1] = pairs[:, 0], pairs[:, 1]
        out = made
    return out


def expand(base: int, rules: np.ndarray, rule_lengths: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """All ids of some symbols: each rule among them is expanded once and copied to its places."""
    met = np.zeros(base + len(rules), bool)
    met[symbols] = True
    used = np.flatnonzero(met)
    widths = np.ones(base + len(rules), np.int64)
    widths[base:] = rule_lengths
    texts = _levels(base, rules, used).astype(np.uint32)
    begins = np.zeros(base + len(rules), np.int64)
    begins[used] = np.cumsum(widths[used]) - widths[used]
    lengths = widths[symbols]
    ends = np.cumsum(lengths)
    if not len(ends):
        return texts
    return texts[np.repeat(begins[symbols] - ends + lengths, lengths) + np.arange(ends[-1])]


def read_range(shard: dict, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` (not included) of a shard row, expanding only the symbols that cover them."""
    base, rules, rule_lengths, symbols = _arrays(shard)
    widths = np.ones(len(symbols), np.int64)
    big = symbols >= base
    widths[big] = rule_lengths[symbols[big] - base]
    ends = np.cumsum(widths)
    first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left")
    before = int(ends[first - 1]) if first else 0
    return expand(base, rules, rule_lengths, symbols[first: last + 1])[start - before: stop - before]


def _arrays(shard: dict) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    number = lambda name: np.frombuffer(shard[name], "<u4").astype(np.int64)
    return shard["base"], number("rules").reshape(-1, 2), number("rule_lengths"), number("symbols")


# --- writing and reading ------------------------------------------------------------------


def _shards(part: int, docs: Iterator[tuple[int | None, np.ndarray]], shard_ids: int) -> Iterator[dict]:
    number, held, doc_ids = 0, [], []

    def close() -> dict:
        base, rules, rule_lengths, symbols = repair(np.concatenate(held))
        little = lambda x: np.ascontiguousarray(x, "<u4").tobytes()
        return {"part": [part], "shard": [number], "n_ids": [sum(map(len, held))], "base": [base], "doc_ids": [doc_ids],
                "doc_lengths": [[len(x) for x in held]], "rules": [little(rules)], "rule_lengths": [little(rule_lengths)],
                "symbols": [little(symbols)]}

    total = 0
    for doc_id, ids in docs:
        if held and total + len(ids) > shard_ids:
            yield close()
            number, held, doc_ids, total = number + 1, [], [], 0
        held.append(ids)
        doc_ids.append(doc_id)
        total += len(ids)
    if held:
        yield close()


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, path: str, shard_ids: int = SHARD_IDS) -> None:
    """Encode ``docs`` (doc_id, text) and write the shards to ``path``."""
    spark = docs.sparkSession
    rows = sheltered(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    placed = rows.repartitionByRange(partitions(spark), *order[:2]).sortWithinPartitions(*order)

    def run(batches):
        encode, end = encoder(vocabulary).encode, np.array([end_id], np.uint32)
        encoded = (
            (doc_id, np.concatenate([encode(text), end]))
            for batch in batches for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        return _shards(TaskContext.get().partitionId(), encoded, shard_ids)

    map_batches(placed, SHARD_SPEC, run).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, in no order: ``doc_id, start, n_tokens, ids`` (ids as little-endian unsigned 32-bit)."""
    shards = spark.read.parquet(path)
    # Two small windows: shards within a part, and one total per part.
    own = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before_part"))
    starts = shards.select("part", "shard", F.coalesce(F.sum("n_ids").over(own), F.lit(0)).alias("in_part")).join(offsets, "part")
    starts = starts.select("part", "shard", (F.col("in_part") + F.col("before_part")).alias("shard_start"))

    # The offsets join the compressed shards, so that expanded ids are never shuffled.
    placed = shards.join(starts, ["part", "shard"])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                data = expand(*_arrays(row)).astype("<u4").tobytes()
                lengths = np.array(row["doc_lengths"], np.int64)
                ends = np.cumsum(lengths)
                yield {"doc_id": row["doc_ids"], "start": row["shard_start"] + ends - lengths, "n_tokens": lengths,
                       "ids": pa.array([data[4 * (e - k): 4 * e] for e, k in zip(ends, lengths)], pa.binary())}

    return map_batches(placed, "doc_id:long, start:long, n_tokens:long, ids:binary", run)


def token_file_digest(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Write the shards of ``docs`` to the shared folder and read them back: doc_id, start, n_tokens, ids_crc32."""
    import uuid

    spark = docs.sparkSession
    path = f"{staging_root(spark)}/token-files/{uuid.uuid4().hex}"
    write_token_files(docs, vocabulary, end_id, path)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


__all__ = ["expand", "read_range", "read_token_files", "repair", "token_file_digest", "write_token_files"]
