"""Exact top-k inner products with vector-approximation files.

Vectors are packed into blocks of up to ``block_rows`` rows. A block stores its vectors as integers and, per dimension, a
4-bit cell of each component between the block's extremes. For a block of queries, the cells alone give an upper bound
of every inner product; a query then reads exact vectors in order of falling bound, a few at a time, until its k-th best
score so far exceeds all bounds left. Bounds equal to that score are still read, so ties are settled by id.

Blocks of queries meet blocks of candidates in a join on the query block; a task keeps the best k per query over all
candidate blocks it sees before the final ranking. Query rows against all rows is the task itself; no pair of vectors is a row.

Defined results: vectors that are null, or hold a null, NaN or infinity, take no part, nor do rows with a null id;
vectors are compared with others of their length only; a query is not compared with rows of its own id; repeated rows of
another id count each; a repeated query row answers again; an empty table gives an empty result; extra columns are not
read. Components are scaled and floored as doubles, sums are exact below 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from embertrace.llm.common import map_batches, partitions

BLOCK_SPEC = "dims:int, n_rows:int, ids:binary, vectors:binary, low:binary, high:binary, cells:binary"
CELLS = 16


def usable(column: str) -> Column:
    """Whether a vector is present and all its components are finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.col(column).isNotNull() & F.forall(F.coalesce(F.col(column), F.array()), finite)


def _block(ids: np.ndarray, vectors: np.ndarray) -> dict:
    """One block row: exact integers, cell bounds per dimension, and cells."""
    low, high = vectors.min(axis=0), vectors.max(axis=0)
    width = np.maximum((high - low) / CELLS, 1e-300)
    cells = np.clip(np.floor((vectors - low) / width), 0, CELLS - 1).astype(np.uint8)
    return {"dims": [vectors.shape[1]], "n_rows": [len(ids)], "ids": [ids.astype("<i8").tobytes()],
            "vectors": [vectors.astype("<f8").tobytes()], "low": [low.astype("<f8").tobytes()],
            "high": [high.astype("<f8").tobytes()], "cells": [cells.tobytes()]}


def pack_blocks(vectors: DataFrame, id_column: str, column: str, scale: float, block_rows: int) -> DataFrame:
    """Blocks of the usable rows, without a shuffle: each task packs what it reads, by vector length."""
    rows = vectors.filter(usable(column) & F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("vector"))

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            values = batch.column(1)
            lengths = values.value_lengths().to_numpy(zero_copy_only=False)
            flat, ids = values.flatten().to_numpy(zero_copy_only=False), batch.column(0).to_numpy(zero_copy_only=False)
            starts = np.cumsum(lengths) - lengths
            for dims in np.unique(lengths):
                which = np.flatnonzero(lengths == dims)
                matrix = np.floor(scale * flat[starts[which][:, None] + np.arange(dims)])
                held.setdefault(int(dims), []).append((ids[which], matrix))
                while sum(len(x) for x, _ in held[int(dims)]) >= block_rows:
                    own = held[int(dims)]
                    all_ids, all_rows = np.concatenate([x for x, _ in own]), np.concatenate([y for _, y in own])
                    yield _block(all_ids[:block_rows], all_rows[:block_rows])
                    held[int(dims)] = [(all_ids[block_rows:], all_rows[block_rows:])]
        for own in held.values():
            if ids_left := [x for x, _ in own if len(x)]:
                yield _block(np.concatenate(ids_left), np.concatenate([y for x, y in own if len(x)]))

    return map_batches(rows, BLOCK_SPEC, run)


class _Best:
    """The best k scores per query of a query block; the k-th decides how far a candidate block is read."""

    def __init__(self, ids: np.ndarray, k: int) -> None:
        self.ids, self.k = ids, k
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, id), ascending

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        own = self.ids[q]
        rows = [(-int(s), int(i)) for s, i in zip(scores, ids) if i != own]
        self.found[q] = sorted(self.found[q] + rows)[: self.k]

    def kth(self, q: int) -> float:
        return -self.found[q][-1][0] if len(self.found[q]) == self.k else -np.inf


def _search(best: _Best, queries: np.ndarray, row: dict, first: int = 32) -> None:
    dims, n = row["dims"], row["n_rows"]
    number = lambda name: np.frombuffer(row[name], "<f8")
    low, high, exact = number("low"), number("high"), number("vectors").reshape(n, dims)
    cells = np.frombuffer(row["cells"], np.uint8).reshape(n, dims)
    ids = np.frombuffer(row["ids"], "<i8")
    width = (high - low) / CELLS
    # Cell bounds, with a margin for rounding in the division that made the cells.
    slack = 1e-9 * (np.abs(low) + np.abs(high) + 1)
    floor_ = np.maximum(low, low + cells * width - slack)
    ceiling = np.minimum(high, low + (cells + 1) * width + slack)
    bounds = np.maximum(queries, 0) @ ceiling.T + np.minimum(queries, 0) @ floor_.T
    bounds += 1e-9 * np.abs(bounds) + 1e-6
    for q in range(len(queries)):
        own = bounds[q]
        able = np.flatnonzero(own >= best.kth(q))
        able = able[np.argsort(-own[able], kind="stable")]
        at, step = 0, first
        while at < len(able) and own[able[at]] >= best.kth(q):
            part = able[at: at + step]
            best.offer(q, exact[part] @ queries[q], ids[part])
            at += step
            step = min(2 * step, 1024)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_column: str = "vec_id",
          column: str = "embedding", query_rows: int = 512, block_rows: int = 4096) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best inner products of each query row with all other rows."""
    spark = vectors.sparkSession
    candidates = pack_blocks(vectors, id_column, column, scale, block_rows)
    # Queries are few in each input partition: gather them before packing.
    asked = vectors.filter(is_query).select(id_column, column).repartition(max(1, partitions(spark) // 4), F.xxhash64(id_column))
    queries = pack_blocks(asked, id_column, column, scale, query_rows).select(
        F.xxhash64("ids", "vectors").alias("q_block"), "dims", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    # Every query block has to reach every candidate block: candidates are dealt over salts, query blocks go to each salt.
    salts = partitions(spark)
    met = candidates.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int")).join(
        queries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["dims", "salt"])

    def run(batches):
        held: dict[int, _Best] = {}
        for batch in batches:
            for row in batch.to_pylist():
                q_ids = np.frombuffer(row["q_ids"], "<i8")
                best = held.get(row["q_block"])
                if best is None:
                    if len(held) == 64:  # hand on before more query blocks are held
                        yield from _rows(held)
                        held.clear()
                    best = held[row["q_block"]] = _Best(q_ids, k)
                _search(best, np.frombuffer(row["q_vectors"], "<f8").reshape(len(q_ids), row["dims"]), row)
        yield from _rows(held)

    found = map_batches(met, "query_id:long, query_row:long, vec_id:long, score:long", run)
    order = Window.partitionBy("query_row", "query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _rows(held: dict[int, _Best]) -> Iterator[dict]:
    for block, best in held.items():
        rows = [(int(best.ids[q]), (block ^ (q * 0x9E3779B97F4A7C15)) & 0x7FFFFFFFFFFFFFFF, i, -s)
                for q, own in enumerate(best.found) for s, i in own]
        if rows:
            columns = list(zip(*rows))
            yield {"query_id": pa.array(columns[0], pa.int64()), "query_row": pa.array(columns[1], pa.int64()),
                   "vec_id": pa.array(columns[2], pa.int64()), "score": pa.array(columns[3], pa.int64())}
