"""Harmonic packing of documents into sequences of equal length.

Lengths fall into reciprocal-capacity classes: a sequence of class k holds exactly k pieces of length capacity / k.
Documents may be cut, so every document is cut into full sequences and, for the rest, the powers of two in its length,
longest first. Class k = capacity / 2**j then takes pieces of length 2**j that fit without slack, and every full sequence
is free of padding. The pieces left over in a class form sequences whose piece counts are the powers of two in their
number, so these are filled to a power of two. ``capacity`` must be a power of two.

Workers fill the classes independently: each numbers its pieces per class, and one row per worker and class, summed in
order, tells where its numbers begin. Sequence and offset follow from the number alone; no piece moves.

Defined results: a null text is empty and holds the end id alone; repeated rows are packed each; an empty table gives an
empty result; extra columns are not read; nothing is dropped or cut off.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from embertrace.llm.common import map_batches, sheltered
from embertrace.llm.word_ids import encoder
from embertrace.staging import stage

PIECE_SPEC = "part:int, doc_id:long, start:long, length:long, doc_tokens:long, class_bits:int, own_number:long, ids:binary"


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Full sequences, then the powers of two of the rest, longest first."""
    rest = n % capacity
    return [capacity] * (n // capacity) + [1 << j for j in reversed(range(capacity.bit_length())) if rest >> j & 1]


def cut_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of all documents with their number per class (``class_bits`` = log2 of the length) in their task (``part``)."""

    def run(batches):
        encode, part = encoder(vocabulary).encode, TaskContext.get().partitionId()
        numbers = [0] * capacity.bit_length()
        for batch in batches:
            # A long text makes many pieces: hand them on in small batches.
            rows: list[tuple] = []
            held = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                at = 0
                for length in cut_lengths(len(ids), capacity):
                    bits = length.bit_length() - 1
                    rows.append((doc_id, at, length, len(ids), bits, numbers[bits], ids[at: at + length].tobytes()))
                    numbers[bits] += 1
                    at += length
                held += len(ids)
                if held > 1 << 21:
                    yield _columns(part, rows)
                    rows, held = [], 0
            if rows:
                yield _columns(part, rows)

    rows = sheltered(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return map_batches(rows, PIECE_SPEC, run)


def _columns(part: int, rows: list[tuple]) -> dict:
    names = ["doc_id", "start", "length", "doc_tokens", "class_bits", "own_number", "ids"]
    columns: dict = dict(zip(names, map(list, zip(*rows))))
    columns["ids"] = pa.array(columns["ids"], pa.binary())
    return {"part": [part] * len(rows)} | columns


def pack(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 2048) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit)."""
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    pieces = stage(cut_documents(docs, vocabulary, end_id, capacity), "pieces")
    # Stored, so that Spark knows the size of these counts before it plans the joins: below its broadcast threshold no
    # piece is shuffled, beyond it the joins shuffle.
    per_part = stage(pieces.groupBy("part", "class_bits").agg(F.count(F.lit(1)).alias("pieces")), "piece-counts")
    earlier = Window.partitionBy("class_bits").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("part", "class_bits", F.coalesce(F.sum("pieces").over(earlier), F.lit(0)).alias("first"))
    # One row per class: its pieces, the pieces of its full sequences, and where its sequence ids begin.
    fit = F.expr(f"shiftleft(1L, {capacity.bit_length() - 1} - class_bits)")
    classes = per_part.groupBy("class_bits").agg(F.sum("pieces").alias("total")).withColumns({
        "fit": fit, "left": F.col("total") % fit, "full": F.floor(F.col("total") / fit)})
    sequences = F.col("full") + F.bit_count("left")
    before = Window.orderBy("class_bits").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("base", F.coalesce(F.sum(sequences).over(before), F.lit(0)))
    numbered = pieces.join(offsets, ["part", "class_bits"]).join(classes, "class_bits")
    number = F.col("first") + F.col("own_number")
    over = number - F.col("full") * F.col("fit")  # number among the pieces left over, if not negative
    # The highest bit in which it differs from their count tells which power of two it belongs to.
    bit = F.floor(F.log2(F.greatest(over, F.lit(0)).bitwiseXOR(F.col("left")))).cast("int")
    higher = F.expr("shiftright(left, bit + 1)")
    placed = numbered.withColumns({"number": number, "over": over, "bit": bit}).withColumns({
        "sequence_id": F.col("base") + F.when(F.col("over") < 0, F.floor(F.col("number") / F.col("fit")))
        .otherwise(F.col("full") + F.bit_count(higher)),
        "slot": F.when(F.col("over") < 0, F.col("number") % F.col("fit"))
        .otherwise(F.col("over") - F.expr("shiftleft(shiftright(left, bit + 1), bit + 1)")),
    })
    return placed.select("doc_id", "start", "length", "doc_tokens", F.col("sequence_id").cast("long").alias("sequence_id"),
                         (F.col("slot") * F.col("length")).alias("offset"), "ids")
