"""Repair of conversations whose turns are damaged, by Hirschberg's divide and conquer.

A conversation is good when its role initials read ``(s?(ua)+)?``: an optional system turn, then user and assistant in
turn. Four states tell where a prefix stands (nothing yet, after s, after u, after a), so the cheapest edits up to a row
are a vector of four costs. A conversation is cut in the middle: forward vectors from its start and backward vectors
from its end meet there, the crossing is the state with the least total, and both halves are solved alone. Only two
vectors are alive at a time, so the working memory of the search is linear in the rows (one byte each) however many
edits are tied. Ties are settled by the audit string (edit initials in order): the forward vector also carries the rank of
each state's least string, which is all that a longer string's order depends on, as no edit string up to a row is a
prefix of another one.

Edits: Keep costs 0, Rerole to user or assistant 2, Delete 3 (must be taken for blank and duplicate rows), Insert of an
empty user or assistant turn 2; a truncated row that stays adds 1.

Plan: slim rows (no text) are dealt by conversation and stream through a task in order, one conversation's codes at a
time; the texts are dealt once, behind their conversation's audit, and leave as repaired rows in order. A task holds a few
bytes per row of one conversation, no text: less than that conversation's own audit cell is long, times a constant. Both
audit and hash of one conversation are sequences by their definition, so one conversation is one task's stream.

Defined results: null role and text are one space; a null conv_id is a conversation of its own; null turns stand first and
count for no gap; rows of one turn are ordered by role, then by the MD5 of their text; repeated rows are duplicates; an
initial is the role's first character as written, anything but s, u, a fits nowhere; very long texts are hashed and passed
on, never held together; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from embertrace.llm.common import map_batches
from embertrace.staging import stage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Codes of a row: initial (0 s, 1 u, 2 a, 3 other) + 4 * fault (0 none, 1 blank, 2 duplicate, 3 truncated); GONE: dropped.
S, U, A, OTHER = range(4)
BLANK, DUPLICATE, CUT = 1, 2, 3
GONE = 255
_FAR = 1 << 40
#: The initial that may come next in a state, besides s in state 0, and the state after it.
_NEXT = {0: (U, 2), 1: (U, 2), 2: (A, 3), 3: (U, 2)}
#: Edits that end a conversation in each state: cost and audit.
_ENDS = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
_LEGAL = {(S, U), (U, A), (A, U)}


def _move_table(code: int) -> tuple[tuple[tuple[int, str] | None, ...], ...]:
    """``[before][after]``: least (cost, audit) of the inserts before a row and the row's own edit."""
    initial, fault = code % 4, code // 4
    table: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(4)]
    for before in range(4):
        state, cost, audit = before, 0, ""
        for _ in range(3):
            options = [(DELETE, "D", state)]
            if fault not in (BLANK, DUPLICATE):
                stays = TRUNCATED if fault == CUT else 0
                fits, after = _NEXT[state]
                options.append((REROLE + stays, "R", after))
                if initial == fits:
                    options.append((KEEP + stays, "K", after))
                elif initial == S and state == 0:
                    options.append((KEEP + stays, "K", 1))
            for price, edit, after in options:
                found = (cost + price, audit + edit)
                if table[before][after] is None or found < table[before][after]:
                    table[before][after] = found
            state, cost, audit = _NEXT[state][1], cost + INSERT, audit + "I"
    return tuple(map(tuple, table))


_MOVES = tuple(map(_move_table, range(16)))


def _forward(codes: bytes, start: int) -> tuple[list[int], list[int]]:
    """Costs of the four states after the rows, and the order of their least audits."""
    costs, ranks = [_FAR] * 4, [0] * 4
    costs[start] = 0
    for code in codes:
        moves = _MOVES[code]
        best: list[tuple] = []
        for after in range(4):
            least = (_FAR, 0, "")
            for before in range(4):
                move = moves[before][after]
                if move is not None and costs[before] < _FAR:
                    found = (costs[before] + move[0], ranks[before], move[1])
                    if found < least:
                        least = found
            best.append(least)
        costs = [b[0] for b in best]
        order = sorted(range(4), key=lambda s: best[s][1:])
        for place, state in enumerate(order):
            ranks[state] = place
    return costs, ranks


def _backward(codes: bytes, ends: list[int]) -> list[int]:
    """Costs from each of the four states before the rows to the end."""
    for code in reversed(codes):
        ends = [min(m[0] + e if m is not None else _FAR for m, e in zip(row, ends)) for row in _MOVES[code]]
    return ends


def least_audit(codes: bytes) -> tuple[int, str]:
    """Cost and audit of the cheapest edits, the ASCII-least of them."""
    if not codes:
        return 0, ""
    whole = [cost for cost, _ in _ENDS]
    out: list[str] = []

    def solve(low: int, high: int, start: int, end: int | None) -> None:
        if high - low == 1:
            moves = _MOVES[codes[low]][start]
            if end is None:
                _, audit = min((m[0] + tail[0], m[1] + tail[1]) for m, tail in zip(moves, _ENDS) if m is not None)
                out.append(audit)
            else:
                out.append(moves[end][1])
            return
        middle = (low + high) // 2
        costs, ranks = _forward(codes[low:middle], start)
        rest = _backward(codes[middle:high], whole if end is None else [0 if s == end else _FAR for s in range(4)])
        crossing = min(range(4), key=lambda s: (costs[s] + rest[s], ranks[s]))
        solve(low, middle, start, crossing)
        solve(middle, high, crossing, end)

    solve(0, len(codes), 0, None)
    return _backward(codes, whole)[0], "".join(out)


def judged(codes: bytes) -> tuple[int, int, int, int, int, str]:
    """Blank, duplicate and truncated rows, illegal neighbours, cost and audit of a conversation."""
    faults = [c // 4 for c in codes]
    initials = [c % 4 for c in codes]
    illegal = sum(pair not in _LEGAL for pair in zip(initials, initials[1:]))
    return (faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), illegal, *least_audit(codes))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone``: the rows after the damage that their ids decide; dropped rows are marked."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fate = F.crc32(key) % 20
    text = F.coalesce("text", space)
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(fate == 4, F.lit("user")).otherwise(F.coalesce("role", space)).alias("role"),
        F.when(fate == 1, F.lit("")).when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (fate == 0).alias("gone"),
        F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def _in_order(rows: DataFrame, *before: Column) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions(
        "conv_id", *before, F.col("turn").asc_nulls_first(), "role", "digest")


def _slim(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, code`` in order; of equal rows of a conversation all but the first are duplicates."""
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    initial = F.substring("role", 1, 1)
    slim = rows.select(
        "conv_id", "turn", "role", F.md5("text").alias("digest"), "gone",
        F.when(initial == "s", S).when(initial == "u", U).when(initial == "a", A).otherwise(OTHER).alias("initial"),
        (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"),
    )
    alike = Window.partitionBy("conv_id", "role", "digest", "gone").orderBy(F.col("turn").asc_nulls_first())
    seen = slim.repartition("conv_id").withColumn("seen", F.row_number().over(alike) > 1)
    fault = F.when(F.col("blank"), BLANK).when(F.col("seen"), DUPLICATE).when(F.col("cut"), CUT).otherwise(0)
    coded = seen.withColumn("code", F.when(F.col("gone"), GONE).otherwise(F.col("initial") + 4 * fault))
    ordered = coded.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "digest")
    return ordered.select("conv_id", "turn", "code")


class _Open:
    """A conversation that is streaming by."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.codes = conv_id, bytearray()
        self.first = self.last = None
        self.turns = 0

    def take(self, codes: bytes, turns: np.ndarray) -> None:
        self.codes += codes
        if len(turns):
            new = turns if self.last is None or turns[0] != self.last else turns[1:]
            self.turns += int((np.diff(new) != 0).sum()) + (len(new) > 0 and (self.last is None or new[0] != self.last))
            self.first = int(turns[0]) if self.first is None else self.first
            self.last = int(turns[-1])

    def row(self, memo: dict[bytes, tuple]) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        codes = bytes(self.codes)
        # Short conversations repeat a few patterns; long ones are not worth remembering.
        found = memo.get(codes) or judged(codes)
        if len(codes) <= 64 and len(memo) < 1 << 14:
            memo[codes] = found
        return (self.conv_id, gaps, *found)


AUDITS = "conv_id:long, gaps:long, blank:long, duplicate:long, truncated:long, illegal:long, cost:long, audit:string"
REPAIRED = "conv_id:long, position:long, edit:string, role:string, text:string"


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int | None, int, int]]:
    """Runs of equal conversation ids of a batch: id, first row, end."""
    column = batch.column(0)
    ids, null = column.fill_null(0).to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
    heads = np.flatnonzero((np.diff(ids) != 0) | (np.diff(null) != 0)) + 1
    bounds = [0, *heads.tolist(), len(ids)] if len(ids) else []
    for low, high in zip(bounds, bounds[1:]):
        yield (None if null[low] else int(ids[low])), low, high


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation of damaged rows: faults counted, least cost, its audit."""

    def run(batches):
        names = [f.split(":")[0] for f in AUDITS.split(", ")]
        pack = lambda done: {n: [r[i] for r in done] for i, n in enumerate(names)}
        current: _Open | None = None
        memo: dict[bytes, tuple] = {}
        for batch in batches:
            done = []
            codes = batch.column(2).to_numpy().astype(np.uint8)
            turn = batch.column(1)
            turns, known = turn.fill_null(0).to_numpy(), ~turn.is_null().to_numpy(zero_copy_only=False)
            for conv_id, low, high in _runs(batch):
                if current is None or current.conv_id != conv_id:
                    if current is not None:
                        done.append(current.row(memo))
                    current = _Open(conv_id)
                stays = codes[low:high] != GONE
                current.take(codes[low:high][stays].tobytes(), turns[low:high][stays & known[low:high]])
            yield pack(done)
        if current is not None:
            yield pack([current.row(memo)])

    return stage(map_batches(_slim(rows), AUDITS, run), "audits")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired rows, each conversation's in order within one partition.

    An audit stands before its conversation's rows; of the conversation only this string is held.
    """
    texts = rows.filter("not gone").select(
        "conv_id", "turn", "role", F.md5("text").alias("digest"), "text", F.lit(None).cast("string").alias("audit"))
    none = F.lit(None)
    heads = found.select(
        "conv_id", none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("digest"),
        none.cast("string").alias("text"), "audit")
    together = _in_order(heads.unionByName(texts), F.col("audit").isNull()).select("conv_id", "audit", "role", "text")

    def run(batches):
        audit, tail, at, state, position = "", 0, 0, 0, 0
        for batch in batches:
            out: list[tuple] = []

            def inserts(conv_id) -> None:
                nonlocal at, state, position
                while at < len(audit) and audit[at] == "I":
                    fits, state = _NEXT[state]
                    out.append((conv_id, position, "I", "user" if fits == U else "assistant", ""))
                    at, position = at + 1, position + 1

            columns = (batch.column(i).to_pylist() for i in range(4))
            for conv_id, head, role, text in zip(*columns):
                if head is not None:
                    audit, tail, at, state, position = head, len(head.rstrip("I")), 0, 0, 0
                    continue
                inserts(conv_id)
                edit = audit[at]
                at += 1
                if edit != "D":
                    fits, after = _NEXT[state]
                    if edit == "R":
                        role, state = "user" if fits == U else "assistant", after
                    else:
                        state = 1 if role[0] == "s" else after
                    out.append((conv_id, position, edit, role, text))
                    position += 1
                # What follows a conversation's last row has no row of its own to wait for.
                if at == tail:
                    inserts(conv_id)
            names = [f.split(":")[0] for f in REPAIRED.split(", ")]
            yield {n: [r[i] for r in out] for i, n in enumerate(names)}

    return map_batches(together, REPAIRED, run)


def conversation_hashes(ordered: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of the rows that :func:`repaired` gives, taken in their order."""
    spec = "conv_id:long, repaired_sha256:string"

    def run(batches):
        current, state = (None,), None
        for batch in batches:
            done = []
            for conv_id, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (conv_id,) != current or state is None:
                    if state is not None:
                        done.append((current[0], state.hexdigest()))
                    current, state = (conv_id,), hashlib.sha256()
                    state.update(f"{role}:{text}".encode())
                else:
                    state.update(f"\n{role}:{text}".encode())
            yield {"conv_id": [d[0] for d in done], "repaired_sha256": [d[1] for d in done]}
        if state is not None:
            yield {"conv_id": [current[0]], "repaired_sha256": [state.hexdigest()]}

    return map_batches(ordered.select("conv_id", "role", "text"), spec, run)


def repair_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(audits, repaired rows) of damaged conversations: see :func:`audits` and :func:`repaired`.

    ``conversations`` has conv_id, turn, role, text and gone (see :func:`damaged`).
    """
    found = audits(conversations)
    return found, repaired(conversations, found)


def repair_digest(conversations: DataFrame) -> DataFrame:
    """Damage, repair and the digest of each conversation's repaired rows."""
    found, rows = repair_conversations(damaged(conversations))
    hashes = conversation_hashes(rows).withColumnRenamed("conv_id", "_conv")
    empty = hashlib.sha256(b"").hexdigest()
    joined = found.join(hashes, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return joined.drop("_conv").withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(empty)))
