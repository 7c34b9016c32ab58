"""Conversation repair against brute force."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib

import numpy as np

from embertrace.llm import turn_repair
from embertrace.llm.turn_repair import OTHER, S, U, damaged, least_audit, repair_conversations, repair_digest

SCHEMA = "conv_id bigint, turn bigint, role string, text string, code string, audit string, gone int"
WHITE = " \t\n\x0b\x0c\r"


def plain_audit(rows: list[tuple[str, str]]) -> tuple[int, str, list[tuple[str, str]]]:
    """Cost, audit and roles kept, by trying everything a state may do; rows are (initial, fault)."""
    best = {(): None}
    states = {0: (0, "")}
    step = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}

    def inserted(states):
        out = dict(states)
        for _ in range(4):
            for s, (c, a) in list(out.items()):
                t = step[s][1]
                if t not in out or (c + 2, a + "I") < out[t]:
                    out[t] = (c + 2, a + "I")
        return out

    for initial, fault in rows:
        after = {}

        def offer(s, found):
            if s not in after or found < after[s]:
                after[s] = found

        for s, (c, a) in inserted(states).items():
            offer(s, (c + 3, a + "D"))
            if fault in ("blank", "duplicate"):
                continue
            more = 1 if fault == "truncated" else 0
            offer(step[s][1], (c + 2 + more, a + "R"))
            if initial == step[s][0]:
                offer(step[s][1], (c + more, a + "K"))
            if initial == "s" and s == 0:
                offer(1, (c + more, a + "K"))
        states = after
    final = inserted(states)
    del best
    return min(final[s] for s in (0, 3) if s in final)


def plain_repair(rows: list[tuple]) -> dict:
    """op13 of all rows, one conversation after another."""
    found, by_conv = {}, {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        by_conv[conv] += [(turn, role, text)] * (2 if fate == 3 else 1)
    for conv, kept in by_conv.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        turns = [t for t, _, _ in kept if t is not None]
        seen, faults = set(), []
        for _, role, text in kept:
            bare = text.strip(WHITE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else
                          "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[:1] for _, r, _ in kept]
        cost, audit = plain_audit(list(zip(initials, faults)))
        out, state, at = [], 0, 0
        turn_of = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
        for edit in audit:
            if edit == "I":
                role, state = turn_of[state]
                out.append(f"{role}:")
                continue
            _, role, text = kept[at]
            at += 1
            if edit == "D":
                continue
            if edit == "K" and role[0] == "s":
                state = 1
            else:
                new, state = turn_of[state]
                role = new if edit == "R" else role
            out.append(f"{role}:{text}")
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in out))
        found[conv] = dict(
            gaps=max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, blank=faults.count("blank"),
            duplicate=faults.count("duplicate"), truncated=faults.count("truncated"),
            illegal=sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost=cost, audit=audit,
            repaired_sha256=hashlib.sha256("\n".join(out).encode()).hexdigest())
    return found


def result(df) -> dict:
    return {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in df.collect()}


def test_audit_is_the_least_of_the_cheapest_edits():
    names, faults = "sua?", ("", "blank", "duplicate", "truncated")
    everything = list(itertools.product(range(4), range(4)))
    for length in range(4):
        for rows in itertools.product(everything, repeat=length):
            codes = bytes(i + 4 * f for i, f in rows)
            assert least_audit(codes) == plain_audit([(names[i], faults[f]) for i, f in rows])
    rng = np.random.default_rng(1)
    for n in [5, 8, 13, 40, 300] * 30:
        rows = [(int(i), int(f)) for i, f in zip(rng.integers(0, 4, n), rng.choice([0, 0, 0, 1, 2, 3], n))]
        codes = bytes(i + 4 * f for i, f in rows)
        assert least_audit(codes) == plain_audit([(names[i], faults[f]) for i, f in rows])


def test_very_long_conversation_is_solved_in_linear_space():
    codes = bytes(np.random.default_rng(2).choice([S, U, U + 12, OTHER, 2], 20_000).astype(np.uint8))
    cost, audit = least_audit(codes)
    assert len(audit.replace("I", "")) == len(codes) and cost > 0


def test_table_equals_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
    assert result(repair_digest(table)) == plain_repair(rows)


def test_awkward_rows(spark):
    rng = np.random.default_rng(3)
    roles = ["system", "user", "assistant", "tool", "", None, "User", "s"]
    texts = [None, "", " \n\t", "Yes.", "No", "Why?!", "Well! \r\n", "long " * 20_000, "ünï \xa0", "same."]
    rows = []
    for conv in [*range(60), None, -7]:
        for turn in range(int(rng.integers(1, 12))):
            at = None if rng.random() < 0.1 else int(rng.integers(0, 6)) if rng.random() < 0.3 else turn
            rows.append((conv, at, roles[rng.integers(0, 8)], texts[rng.integers(0, 10)], "x", "y", 3))
    rows += [rows[5], rows[5], (None, None, None, None, None, None, None)]
    rows += [(1000, t, roles[rng.integers(0, 3)], texts[rng.integers(3, 10)], "x", "y", 3) for t in range(700)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(repair_digest(df)) == plain_repair([r[:4] for r in rows])


def test_empty_table_and_real_rows(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert repair_digest(nothing).count() == 0
    rows = [(1, t, r, x, "", "", 0) for t, (r, x) in enumerate([("assistant", "Hi."), ("user", "What?"), ("user", "And?")])]
    _, fixed = repair_conversations(damaged(spark.createDataFrame(rows, SCHEMA)))
    kept = [(r.position, r.role[0]) for r in fixed.orderBy("position").collect()]
    assert [p for p, _ in kept] == list(range(len(kept)))
    assert re.fullmatch("(s?(ua)+)?", "".join(i for _, i in kept))
    assert turn_repair.GONE not in range(16)
