"""Prefix trie against brute force."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from embertrace.llm.prefix_trie import conversation_trie, subtree_sums

SCHEMA = "conv_id bigint, turn bigint, role string, text string, owner string, depth int, size string, hash string"


def plain_trie(rows: list[tuple]) -> dict:
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, role.encode(), hashlib.md5(text.encode()).hexdigest(), text))
    turns = {c: [(t[2].decode(), t[4]) for t in sorted(ts, key=lambda t: t[:4])] for c, ts in turns.items()}
    members, ends, children, value = defaultdict(list), defaultdict(list), defaultdict(set), {}
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(turns.get(c - c % 100, [])[:h] + turns[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                children[path[:d - 1]].add(path[:d])
        ends[path].append(c)
    for p in members:
        value[p] = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += value[p]
    return {(m[0], len(p)): (members[p[:-1]][0] if p else None, len(m), len(children[p]), leaves[p], saved[p],
                             hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items()}


def result(df) -> dict:
    rows = df.collect()
    found = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(found) == len(rows)
    return found


def test_subtree_sums_of_any_tree():
    rng = np.random.default_rng(0)
    for n in [1, 2, 3, 10, 50, 300]:
        for shape in range(4):
            parents = [-1] + [[int(rng.integers(0, i)), i - 1, 0, max(0, i - int(rng.integers(1, 4)))][shape] for i in range(1, n)]
            values = [rng.integers(0, 9, n).tolist(), rng.integers(0, 100, n).tolist()]
            plain = [list(v) for v in values]
            for i in range(n - 1, 0, -1):
                for p in plain:
                    p[parents[i]] += p[i]
            assert subtree_sums(parents, values) == plain


@pytest.mark.parametrize("component_nodes", [4096, 5])
def test_table_equals_brute_force(spark, sf_dir, component_nodes):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
    assert result(conversation_trie(table, component_nodes)) == plain_trie(rows)


@pytest.mark.parametrize("component_nodes", [1, 7])
def test_awkward_rows(spark, component_nodes):
    rng = np.random.default_rng(4)
    rows = []
    for conv in [*range(0, 12), *range(100, 130), *range(303, 310)]:
        for turn in range(int(rng.integers(1, 9))):
            at = None if rng.random() < 0.1 else turn if rng.random() < 0.9 else 2
            text = [None, "", "aa", "b€😀", "x" * 50_000][rng.integers(0, 5)]
            rows.append((conv, at, [None, "", "user", "assistant"][rng.integers(0, 4)], text, "a", 1, "b", "c"))
    rows += [rows[0], rows[0], (None, 1, "user", "hidden", None, None, None, None), (None,) * 8, (5000, None, None, None, None, None, None, None)]
    # Long conversations that share a long beginning.
    rows += [(c, t, "user", f"t{t if t < 90 else (c, t)}", "", 0, "", "") for c in (600, 601, 602) for t in range(120)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert result(conversation_trie(df, component_nodes)) == plain_trie([r[:4] for r in rows])


def test_empty_table(spark):
    df = conversation_trie(spark.createDataFrame([], SCHEMA))
    assert df.count() == 0 and "ends_sha256" in df.columns
